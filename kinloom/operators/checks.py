"""The rules of the linter and of the validation suite, over one scan.

Each rule takes a Scan and returns (file_id, lineno, xref, detail). ``violations`` runs any number of them over
the same cached lines. Rules by line or by record use windows inside a record; rules between records are joins.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinloom.functions import dates, text
from kinloom.sources import lineage as L
from kinloom.staging import staged

# Fixed values of the format and of the rules.
MAX_LINE, MAX_XREF, MAX_OCCU, SHORT_CONC, MAX_CITATIONS = 255, 22, 120, 5, 10
PARENT_AGES, POSTHUMOUS, DECEASED = (10, 90), 2, 120
RANKS = {"HEAD": 0, "SUBM": 1, "INDI": 2, "FAM": 3, "SOUR": 4, "REPO": 5, "OBJE": 6, "NOTE": 7, "TRLR": 9}
FIRST_EVENTS, LAST_EVENTS = ("BIRT", "CHR", "BAPM", "ADOP"), ("DEAT", "BURI", "PROB", "WILL")
NAME_PIECES = ("GIVN", "SURN", "NSFX", "NPFX")
LINE = r"^\d+ (@[^@]+@ )?[A-Za-z0-9_]{1,31}( .*)?$"


class Scan:
    """Parsed lines and the tables made of them."""

    def __init__(self, lines: DataFrame, as_of_year: int = 2026) -> None:
        self.lines, self.as_of_year = lines, as_of_year

    @cached_property
    def nodes(self) -> DataFrame:
        return L.fold(self.lines)

    @cached_property
    def kids(self) -> DataFrame:
        """Lines with tag, level and value of their parents."""
        return L.with_parent(self.lines.filter("level is not null"), "tag", "level", "value")

    @cached_property
    def events(self) -> DataFrame:
        return L.events(self.lines.filter("level is not null"))

    @cached_property
    def people(self) -> DataFrame:
        return L.people(self.lines.filter("level is not null"))

    @cached_property
    def families(self) -> DataFrame:
        return L.families(self.lines.filter("level is not null"))

    @cached_property
    def edges(self) -> DataFrame:
        return L.edges(self.lines.filter("level is not null"))

    @cached_property
    def citations(self) -> DataFrame:
        return L.citations(self.lines.filter("level is not null"))

    @cached_property
    def vitals(self) -> DataFrame:
        """(file_id, xref, birth, death, sex): the first year of the first BIRT and DEAT, and the last SEX."""
        year = lambda tag: F.min_by("y", F.when((F.col("tag") == tag) & F.col("y").isNotNull(), F.col("l1_no")))
        e = self.events.filter("owner_kind = 'INDI'").withColumn("y", dates.first_year(F.coalesce("date_raw", F.lit("")), "3,4"))
        years = e.groupBy("file_id", F.col("owner_xref").alias("xref")).agg(year("BIRT").alias("birth"), year("DEAT").alias("death"))
        return self.people.select("file_id", "xref", "sex").join(years, ["file_id", "xref"], "left")


    def kept(self) -> Scan:
        """A scan whose tables are written to the shared folder once and read back, so that rules neither compute
        them again nor carry their plans. Tables are written side by side."""
        out = Scan(staged(self.lines, "lint-lines"), self.as_of_year)
        for names in (("kids", "events", "people", "families", "edges", "citations"), ("vitals",)):
            with ThreadPoolExecutor(len(names)) as pool:
                tables = list(pool.map(lambda n: staged(getattr(out, n), f"lint-{n}"), names))
            out.__dict__.update(zip(names, tables))
        return out


Rule = Callable[[Scan], DataFrame]
RULES: dict[str, tuple[str, Rule]] = {}


def rule(name: str, severity: str = "WARNING") -> Callable[[Rule], Rule]:
    def add(f: Rule) -> Rule:
        RULES[name] = (severity, f)
        return f

    return add


def found(df: DataFrame, detail: Column | str = "value", lineno: str = "lineno", xref: str = "rec_xref") -> DataFrame:
    detail = F.col(detail) if isinstance(detail, str) else detail
    return df.select("file_id", F.col(lineno).cast("long").alias("lineno"), F.coalesce(F.col(xref), F.lit("")).alias("xref"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail"))


#: Rules that see one line at a time: severity, test and detail. ``violations`` takes them all in one pass.
LINE_RULES: dict[str, tuple[str, Callable[[], Column], Callable[[], Column]]] = {}


def line_rule(name: str, test: Callable[[], Column], severity: str = "WARNING", detail: Callable[[], Column] | str = "value") -> None:
    said = (lambda: F.col(detail)) if isinstance(detail, str) else detail
    LINE_RULES[name] = (severity, test, said)
    RULES[name] = (severity, lambda s: found(s.lines.filter(test()), said()))


def _tag(*tags: str) -> Column:
    return F.col("tag").isin(*tags)


V = F.col
# one line at a time
line_rule("date_no_year", lambda: _tag("DATE") & ~V("value").rlike(dates.YEAR))
line_rule("date_bad_format", lambda: _tag("DATE") & (V("level") == 2) & V("value").rlike(dates.YEAR) & ~F.trim("value").rlike(dates.GRAMMAR))
line_rule("date_month_caps", lambda: _tag("DATE") & (dates.upper_months(V("value")) != V("value")))
line_rule("dateless_date", lambda: _tag("DATE") & V("value").rlike(r"(?i)^\s*\d{1,2}\s+(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\.?\s*$"))
line_rule("name_double_spaces", lambda: _tag("NAME") & (F.trim(F.regexp_replace("value", "  +", " ")) != V("value")))
line_rule("long_line", lambda: F.char_length("raw") > MAX_LINE, detail=lambda: F.char_length("raw"))
line_rule("name_slashes", lambda: _tag("NAME") & (F.regexp_count("value", F.lit("/")) > 2))
line_rule("name_slash_balance", lambda: _tag("NAME") & (F.regexp_count("value", F.lit("/")) % 2 == 1))
line_rule("sex_value", lambda: _tag("SEX") & (V("level") == 1) & ~F.trim("value").isin("M", "F", "U"), "ERROR")
line_rule("html_entity", lambda: V("raw").rlike(text.ENTITY) | V("raw").rlike(text.MARKUP))
line_rule("plac_spacing", lambda: _tag("PLAC") & (V("value") != "") & (text.normalize_place(V("value")) != V("value")))
line_rule("blank_plac", lambda: _tag("PLAC") & (V("level") > 1) & (F.trim("value") == ""))
line_rule("plac_address_part", lambda: _tag("PLAC") & (F.size(F.split("value", ",")) >= 2) & text.classify_place_part(F.get(F.split("value", ","), F.lit(0))).isin("addr", "note"), detail=lambda: text.classify_place_part(F.get(F.split("value", ","), F.lit(0))))
line_rule("age_value", lambda: _tag("AGE") & ((F.char_length("value") > 12) | ~F.trim("value").rlike(dates.AGE)), "ERROR")
line_rule("resn_value", lambda: _tag("RESN") & ~F.lower(F.trim("value")).isin("confidential", "locked", "privacy"), "ERROR")
line_rule("pedi_value", lambda: _tag("PEDI") & ~F.lower(F.trim("value")).isin("adopted", "birth", "foster", "sealing"), "ERROR")
line_rule("quay_value", lambda: _tag("QUAY") & ~F.trim("value").isin("", "0", "1", "2", "3"), "ERROR")
line_rule("occu_length", lambda: _tag("OCCU") & (F.char_length("value") > MAX_OCCU), detail=lambda: F.char_length("value"))
line_rule("bare_at_sign", lambda: ~F.trim("value").rlike(L.POINTER) & F.regexp_replace(F.replace("value", F.lit("@@"), F.lit("")), r"@[^@\s]+@", "").contains("@"))
line_rule("nickname_in_name", lambda: _tag("NAME") & F.substring_index("value", "/", 1).rlike('"[^"]+"'))
line_rule("curly_quotes", lambda: V("raw").rlike("[" + "".join(text.QUOTES) + "]"))
line_rule("unknown_surname", lambda: (_tag("NAME") & V("value").rlike("(?i)/UNKNOWN/")) | (_tag("SURN") & (F.upper(F.trim("value")) == "UNKNOWN")))
line_rule("occupation_ignored", lambda: _tag("OCCU") & F.lower(F.trim("value")).isin(*text.IGNORED_OCCUPATIONS))
line_rule("grammar", lambda: (F.trim("raw") != "") & ~V("raw").rlike(LINE), "ERROR", "raw")
line_rule("short_conc", lambda: _tag("CONC") & (F.char_length("value") < SHORT_CONC))


@rule("malformed_xref", "ERROR")
def malformed_xref(s: Scan) -> DataFrame:
    refs = s.lines.withColumn("ref", F.coalesce("xref", F.when(L.is_pointer(), F.trim("value")))).filter("ref is not null")
    kinds = F.array_compact(F.array(F.when(F.char_length("ref") > MAX_XREF, "long"), F.when(V("ref").contains(" "), "space"), F.when(~F.substring("ref", 2, 1).rlike("[A-Za-z0-9_]"), "start")))
    return found(refs.withColumn("kind", F.explode(kinds)), "kind")


# a line and its neighbours or its record
@rule("level_jump", "ERROR")
def level_jump(s: Scan) -> DataFrame:
    rows = s.lines.filter("level is not null").withColumn("before", F.lag("level").over(L.by_file()))
    return found(rows.filter("level > before + 1"), F.concat_ws(">", V("before").cast("string"), V("level").cast("string")))


@rule("trailing_whitespace")
def trailing_whitespace(s: Scan) -> DataFrame:
    rows = s.lines.withColumn("next", F.lead("tag").over(L.by_file()))
    return found(rows.filter((F.rtrim("raw") != V("raw")) & (F.coalesce("next", F.lit("")) != "CONC")), F.lit(""))


@rule("conc_cont_level", "ERROR")
def conc_cont_level(s: Scan) -> DataFrame:
    more = _tag("CONC", "CONT")
    rows = s.lines.filter("level is not null").withColumn("of", L.last_in(F.when(~more, V("level"))))
    return found(rows.filter(more & (V("level") != V("of") + 1)), F.concat_ws(">", V("of").cast("string"), V("level").cast("string")))


@rule("mid_word_conc")
def mid_word_conc(s: Scan) -> DataFrame:
    own = s.lines.filter("rec_tag = 'NOTE' and (level = 0 or tag in ('CONC', 'CONT'))")
    rows = own.withColumn("before", F.lag("value").over(L.by_record())).filter(_tag("CONC"))
    return found(rows.filter(V("before").rlike(r"\p{L}$") & V("value").rlike(r"^\p{Ll}")), F.concat(F.substring("before", -1, 1), F.lit("|"), F.substring("value", 1, 4)))


def _under(s: Scan, child: str, parent: str, not_in_source: bool) -> DataFrame:
    rows = s.lines.filter("level is not null").withColumn("p_level", F.lag("level").over(L.by_file())).withColumn("p_tag", F.lag("tag").over(L.by_file()))
    rows = rows.withColumn("source_level", L.last_in(F.when(_tag("SOUR"), V("level")).when(V("level") <= 1, -1)))
    rows = rows.filter(_tag(child) & (V("p_tag") == parent) & (V("level") == V("p_level") + 1))
    return found(rows.filter("source_level is null or source_level < 0 or level <= source_level") if not_in_source else rows)


RULES["addr_under_plac"] = ("WARNING", lambda s: _under(s, "ADDR", "PLAC", False))
RULES["note_under_plac"] = ("WARNING", lambda s: _under(s, "NOTE", "PLAC", True))
RULES["note_under_addr"] = ("WARNING", lambda s: _under(s, "NOTE", "ADDR", True))


@rule("record_order")
def record_order(s: Scan) -> DataFrame:
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])[V("tag")], F.lit(8))
    heads = s.lines.filter("level = 0").withColumn("rank", rank).filter("tag <> 'TRLR'")
    return found(heads.withColumn("most", F.max("rank").over(L.by_file().rowsBetween(W.unboundedPreceding, -1))).filter("rank < most"), "tag")


@rule("bare_event", "INFO")
def bare_event(s: Scan) -> DataFrame:
    rows = s.lines.filter("level is not null").withColumn("next", F.lead("level").over(L.by_file()))
    return found(rows.filter(_tag("BIRT", "CHR", "DEAT") & (V("level") == 1) & (F.trim("value") == "") & (F.coalesce("next", F.lit(0)) < 2)), "tag")


def _lacks(s: Scan, rows: DataFrame, child: str, detail: str = "tag", severity: str = "") -> DataFrame:
    """rows without a child line of this tag."""
    kids = s.lines.filter(_tag(child)).select("file_id", "rec_no", F.col("parent_lineno").alias("lineno"))
    return found(rows.join(kids, ["file_id", "rec_no", "lineno"], "left_anti"), detail)


RULES["untyped_event"] = ("WARNING", lambda s: _lacks(s, s.lines.filter(_tag("EVEN", "FACT", "IDNO") & (V("level") == 1)), "TYPE"))
RULES["missing_sex"] = ("WARNING", lambda s: _lacks(s, s.lines.filter("level = 0 and tag = 'INDI'"), "SEX"))
RULES["missing_name"] = ("ERROR", lambda s: _lacks(s, s.lines.filter("level = 0 and tag = 'INDI'"), "NAME"))
RULES["sour_without_titl"] = ("WARNING", lambda s: _lacks(s, s.lines.filter("level = 0 and tag = 'SOUR'"), "TITL"))
RULES["asso_without_rela"] = ("ERROR", lambda s: _lacks(s, s.lines.filter("level = 1 and tag = 'ASSO' and rec_tag = 'INDI'"), "RELA", "value"))


@rule("source_without_origin")
def source_without_origin(s: Scan) -> DataFrame:
    by = s.lines.filter("rec_tag = 'SOUR' and level <= 1").groupBy("file_id", "rec_no", "rec_xref").agg(F.min("lineno").alias("lineno"), F.bool_or(_tag("TITL")).alias("titled"), F.bool_or(_tag("AUTH", "PUBL", "REPO")).alias("origin"))
    return found(by.filter("titled and not origin"), F.lit(""))


@rule("citation_without_page", "INFO")
def citation_without_page(s: Scan) -> DataFrame:
    return found(s.citations.filter("level > 0 and rec_tag <> 'SOUR'").filter(F.coalesce("page", F.lit("")) == ""), "source_xref")


@rule("header_fields", "ERROR")
def header_fields(s: Scan) -> DataFrame:
    head = s.kids.filter("rec_tag = 'HEAD' and level > 0")
    has = lambda tag, level=1, value=None: F.bool_or(_tag(tag) & (V("level") == level) & (F.upper(F.trim("value")) == value if value else F.lit(True)))
    tests = {"SOUR": has("SOUR"), "SUBM": has("SUBM"), "GEDC": has("GEDC"), "GEDC.VERS": has("VERS", 2), "GEDC.FORM": has("FORM", 2, "LINEAGE-LINKED"), "CHAR": has("CHAR")}
    by = head.groupBy("file_id").agg(*[F.coalesce(t, F.lit(False)).alias(f"h{k}") for k, t in enumerate(tests.values())])
    missing = F.array_compact(F.array(*[F.when(~V(f"h{k}"), name) for k, name in enumerate(tests)]))
    return by.select("file_id", F.explode(missing).alias("detail")).select("file_id", F.lit(0).cast("long").alias("lineno"), F.lit("").alias("xref"), "detail")


@rule("plac_form", "INFO")
def plac_form(s: Scan) -> DataFrame:
    return found(s.kids.filter("rec_tag = 'HEAD' and tag = 'FORM' and parent_tag = 'PLAC'"))


@rule("name_pieces", "INFO")
def name_pieces(s: Scan) -> DataFrame:
    names = s.lines.filter(_tag("NAME") & (V("level") == 1) & V("value").contains("/"))
    kids = s.lines.filter(_tag("GIVN", "SURN")).groupBy("file_id", "rec_no", F.col("parent_lineno").alias("lineno")).agg(F.collect_set("tag").alias("have"))
    rows = names.join(kids, ["file_id", "rec_no", "lineno"], "left").withColumn("lack", F.array_join(F.array_sort(F.array_except(F.array(F.lit("GIVN"), F.lit("SURN")), F.coalesce("have", F.array().cast("array<string>")))), ","))
    return found(rows.filter("lack <> ''"), "lack")


@rule("fact_aka", "INFO")
def fact_aka(s: Scan) -> DataFrame:
    kid = lambda tag: F.max_by("value", F.when(_tag(tag) & (V("level") == 2), V("lineno")))
    rows = s.lines.filter("level in (1, 2) and l1_no is not null").groupBy("file_id", "rec_no", "rec_xref", "l1_no")
    rows = rows.agg(F.max(F.when(V("level") == 1, V("tag"))).alias("tag"), kid("TYPE").alias("type"), kid("NOTE").alias("note"))
    return found(rows.filter("tag = 'FACT' and upper(trim(type)) = 'AKA' and note is not null"), "note", "l1_no")


@rule("citation_data_child", "ERROR")
def citation_data_child(s: Scan) -> DataFrame:
    data = s.kids.filter("tag = 'DATA' and parent_tag = 'SOUR' and parent_level > 0").select("file_id", "rec_no", F.col("lineno").alias("parent_lineno"))
    return found(s.lines.join(data, ["file_id", "rec_no", "parent_lineno"]).filter(~_tag("DATE", "TEXT", "CONC", "CONT")), "tag")


@rule("sole_event_alternate")
def sole_event_alternate(s: Scan) -> DataFrame:
    e = s.events.filter("owner_kind = 'INDI' and tag in ('BIRT', 'DEAT')").withColumn("n", F.count("*").over(W.partitionBy("file_id", "rec_no", "tag")))
    return found(e.filter("n = 1 and lower(type) = 'alternate'"), "tag", "l1_no", "owner_xref")


@rule("bapm_without_birth")
def bapm_without_birth(s: Scan) -> DataFrame:
    e = s.events.filter("owner_kind = 'INDI'").withColumn("y", dates.first_year(F.coalesce("date_raw", F.lit(""))))
    christened = _tag("BAPM", "CHR") & V("y").isNotNull()
    by = e.groupBy("file_id", "rec_no", F.col("owner_xref").alias("rec_xref")).agg(
        F.min(F.when(christened, V("l1_no"))).alias("lineno"), F.min_by("y", F.when(christened, V("l1_no"))).alias("year"), F.bool_or(_tag("BIRT") & V("date_raw").isNotNull()).alias("born")
    )
    return found(by.filter("lineno is not null and not born"), "year")


@rule("presumed_deceased", "INFO")
def presumed_deceased(s: Scan) -> DataFrame:
    e = s.events.filter("owner_kind = 'INDI'").withColumn("y", dates.first_year(F.coalesce("date_raw", F.lit(""))))
    by = e.groupBy("file_id", "rec_no", F.col("owner_xref").alias("rec_xref")).agg(F.min_by("y", F.when(_tag("BIRT") & V("y").isNotNull(), V("l1_no"))).alias("year"), F.bool_or(_tag("DEAT")).alias("dead"), F.min("l1_no").alias("lineno"))
    return found(by.filter((V("year") <= s.as_of_year - DECEASED) & ~V("dead")), "year")


@rule("empty_fact", "ERROR")
def empty_fact(s: Scan) -> DataFrame:
    rows = s.lines.filter(_tag("FACT", "EVEN") & (V("level") == 1) & (F.trim("value") == "") & (V("rec_tag") == "INDI"))
    kids = s.lines.filter(_tag("DATE", "PLAC", "NOTE") & (V("level") == 2)).select("file_id", "rec_no", F.col("parent_lineno").alias("lineno"))
    return found(rows.join(kids, ["file_id", "rec_no", "lineno"], "left_anti"), "tag")


@rule("name_piece_order")
def name_piece_order(s: Scan) -> DataFrame:
    kids = s.kids.filter("parent_tag = 'NAME'")
    by = kids.groupBy("file_id", "rec_no", "rec_xref", "parent_lineno").agg(F.min(F.when(_tag("TYPE"), V("lineno"))).alias("type"), F.max(F.when(_tag(*NAME_PIECES), V("lineno"))).alias("piece"))
    return found(by.filter("type < piece"), F.lit("TYPE"), "parent_lineno")


@rule("event_source_order")
def event_source_order(s: Scan) -> DataFrame:
    key = F.when(V("tag") == "NOTE", 2).when(V("tag") == "SOUR", 1).otherwise(0)
    kids = s.kids.filter((V("level") == 2) & V("parent_tag").isin(*L.ORDERED_TAGS) & ~_tag("CONC", "CONT")).withColumn("key", key)
    order = W.partitionBy("file_id", "rec_no", "parent_lineno").orderBy("lineno").rowsBetween(W.unboundedPreceding, -1)
    bad = kids.withColumn("most", F.max("key").over(order)).filter("key < most")
    return found(bad.groupBy("file_id", "rec_no", "rec_xref", "parent_lineno").agg(F.min("lineno").alias("first")), F.lit(""), "parent_lineno")


def event_key(tag: Column, date: Column) -> Column:
    """(group, year, month, day): first and last events, a missing year last."""
    d = dates.parse_date(date)
    group = F.when(tag.isin(*FIRST_EVENTS), 0).when(tag.isin(*LAST_EVENTS), 2).otherwise(1)
    return F.struct(group.alias("g"), F.coalesce(d["year"], F.lit(9999)).alias("y"), F.coalesce(d["month"], F.lit(0)).alias("m"), F.coalesce(d["day"], F.lit(0)).alias("d"))


@rule("unsorted_events", "INFO")
def unsorted_events(s: Scan) -> DataFrame:
    e = s.events.withColumn("key", event_key(V("tag"), F.coalesce("date_raw", F.lit(""))))
    e = e.withColumn("before", F.lag("key").over(W.partitionBy("file_id", "rec_no").orderBy("l1_no"))).filter("key < before")
    return found(e.groupBy("file_id", "rec_no", F.col("owner_xref").alias("rec_xref")).agg(F.min("l1_no").alias("lineno"), F.count("*").alias("n")), "n")


@rule("name_piece_case")
def name_piece_case(s: Scan) -> DataFrame:
    caps = lambda c: (F.col(c) == F.upper(c)) & F.col(c).rlike(r"\p{L}")
    return found(s.kids.filter(_tag(*NAME_PIECES) & (V("parent_tag") == "NAME") & caps("value") & ~caps("parent_value")))


def _repeats(s: Scan, *key: str) -> DataFrame:
    own = s.citations.filter("l1_no is not null and level > 1")
    nth = F.row_number().over(W.partitionBy("file_id", "rec_no", "l1_no", "source_xref", *key).orderBy("lineno"))
    return found(own.withColumn("nth", nth).filter("nth > 1"), "source_xref")


RULES["duplicate_citation"] = ("WARNING", lambda s: _repeats(s, "children"))
RULES["same_source_twice"] = ("INFO", lambda s: _repeats(s))


@rule("duplicate_resi", "WARNING")
def duplicate_resi(s: Scan) -> DataFrame:
    e = s.events.filter("tag = 'RESI' and owner_kind = 'INDI'").withColumn("nth", F.row_number().over(W.partitionBy("file_id", "rec_no", "date_raw", "place").orderBy("l1_no")))
    return found(e.filter("nth > 1"), F.concat_ws("; ", "date_raw", "place"), "l1_no", "owner_xref")


@rule("duplicate_event", "WARNING")
def duplicate_event(s: Scan) -> DataFrame:
    e = s.events.filter("tag in ('BIRT', 'DEAT')").groupBy("file_id", "rec_no", F.col("owner_xref").alias("rec_xref"), "tag", "date_raw", "place").agg(F.count("*").alias("n"), F.min("l1_no").alias("lineno"))
    return found(e.filter("n > 1"), "tag")


@rule("duplicate_name")
def duplicate_name(s: Scan) -> DataFrame:
    n = s.lines.filter("rec_tag = 'INDI' and level = 1 and tag = 'NAME'").groupBy("file_id", "rec_no", "rec_xref", "value").agg(F.count("*").alias("n"), F.min("lineno").alias("lineno"))
    return found(n.filter("n > 1"))


@rule("citation_excess", "INFO")
def citation_excess(s: Scan) -> DataFrame:
    c = s.citations.filter("rec_tag = 'INDI' and l1_no is not null and level > 1")
    many = c.groupBy("file_id", "rec_no", "rec_xref", "l1_no").agg(F.count("*").alias("n")).filter(V("n") > MAX_CITATIONS).withColumn("detail", F.concat(F.lit("excessive "), V("n").cast("string")))
    twice = c.groupBy("file_id", "rec_no", "rec_xref", "l1_no", "source_xref", F.coalesce("page", F.lit("")).alias("page")).agg(F.count("*").alias("n")).filter("n > 1").withColumn("detail", F.concat(F.lit("duplicate "), V("source_xref")))
    keep = ["file_id", "rec_xref", "l1_no", "detail"]
    return found(many.select(*keep).unionByName(twice.select(*keep)), "detail", "l1_no")


@rule("godparent_count")
def godparent_count(s: Scan) -> DataFrame:
    rela = s.lines.filter("tag = 'RELA' and level = 2").groupBy("file_id", "rec_no", F.col("parent_lineno").alias("lineno")).agg(F.min_by("value", "lineno").alias("rela"))
    asso = s.lines.filter("tag = 'ASSO' and level = 1 and rec_tag = 'INDI'").join(rela, ["file_id", "rec_no", "lineno"]).filter("lower(trim(rela)) = 'godparent'").withColumn("to", F.trim("value"))
    sexes = s.people.select("file_id", F.col("xref").alias("to"), "sex")
    by = asso.join(sexes, ["file_id", "to"], "left").groupBy("file_id", "rec_no", "rec_xref").agg(F.min("lineno").alias("lineno"), F.count("*").alias("n"), F.count_if(V("sex") == "M").alias("m"), F.count_if(V("sex") == "F").alias("f"))
    return found(by.filter("n > 2 or m > 1 or f > 1"), F.concat_ws("/", V("n").cast("string"), V("m").cast("string"), V("f").cast("string")))


# between records
def targets(s: Scan) -> DataFrame:
    return L.definitions(s.lines)


#: Which record a pointer under a tag must lead to.
TARGETS = {"HUSB": "INDI", "WIFE": "INDI", "CHIL": "INDI", "FAMS": "FAM", "FAMC": "FAM", "OBJE": "OBJE", "SOUR": "SOUR", "REPO": "REPO", "NOTE": "NOTE"}


def _dangling(s: Scan, *tags: str) -> DataFrame:
    wanted = F.create_map(*[F.lit(x) for kv in TARGETS.items() for x in kv])[V("tag")]
    refs = L.pointers(s.lines).filter(_tag(*tags)).withColumn("target_tag", wanted)
    return found(refs.join(targets(s).select("file_id", "target", "target_tag"), ["file_id", "target", "target_tag"], "left_anti"), F.concat_ws(" ", "tag", "target"))


RULES["broken_xref"] = ("ERROR", lambda s: _dangling(s, "HUSB", "WIFE", "CHIL", "FAMS", "FAMC", "OBJE", "SOUR", "REPO"))
RULES["dangling_note"] = ("ERROR", lambda s: _dangling(s, "NOTE"))
RULES["family_pointer_type"] = ("ERROR", lambda s: _dangling(s, "FAMC", "FAMS"))
RULES["person_pointer_type"] = ("ERROR", lambda s: _dangling(s, "HUSB", "WIFE", "CHIL"))


@rule("unresolved_pointer", "ERROR")
def unresolved_pointer(s: Scan) -> DataFrame:
    refs = L.pointers(s.lines).filter("tag <> '_MTTAG'")
    return found(refs.join(targets(s).select("file_id", "target"), ["file_id", "target"], "left_anti"), F.concat_ws(" ", "tag", "target"))


@rule("duplicate_xref", "ERROR")
def duplicate_xref(s: Scan) -> DataFrame:
    by = s.lines.filter("level = 0 and xref is not null").groupBy("file_id", F.col("xref").alias("rec_xref")).agg(F.count("*").alias("n"), F.min("lineno").alias("lineno"))
    return found(by.filter("n > 1"), "n")


@rule("one_way_pointer", "ERROR")
def one_way_pointer(s: Scan) -> DataFrame:
    """HUSB and WIFE with FAMS, CHIL with FAMC, both ways, where the target is there."""
    side = F.when(_tag("HUSB", "WIFE", "FAMS"), "spouse").otherwise("child")
    refs = L.pointers(s.lines).filter("level = 1").filter(_tag("HUSB", "WIFE", "CHIL", "FAMS", "FAMC")).withColumn("side", side)
    refs = refs.join(targets(s).select("file_id", "target"), ["file_id", "target"], "left_semi")
    back = refs.select("file_id", "side", F.col("rec_xref").alias("target"), F.col("target").alias("rec_xref"))
    return found(refs.join(back, ["file_id", "side", "target", "rec_xref"], "left_anti"), F.concat_ws(" ", "tag", "target"))


@rule("date_consistency", "ERROR")
def date_consistency(s: Scan) -> DataFrame:
    """Birth after death, baptism before birth, burial before death, marriage before a spouse's birth, a child
    born before or with a parent or over a year after the parent's death."""
    e = s.events.withColumn("y", dates.first_year(F.coalesce("date_raw", F.lit("")))).filter("y is not null")
    last = lambda *tags: F.max_by("y", F.when(_tag(*tags), V("l1_no")))
    who = e.filter("owner_kind = 'INDI'").groupBy("file_id", F.col("owner_xref").alias("xref")).agg(last("BIRT").alias("birth"), last("DEAT").alias("death"), last("CHR", "BAPM").alias("bapm"), last("BURI").alias("buri"))
    own = who.withColumn("detail", F.explode(F.array_compact(F.array(F.when(V("birth") > V("death"), "birth>death"), F.when(V("bapm") < V("birth"), "baptism<birth"), F.when(V("buri") < V("death"), "burial<death")))))
    married = e.filter("owner_kind = 'FAM' and tag = 'MARR'").groupBy("file_id", F.col("owner_xref").alias("fam")).agg(F.min_by("y", "l1_no").alias("married"))
    spouses = s.edges.filter("role <> 'CHIL'").join(who.withColumnRenamed("xref", "indi"), ["file_id", "indi"])
    wed = spouses.join(married, ["file_id", "fam"]).filter("married < birth").select("file_id", F.col("indi").alias("xref"), F.lit("marriage<birth").alias("detail"))
    child = s.edges.filter("role = 'CHIL'").select("file_id", "fam", F.col("indi").alias("child")).join(who.select("file_id", F.col("xref").alias("child"), F.col("birth").alias("born")), ["file_id", "child"])
    both = spouses.join(child, ["file_id", "fam"])
    kind = F.array_compact(F.array(F.when(V("born") <= V("birth"), "child<=parent"), F.when(V("born") > V("death") + 1, "child>death")))
    born = both.withColumn("detail", F.explode(kind)).select("file_id", F.col("child").alias("xref"), "detail")
    rows = own.select("file_id", "xref", "detail").unionByName(wed).unionByName(born).withColumn("lineno", F.lit(0))
    return found(rows, "detail", "lineno", "xref")


def _parents(s: Scan) -> DataFrame:
    """(file_id, fam, role, parent, p_birth, p_death, child, c_birth)."""
    v = s.vitals
    up = s.edges.filter("role <> 'CHIL'").join(v.select("file_id", F.col("xref").alias("indi"), F.col("birth").alias("p_birth"), F.col("death").alias("p_death")), ["file_id", "indi"])
    down = s.edges.filter("role = 'CHIL'").select("file_id", "fam", F.col("indi").alias("child"), F.lit(0).alias("lineno")).join(v.select("file_id", F.col("xref").alias("child"), F.col("birth").alias("c_birth")), ["file_id", "child"])
    return up.select("file_id", "fam", "role", F.col("indi").alias("parent"), "p_birth", "p_death").join(down, ["file_id", "fam"])


RULES["parent_too_young"] = ("WARNING", lambda s: found(_parents(s).filter(V("c_birth") - V("p_birth") < PARENT_AGES[0]), V("c_birth") - V("p_birth"), xref="child"))
RULES["parent_too_old"] = ("WARNING", lambda s: found(_parents(s).filter(V("c_birth") - V("p_birth") > PARENT_AGES[1]), V("c_birth") - V("p_birth"), xref="child"))
RULES["posthumous_birth"] = ("WARNING", lambda s: found(_parents(s).filter(V("c_birth") > V("p_death") + POSTHUMOUS), V("c_birth") - V("p_death"), xref="child"))
RULES["death_before_birth"] = ("ERROR", lambda s: found(s.vitals.filter("death < birth").withColumn("lineno", F.lit(0)), V("birth") - V("death"), xref="xref"))
RULES["future_date"] = ("ERROR", lambda s: found(s.vitals.filter((V("birth") > s.as_of_year) | (V("death") > s.as_of_year)).withColumn("lineno", F.lit(0)), F.greatest("birth", "death"), xref="xref"))
RULES["spouse_sex"] = ("WARNING", lambda s: found(s.edges.join(s.vitals.select("file_id", F.col("xref").alias("indi"), "sex"), ["file_id", "indi"]).filter("(role = 'HUSB' and sex = 'F') or (role = 'WIFE' and sex = 'M')"), "indi", "ord", "fam"))
RULES["self_marriage"] = ("ERROR", lambda s: found(s.families.filter("husb = wife"), "husb", "ord", "xref"))


def _weddings(s: Scan) -> DataFrame:
    m = s.events.filter("owner_kind = 'FAM' and tag = 'MARR'").withColumn("y", dates.first_year(F.coalesce("date_raw", F.lit("")), "3,4"))
    m = m.groupBy("file_id", F.col("owner_xref").alias("fam")).agg(F.min_by("y", F.when(V("y").isNotNull(), V("l1_no"))).alias("married"))
    return s.edges.filter("role <> 'CHIL'").join(m, ["file_id", "fam"]).join(s.vitals.select("file_id", F.col("xref").alias("indi"), "birth", "death"), ["file_id", "indi"])


RULES["marriage_before_birth"] = ("ERROR", lambda s: found(_weddings(s).filter("married < birth"), "indi", "ord", "fam"))
RULES["marriage_after_death"] = ("ERROR", lambda s: found(_weddings(s).filter("married > death"), "indi", "ord", "fam"))


@rule("godparent_one_way")
def godparent_one_way(s: Scan) -> DataFrame:
    rela = s.lines.filter("tag = 'RELA' and level = 2").select("file_id", "rec_no", F.col("parent_lineno").alias("lineno"), F.lower(F.trim("value")).alias("rela"))
    asso = s.lines.filter("tag = 'ASSO' and level = 1").join(rela, ["file_id", "rec_no", "lineno"]).withColumn("to", F.trim("value"))
    up = V("rela").isin("godparent", "godfather", "godmother")
    asso = asso.filter(up | (V("rela") == "godchild")).withColumn("up", up)
    back = asso.select("file_id", F.col("to").alias("rec_xref"), F.col("rec_xref").alias("to"), (~V("up")).alias("up"))
    return found(asso.join(back, ["file_id", "rec_xref", "to", "up"], "left_anti"), "to")


@rule("orphaned_individual", "INFO")
def orphaned_individual(s: Scan) -> DataFrame:
    tied = s.lines.filter("level = 1 and tag in ('FAMS', 'FAMC', 'ASSOC')").select("file_id", "rec_no")
    return found(s.lines.filter("level = 0 and tag = 'INDI'").join(tied, ["file_id", "rec_no"], "left_anti"), "tag")


@rule("empty_family", "INFO")
def empty_family(s: Scan) -> DataFrame:
    by = s.lines.filter("rec_tag = 'FAM' and level <= 1").groupBy("file_id", "rec_no", "rec_xref").agg(F.min("lineno").alias("lineno"), F.bool_or(_tag("HUSB", "WIFE")).alias("spouse"), F.bool_or(_tag("CHIL", "SOUR") | _tag(*L.EVENT_TAGS)).alias("more"))
    return found(by.filter("spouse and not more"), F.lit(""))


@rule("memberless_family", "ERROR")
def memberless_family(s: Scan) -> DataFrame:
    has = s.lines.filter("level = 1 and tag in ('HUSB', 'WIFE', 'CHIL')").select("file_id", "rec_no")
    return found(s.lines.filter("level = 0 and tag = 'FAM'").join(has, ["file_id", "rec_no"], "left_anti"), "tag")


def _pairs(rows: DataFrame, *key: str) -> DataFrame:
    """Pairs of records that share a key: (xref, detail) with the earlier first, each with the one before it, so
    that a key that very many share gives as many rows as it has records."""
    before = F.lag("xref").over(W.partitionBy("file_id", *key).orderBy("ord"))
    return rows.withColumn("before", before).filter("before is not null")


@rule("duplicate_family")
def duplicate_family(s: Scan) -> DataFrame:
    rows = s.families.withColumn("h", F.coalesce("husb", F.lit(""))).withColumn("w", F.coalesce("wife", F.lit(""))).filter("h <> '' or w <> ''")
    return found(_pairs(rows, "h", "w"), "before", "ord", "xref")


@rule("duplicate_source_title", "INFO")
def duplicate_source_title(s: Scan) -> DataFrame:
    rows = L.sources(s.lines).withColumn("tokens", F.array_join(text.title_tokens(V("title")), " ")).filter("tokens <> ''")
    return found(_pairs(rows, "tokens"), "before", "ord", "xref")


@rule("duplicate_source_record")
def duplicate_source_record(s: Scan) -> DataFrame:
    rows = s.lines.filter("rec_tag = 'SOUR' and tag in ('TITL', 'AUTH', 'PUBL')").groupBy("file_id", F.col("rec_no").alias("ord"), F.col("rec_xref").alias("xref")).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "tag", "value"))), "\n").alias("body"))
    return found(_pairs(rows, "body"), "before", "ord", "xref")


@rule("orphaned_source", "INFO")
def orphaned_source(s: Scan) -> DataFrame:
    cited = s.citations.select("file_id", F.col("source_xref").alias("rec_xref"))
    return found(s.lines.filter("level = 0 and tag = 'SOUR'").join(cited, ["file_id", "rec_xref"], "left_anti"), "tag")


@rule("redundant_page", "INFO")
def redundant_page(s: Scan) -> DataFrame:
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), "s$", "")
    titles = L.sources(s.lines).select("file_id", F.col("xref").alias("source_xref"), "title")
    return found(s.citations.join(titles, ["file_id", "source_xref"]).filter((V("title") != "") & (plain("page") == plain("title"))), "page")


@rule("nonstandard_tag", "INFO")
def nonstandard_tag(s: Scan) -> DataFrame:
    by = s.lines.filter("tag like '\\_%'").groupBy("file_id", "tag").agg(F.count("*").alias("n"), F.min("lineno").alias("lineno")).withColumn("none", F.lit(""))
    return found(by, F.concat_ws(" ", "tag", V("n").cast("string")), "lineno", "none")


@rule("starts_and_ends", "ERROR")
def starts_and_ends(s: Scan) -> DataFrame:
    rows = s.lines.filter(F.trim("raw") != "").groupBy("file_id").agg(F.min_by("raw", "lineno").alias("first"), F.max_by("raw", "lineno").alias("last"), F.max("lineno").alias("lineno")).withColumn("none", F.lit(""))
    bad = F.array_compact(F.array(F.when(~V("first").startswith("0 HEAD"), "HEAD"), F.when(~V("last").startswith("0 TRLR"), "TRLR")))
    return found(rows.withColumn("bad", F.explode(bad)), "bad", "lineno", "none")


#: Rules between lines or records that are planned together, and how many such groups run at a time.
GROUP, AT_A_TIME = 8, 4


def line_violations(lines: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(check, severity, file_id, lineno, xref, detail) of rules that see one line at a time, in one pass."""
    hit = lambda n, sev, test, said: F.when(test(), F.struct(F.lit(n).alias("check"), F.lit(sev).alias("severity"), F.coalesce(said().cast("string"), F.lit("")).alias("detail")))
    hits = F.explode(F.array_compact(F.array(*[hit(n, *LINE_RULES[n]) for n in names])))
    rows = lines.select("file_id", "lineno", F.coalesce("rec_xref", F.lit("")).alias("xref"), hits.alias("hit"))
    return rows.select("hit.check", "hit.severity", "file_id", F.col("lineno").cast("long").alias("lineno"), "xref", "hit.detail")


def violations(scan: Scan, names: tuple[str, ...] = ()) -> DataFrame:
    """(check, severity, file_id, lineno, xref, detail) of the named rules, or of all. Rules by line take one pass;
    the others run in groups over tables that are made once, and each group's rows are written to the shared folder,
    so that no plan grows with the number of rules."""
    wanted = [n for n in RULES if not names or n in names]
    single, others = [n for n in wanted if n in LINE_RULES], [n for n in wanted if n not in LINE_RULES]
    if len(others) > GROUP:
        scan = scan.kept()
    parts = [RULES[n][1](scan).select(F.lit(n).alias("check"), F.lit(RULES[n][0]).alias("severity"), "file_id", "lineno", "xref", "detail") for n in others]
    groups = [reduce(DataFrame.unionByName, parts[k : k + GROUP]) for k in range(0, len(parts), GROUP)]
    if single:
        groups.append(line_violations(scan.lines, tuple(single)))
    if len(others) > GROUP:
        with ThreadPoolExecutor(AT_A_TIME) as pool:
            groups = list(pool.map(lambda df: staged(df, "lint-found"), groups))
    return reduce(DataFrame.unionByName, groups)


def severity_summary(scan: Scan, names: tuple[str, ...] = ()) -> DataFrame:
    return violations(scan, names).groupBy("severity", "check").agg(F.count("*").alias("n"))
