"""Deterministic rewrites: each takes parsed lines and returns the whole file again as (file_id, lineno, seq, raw).

Lines that stay keep their number; inserted lines stand after the line whose number they carry, by seq. A dry run
is ``changes`` without a write: the lines that go (-) and come (+). ``renumbered`` makes parsed lines again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinloom.functions import dates, text
from kinloom.operators import checks as C
from kinloom.sources import lineage as L

# Vendor tags, and the tags and types that conversions know.
VENDOR_TAGS = (
    "_APID", "_OID", "_TID", "_PID", "_LKID", "_MSER", "_CREA", "_USER", "_ORIG", "_ENCR",
    "_ATL", "_CLON", "_DATE", "_PRIM", "_CROP", "_LEFT", "_TOP", "_WDTH", "_HGHT", "_TYPE",
    "_WPID", "_HPID", "_MTYPE", "_STYPE", "_SIZE", "_DSCR", "_META", "_TREE", "_ENV", "_MTTAG",
)
EVENT_NAMES = {"_MILT": "Military Service", "_SEPR": "Separation"}
FACT_TYPES = ("Languages", "Literacy", "Politics", "Medical condition")
PERSON_LINK = r"ancestry\.com/family-tree/person/tree/\d+/person/(\d+)"
PHYSICAL = {"_HEIG": "Height", "_WEIG": "Weight"}

V = F.col
Fix = Callable[[DataFrame], DataFrame]
FIXES: dict[str, Fix] = {}


def out(lines: DataFrame, raw: Column | None = None, seq: Column | int = 0) -> DataFrame:
    return lines.select("file_id", "lineno", (F.lit(seq) if isinstance(seq, int) else seq).cast("int").alias("seq"), (V("raw") if raw is None else raw).alias("raw"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(sign, file_id, lineno, seq, raw): what a rewrite takes away and brings."""
    keys = ["file_id", "lineno", "seq", "raw"]
    both = out(before).withColumn("by", F.lit(-1)).unionByName(after.withColumn("by", F.lit(1)))
    rows = both.groupBy(*keys).agg(F.sum("by").alias("by")).filter("by <> 0")
    return rows.select(F.when(V("by") < 0, "-").otherwise("+").alias("sign"), *keys)


def change_count(before: DataFrame, after: DataFrame) -> DataFrame:
    return changes(before, after).groupBy("sign").agg(F.count("*").alias("n"))


def renumbered(after: DataFrame) -> DataFrame:
    """Parsed lines of a rewritten file, numbered anew."""
    order = W.partitionBy("file_id").orderBy("lineno", "seq")
    return L.parse_lines(after.select("file_id", F.row_number().over(order).cast("long").alias("lineno"), "raw"))


def line(level: Column | int, tag: Column | str, value: Column | str | None = None) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, (int, str)) else x
    head = F.concat(lit(level).cast("string"), F.lit(" "), lit(tag))
    return head if value is None else F.rtrim(F.concat(head, F.lit(" "), F.coalesce(lit(value), F.lit(""))))


def with_value(value: Column) -> Column:
    """The line with another value, as it was before it."""
    return F.concat(F.substring("raw", F.lit(1), F.char_length("raw") - F.char_length("value")), value)


def rewrite(name: str, test: Callable[[], Column], value: Callable[[], Column]) -> None:
    """A rule for lines on their own: where the test holds, the line gets this value."""
    FIXES[name] = lambda lines: out(lines, F.when(F.coalesce(test(), F.lit(False)), with_value(value())).otherwise(V("raw")))


def drop(name: str, test: Callable[[], Column]) -> None:
    FIXES[name] = lambda lines: out(lines.filter(~F.coalesce(test(), F.lit(False))))


def fix(name: str) -> Callable[[Fix], Fix]:
    def add(f: Fix) -> Fix:
        FIXES[name] = f
        return f

    return add


def _tag(*tags: str) -> Column:
    return V("tag").isin(*tags)


def subtree(lines: DataFrame, roots: DataFrame) -> DataFrame:
    """The lines of blocks that start at roots (file_id, rec_no, lineno), with the roots."""
    marked = lines.join(roots.select("file_id", "rec_no", "lineno", F.lit(True).alias("root")).distinct(), ["file_id", "rec_no", "lineno"], "left")
    # a block ends where its root's level comes again; the least level of the roots still open covers inner roots
    level = L.last_in(F.when(V("root") | (V("level") == 0), V("level")))
    start = L.last_in(F.when(V("root") | (V("level") == 0), V("lineno")))
    is_root = L.last_in(F.when(V("root"), True).when(V("level") == 0, False))
    rows = marked.withColumn("r_level", level).withColumn("r_start", start).withColumn("r_is", is_root)
    # any line at or above the root's level since the root ends the block
    later = F.min(F.when(V("lineno") > V("r_start"), V("level"))).over(W.partitionBy("file_id", "rec_no", "r_start").orderBy("lineno").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("later", later)
    return rows.filter(V("r_is") & (V("later").isNull() | (V("later") > V("r_level")))).select(*lines.columns)


def without(lines: DataFrame, gone: DataFrame) -> DataFrame:
    return lines.join(gone.select("file_id", "lineno"), ["file_id", "lineno"], "left_anti")


# lines on their own
rewrite("normalize_dates", lambda: _tag("DATE") & (V("level") == 2), lambda: dates.normalize_date(V("value")))
rewrite("date_caps", lambda: _tag("DATE") & (dates.upper_months(V("value")) != V("value")), lambda: dates.upper_months(F.trim("value")))
rewrite("dateless_dates", lambda: _tag("DATE") & F.trim("value").rlike(r"(?i)^\d{1,2}\s+(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\.?$"), lambda: F.concat(F.lit("("), F.upper(F.regexp_replace(F.trim("value"), r"\.$", "")), F.lit(", year unknown)")))
rewrite("name_double_spaces", lambda: _tag("NAME"), lambda: F.trim(F.regexp_replace("value", "  +", " ")))
rewrite("plac", lambda: _tag("PLAC") & (V("value") != ""), lambda: text.normalize_place(V("value")))
rewrite("html_entities", lambda: V("value").rlike(text.ENTITY) | V("value").rlike(text.MARKUP), lambda: text.decode_html(V("value")))
rewrite("curly_quotes", lambda: F.lit(True), lambda: text.straight_quotes(V("value")))
rewrite("name_case", lambda: _tag("NAME", *C.NAME_PIECES) & (V("value") == F.upper("value")) & V("value").rlike(r"\p{L}{2}"), lambda: text.title_name(V("value")))
rewrite("bare_at_signs", lambda: ~F.trim("value").rlike(L.POINTER) & V("value").contains("@") & ~V("value").contains("@@"), lambda: F.replace("value", F.lit("@"), F.lit("@@")))
drop("blocked_occupations", lambda: _tag("OCCU") & F.lower(F.trim("value")).isin(*text.IGNORED_OCCUPATIONS))


@fix("unknown_surname")
def unknown_surname(lines: DataFrame) -> DataFrame:
    kept = lines.filter(~F.coalesce(_tag("SURN") & (F.upper(F.trim("value")) == "UNKNOWN"), F.lit(False)))
    return out(kept, F.when(_tag("NAME"), F.regexp_replace("raw", "(?i)/UNKNOWN/", "//")).otherwise(V("raw")))


@fix("physical_attributes")
def physical_attributes(lines: DataFrame) -> DataFrame:
    label = F.create_map(*[F.lit(x) for kv in PHYSICAL.items() for x in kv])[V("tag")]
    return out(lines, F.when(label.isNotNull(), line(V("level"), "DSCR", F.concat(label, F.lit(": "), "value"))).otherwise(V("raw")))


@fix("trailing_whitespace")
def trailing_whitespace(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("next", F.lead("tag").over(L.by_file()))
    return out(rows, F.when(F.coalesce("next", F.lit("")) != "CONC", F.rtrim("raw")).otherwise(V("raw")))


@fix("conc_cont_levels")
def conc_cont_levels(lines: DataFrame) -> DataFrame:
    more = _tag("CONC", "CONT")
    rows = lines.withColumn("of", L.last_in(F.when(~more & V("level").isNotNull(), V("level"))))
    return out(rows, F.when(more & (V("level") != V("of") + 1), F.concat((V("of") + 1).cast("string"), F.regexp_replace("raw", r"^\s*\d+", ""))).otherwise(V("raw")))


@fix("bare_events")
def bare_events(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("next", F.lead("level").over(L.by_file()))
    test = _tag("BIRT", "CHR", "DEAT") & (V("level") == 1) & (F.trim("value") == "") & (F.coalesce("next", F.lit(0)) < 2)
    return out(rows, F.when(test, line(1, V("tag"), "Y")).otherwise(V("raw")))


@fix("long_lines")
def long_lines(lines: DataFrame) -> DataFrame:
    """Lines over the limit go on in CONC lines a level below."""
    long = lines.filter(F.char_length("raw") > C.MAX_LINE)
    room = (F.lit(C.MAX_LINE) - F.greatest(F.char_length("raw") - F.char_length("value"), F.lit(7))).cast("int")
    parts = long.select("file_id", "lineno", "level", "raw", "value", F.posexplode(text.wrap_value(V("value"), room)).alias("seq", "part"))
    wrapped = out(parts, F.when(V("seq") == 0, with_value(V("part"))).otherwise(line(V("level") + 1, "CONC", V("part"))), V("seq"))
    return out(lines.filter(F.char_length("raw") <= C.MAX_LINE)).unionByName(wrapped)


# blocks that go
@fix("strip_vendor")
def strip_vendor(lines: DataFrame) -> DataFrame:
    """Lines with vendor tags and all below them."""
    return out(without(lines, subtree(lines, lines.filter(_tag(*VENDOR_TAGS)))))


@fix("sole_alternate")
def sole_alternate(lines: DataFrame) -> DataFrame:
    bad = C.RULES["sole_event_alternate"][1](C.Scan(lines)).select("file_id", F.col("lineno").alias("parent_lineno"))
    gone = lines.filter("tag = 'TYPE' and level = 2 and lower(trim(value)) = 'alternate'").join(bad, ["file_id", "parent_lineno"])
    return out(without(lines, gone))


def _drop_rule(name: str) -> Fix:
    """Takes away the blocks that a rule finds."""

    def run(lines: DataFrame) -> DataFrame:
        bad = C.RULES[name][1](C.Scan(lines)).select("file_id", "lineno").distinct()
        return out(without(lines, subtree(lines, lines.join(bad, ["file_id", "lineno"]).select("file_id", "rec_no", "lineno"))))

    return run


FIXES["duplicate_citations"] = _drop_rule("duplicate_citation")
FIXES["same_source_citations"] = _drop_rule("same_source_twice")
FIXES["duplicate_resi"] = _drop_rule("duplicate_resi")
FIXES["dangling_pointers"] = _drop_rule("broken_xref")


@fix("redundant_pages")
def redundant_pages(lines: DataFrame) -> DataFrame:
    bad = C.RULES["redundant_page"][1](C.Scan(lines)).select("file_id", F.col("lineno").alias("parent_lineno"))
    roots = lines.filter("tag = 'PAGE'").join(bad, ["file_id", "parent_lineno"]).select("file_id", "rec_no", "lineno")
    return out(without(lines, subtree(lines, roots)))


@fix("duplicate_names")
def duplicate_names(lines: DataFrame) -> DataFrame:
    """Later NAME blocks that equal an earlier one but for case and outer blanks."""
    names = lines.filter("rec_tag = 'INDI' and level = 1 and tag = 'NAME'")
    nth = F.row_number().over(W.partitionBy("file_id", "rec_no", F.lower(F.trim("value"))).orderBy("lineno"))
    return out(without(lines, subtree(lines, names.withColumn("nth", nth).filter("nth > 1").select("file_id", "rec_no", "lineno"))))


@fix("duplicate_events")
def duplicate_events(lines: DataFrame) -> DataFrame:
    """Births and deaths of a person with one date and place: the first stays, and the source blocks of the others that
    it has not, each once, go to its end."""
    e = L.events(lines, ("BIRT", "DEAT")).filter("owner_kind = 'INDI'")
    same = W.partitionBy("file_id", "rec_no", "tag", F.nullif("date_raw", F.lit("")), F.nullif("place", F.lit("")))
    e = e.select("file_id", "rec_no", "l1_no", F.min("l1_no").over(same).alias("keeper"), F.count("*").over(same).alias("n")).filter("n > 1")
    rows = lines.filter("level >= 1").withColumn("l2", L.last_in(F.when(V("level") <= 2, F.struct("lineno", "level", "tag")))).join(e, ["file_id", "rec_no", "l1_no"])
    group = ["file_id", "rec_no", "keeper"]
    ends = rows.filter("l1_no = keeper").groupBy(*group).agg(F.max("lineno").alias("end"))
    cited = rows.filter("l2.level = 2 and l2.tag = 'SOUR'").withColumn("at", V("l2.lineno"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("lineno", "raw"))), lambda x: x["raw"])
    blocks = cited.groupBy(*group, "at").agg(body.alias("body"), F.min("l1_no").alias("l1_no"))
    nth = F.row_number().over(W.partitionBy(*group, "body").orderBy("at"))
    new = blocks.withColumn("nth", nth).filter("nth = 1 and l1_no <> keeper").join(ends, group)
    new = new.select("file_id", V("end").alias("lineno"), "at", F.posexplode("body").alias("k", "raw"))
    new = out(new, V("raw"), F.row_number().over(W.partitionBy("file_id", "lineno").orderBy("at", "k")))
    gone = rows.filter("l1_no <> keeper").select("file_id", "lineno")
    return out(without(lines, gone)).unionByName(new)


@fix("web_links")
def web_links(lines: DataFrame) -> DataFrame:
    """_WLNK blocks: links to a person of the file become ASSO with RELA, others a NOTE."""
    kid = lambda tag: F.coalesce(F.trim(F.max_by("value", F.when((V("level") == 2) & _tag(tag), V("lineno")))), F.lit(""))
    heads = lines.filter("level = 1 and tag = '_WLNK'").select("file_id", "rec_no", "l1_no")
    block = lines.join(heads, ["file_id", "rec_no", "l1_no"])
    found = block.groupBy("file_id", "l1_no").agg(kid("TITL").alias("title"), kid("NOTE").alias("url"))
    found = found.withColumn("person", F.regexp_extract("url", PERSON_LINK, 1)).withColumn("target", F.concat(F.lit("@I"), "person", F.lit("@")))
    there = L.definitions(lines.filter("level is not null")).select("file_id", "target", F.lit(True).alias("there"))
    found = found.join(there, ["file_id", "target"], "left").withColumn("lineno", V("l1_no"))
    known, person = F.coalesce("there", F.lit(False)) & (V("person") != ""), V("person") != ""
    note = F.concat("title", F.when(person, " (person not in tree): ").otherwise(": "), "url")
    head = F.when(known, line(1, "ASSO", V("target"))).otherwise(line(1, "NOTE", note))
    rela = out(found.filter(known), line(2, "RELA", F.trim(F.substring_index("title", ":", 1))), 1)
    return out(without(lines, block)).unionByName(out(found, head)).unionByName(rela)


# lines that come
@fix("nicknames")
def nicknames(lines: DataFrame) -> DataFrame:
    """A quoted nickname before the surname moves to a NICK line."""
    nick = F.regexp_extract(F.substring_index("value", "/", 1), '"([^"]+)"', 1)
    rows = lines.withColumn("nick", F.when(_tag("NAME"), F.nullif(nick, F.lit(""))))
    plain = F.trim(F.regexp_replace(F.regexp_replace("value", '"[^"]+"', ""), "  +", " "))
    return out(rows, F.when(V("nick").isNotNull(), with_value(plain)).otherwise(V("raw"))).unionByName(out(rows.filter("nick is not null"), line(V("level") + 1, "NICK", V("nick")), 1))


@fix("name_pieces")
def name_pieces(lines: DataFrame) -> DataFrame:
    """Missing GIVN, SURN and NSFX lines after the last line of a NAME block."""
    names = lines.filter("tag = 'NAME' and level = 1 and value like '%/%' and rec_tag = 'INDI'")
    block = lines.withColumn("name_no", L.last_in(F.when(V("level") <= 1, F.when(_tag("NAME"), V("lineno")).otherwise(-1)))).filter("name_no > 0")
    ends = block.groupBy("file_id", "rec_no", F.col("name_no").alias("lineno")).agg(F.max("lineno").alias("at"), F.collect_set("tag").alias("have"))
    rows = names.join(ends, ["file_id", "rec_no", "lineno"])
    parts = F.split("value", "/")
    pieces = F.array(F.struct(F.lit("GIVN").alias("t"), F.trim(F.get(parts, F.lit(0))).alias("v")), F.struct(F.lit("SURN").alias("t"), F.trim(F.get(parts, F.lit(1))).alias("v")), F.struct(F.lit("NSFX").alias("t"), F.trim(F.coalesce(F.get(parts, F.lit(2)), F.lit(""))).alias("v")))
    new = rows.select("file_id", V("at").alias("lineno"), F.posexplode(pieces).alias("n", "p"), "have").filter("p.v <> '' and not array_contains(have, p.t)")
    return out(lines).unionByName(out(new, line(2, V("p.t"), V("p.v")), V("n") + 1))


@fix("presumed_deceased")
def presumed_deceased(lines: DataFrame) -> DataFrame:
    bad = C.RULES["presumed_deceased"][1](C.Scan(lines)).select("file_id", F.col("xref").alias("rec_xref"))
    ends = lines.filter("rec_tag = 'INDI'").groupBy("file_id", "rec_no", "rec_xref").agg(F.max("lineno").alias("lineno"))
    return out(lines).unionByName(out(ends.join(bad, ["file_id", "rec_xref"]), F.lit("1 DEAT Y"), 1))


@fix("bapm_births")
def bapm_births(lines: DataFrame) -> DataFrame:
    """An estimated birth for people of whom only a baptism is known: into their last BIRT, else a new one."""
    bad = C.RULES["bapm_without_birth"][1](C.Scan(lines)).select("file_id", F.col("xref").alias("rec_xref"), F.col("detail").alias("year"))
    birt = F.max(F.when((V("level") == 1) & _tag("BIRT"), V("lineno")))
    at = lines.filter("rec_tag = 'INDI'").groupBy("file_id", "rec_xref").agg(F.min("lineno").alias("head"), birt.alias("birt")).join(bad, ["file_id", "rec_xref"])
    at = at.withColumn("lineno", F.coalesce("birt", "head"))
    new = out(at.filter("birt is null"), F.lit("1 BIRT"), 1).unionByName(out(at, line(2, "DATE", F.concat(F.lit("EST "), "year")), 2))
    return out(lines).unionByName(new)


@fix("unaccented_names")
def unaccented_names(lines: DataFrame) -> DataFrame:
    """After each NAME block with accents a NAME without, of type AKA, unless the person has it."""
    names = lines.filter("tag = 'NAME' and level = 1 and rec_tag = 'INDI'").withColumn("plain", text.remove_accents(V("value")))
    have = names.select("file_id", "rec_no", F.col("value").alias("plain"))
    nth = F.row_number().over(W.partitionBy("file_id", "rec_no", "plain").orderBy("lineno"))
    new = names.filter("plain <> value").join(have, ["file_id", "rec_no", "plain"], "left_anti").withColumn("nth", nth).filter("nth = 1")
    block = lines.withColumn("name_no", L.last_in(F.when(V("level") <= 1, F.when(_tag("NAME"), V("lineno")).otherwise(-1)))).filter("name_no > 0")
    ends = block.groupBy("file_id", "rec_no", F.col("name_no").alias("lineno")).agg(F.max("lineno").alias("at"))
    new = new.select("file_id", "rec_no", "lineno", "plain").join(ends, ["file_id", "rec_no", "lineno"]).select("file_id", F.col("at").alias("lineno"), "plain")
    return out(lines).unionByName(out(new, line(1, "NAME", V("plain")), 1)).unionByName(out(new, F.lit("2 TYPE AKA"), 2))


@fix("aka_facts")
def aka_facts(lines: DataFrame) -> DataFrame:
    """FACT blocks of type AKA with a note become NAMEs, the note's last word the surname."""
    found = C.RULES["fact_aka"][1](C.Scan(lines)).select("file_id", "lineno", F.col("detail").alias("name"))
    roots = lines.join(found.select("file_id", "lineno"), ["file_id", "lineno"]).select("file_id", "rec_no", "lineno")
    new = out(found, line(1, "NAME", text.wrap_surname(V("name"))), 1).unionByName(out(found, F.lit("2 TYPE aka"), 2))
    return out(without(lines, subtree(lines, roots))).unionByName(new)


@fix("nonstandard_events")
def nonstandard_events(lines: DataFrame) -> DataFrame:
    """_MILT and _SEPR become EVEN with a TYPE; the value goes."""
    name = F.create_map(*[F.lit(x) for kv in EVENT_NAMES.items() for x in kv])[V("tag")]
    rows = lines.withColumn("name", F.when(V("level") == 1, name))
    return out(rows, F.when(V("name").isNotNull(), F.lit("1 EVEN")).otherwise(V("raw"))).unionByName(out(rows.filter("name is not null"), line(2, "TYPE", V("name")), 1))


@fix("events_to_facts")
def events_to_facts(lines: DataFrame) -> DataFrame:
    """Valueless EVENs of some types become FACT, DSCR or NCHI."""
    kid = lambda tag: F.min_by(F.trim("value"), F.when(_tag(tag) & (V("level") == 2), V("lineno")))
    by = lines.filter("l1_no is not null and level <= 2").groupBy("file_id", "rec_no", "l1_no").agg(F.max(F.when(V("level") == 1, F.concat_ws(" ", "tag", F.trim("value")))).alias("head"), kid("TYPE").alias("type"), kid("NOTE").alias("note"))
    by = by.filter("trim(head) = 'EVEN'").filter(V("type").isin(*FACT_TYPES, "Physical Description", "Children"))
    rows = lines.join(by.select("file_id", "rec_no", "l1_no", "type", "note"), ["file_id", "rec_no", "l1_no"], "left")
    first = V("lineno") == V("l1_no")
    count = F.regexp_extract(F.coalesce("note", F.lit("")), r"^(\d+)", 1)
    new = F.when(first & V("type").isin(*FACT_TYPES), F.lit("1 FACT")).when(first & (V("type") == "Physical Description"), line(1, "DSCR", V("note"))).when(first & (V("type") == "Children"), line(1, "NCHI", count)).otherwise(V("raw"))
    gone = (V("level") == 2) & ((_tag("TYPE") & V("type").isin("Physical Description", "Children")) | (_tag("NOTE") & (V("type") == "Physical Description")))
    return out(rows.filter(~F.coalesce(gone, F.lit(False))), new)


@fix("occupations")
def occupations(lines: DataFrame) -> DataFrame:
    """An OCCU (with the event's DATE) after each event whose note names an occupation, once for each person,
    occupation and date."""
    e = L.events(lines, ("RESI", "EVEN", "CENS")).withColumn("occ", text.occupation(F.coalesce("note", F.lit("")))).filter("occ is not null")
    have = L.events(lines, ("OCCU",)).select("file_id", "rec_no", F.lower("value").alias("low"), F.coalesce("date_raw", F.lit("")).alias("d"))
    e = e.withColumn("low", F.lower("occ")).withColumn("d", F.coalesce("date_raw", F.lit("")))
    e = e.withColumn("nth", F.row_number().over(W.partitionBy("file_id", "rec_no", "low", "d").orderBy("l1_no"))).filter("nth = 1").join(have, ["file_id", "rec_no", "low", "d"], "left_anti")
    ends = lines.filter("l1_no is not null").groupBy("file_id", "rec_no", "l1_no").agg(F.max("lineno").alias("lineno"))
    new = e.join(ends, ["file_id", "rec_no", "l1_no"])
    return out(lines).unionByName(out(new, line(1, "OCCU", V("occ")), 1)).unionByName(out(new.filter("d <> ''"), line(2, "DATE", V("d")), 2))


@fix("notexml")
def notexml(lines: DataFrame) -> DataFrame:
    """NOTEs that hold a <notexml> document become its lines, as CONT."""
    nodes = L.fold(lines).filter("tag = 'NOTE'").filter(V("value").contains("<notexml>") | V("value").contains("&lt;notexml&gt;"))
    parts = nodes.select("file_id", "lineno", "level", "xref", F.posexplode(text.notexml_lines(V("value"))).alias("seq", "part"))
    more = lines.filter(_tag("CONC", "CONT")).join(nodes.select("file_id", F.col("lineno").alias("parent_lineno")), ["file_id", "parent_lineno"], "left_semi")
    kept = without(without(lines, more), nodes)
    head = F.concat_ws(" ", V("level").cast("string"), "xref", F.lit("NOTE"), "part")
    return out(kept).unionByName(out(parts, F.when(V("seq") == 0, head).otherwise(line(V("level") + 1, "CONT", V("part"))), V("seq")))


@fix("plac_addresses")
def plac_addresses(lines: DataFrame) -> DataFrame:
    """A street or venue at the start of a PLAC moves to an ADDR or NOTE below it."""
    parts = F.split("value", ",")
    kind = F.when(_tag("PLAC") & (F.size(parts) >= 2), text.classify_place_part(F.get(parts, F.lit(0))))
    rows = lines.withColumn("kind", F.when(kind.isin("addr", "note"), F.upper(kind)))
    rest = F.trim(F.substring("value", F.char_length(F.get(parts, F.lit(0))) + 2, F.char_length("value")))
    return out(rows, F.when(V("kind").isNotNull(), with_value(rest)).otherwise(V("raw"))).unionByName(out(rows.filter("kind is not null"), line(V("level") + 1, V("kind"), F.trim(F.get(parts, F.lit(0)))), 1))


def _promote(child: str, new: str, parent: str) -> Fix:
    """A child line right under its parent becomes the parent's sibling, under another tag."""

    def run(lines: DataFrame) -> DataFrame:
        rows = lines.withColumn("p_tag", F.lag("tag").over(L.by_file())).withColumn("p_level", F.lag("level").over(L.by_file()))
        test = _tag(child) & (V("p_tag") == parent) & (V("level") == V("p_level") + 1)
        return out(rows, F.when(test, line(V("p_level"), new, V("value"))).otherwise(V("raw")))

    return run


FIXES["addr_under_plac"] = _promote("ADDR", "ADDR", "PLAC")
FIXES["note_under_plac"] = _promote("NOTE", "ADDR", "PLAC")


@fix("note_under_addr")
def note_under_addr(lines: DataFrame) -> DataFrame:
    """ADDR street with NOTE venue becomes ADDR venue with CONT street."""
    rows = lines.withColumn("n_tag", F.lead("tag").over(L.by_file())).withColumn("n_level", F.lead("level").over(L.by_file())).withColumn("n_value", F.lead("value").over(L.by_file()))
    rows = rows.withColumn("p_tag", F.lag("tag").over(L.by_file())).withColumn("p_level", F.lag("level").over(L.by_file())).withColumn("p_value", F.lag("value").over(L.by_file()))
    head = _tag("ADDR") & (V("n_tag") == "NOTE") & (V("n_level") == V("level") + 1)
    tail = _tag("NOTE") & (V("p_tag") == "ADDR") & (V("level") == V("p_level") + 1)
    return out(rows, F.when(head, line(V("level"), "ADDR", V("n_value"))).when(tail, line(V("level"), "CONT", V("p_value"))).otherwise(V("raw")))


@fix("note_reflow")
def note_reflow(lines: DataFrame) -> DataFrame:
    """Shared notes with short or mid-word CONC lines are folded and wrapped anew."""
    own = lines.filter("rec_tag = 'NOTE'").withColumn("before", F.lag("value").over(L.by_record()))
    bad = own.filter(_tag("CONC") & ((F.char_length("value") < C.SHORT_CONC) | (V("before").rlike(r"[\p{L}\p{N}]$") & V("value").rlike(r"^[\p{L}\p{N}]")))).select("file_id", "rec_no").distinct()
    nodes = L.fold(lines).filter("rec_tag = 'NOTE' and level = 0").join(bad, ["file_id", "rec_no"])
    texts = nodes.select("file_id", "lineno", "xref", F.posexplode(F.split("value", "\n")).alias("k", "part"))
    parts = texts.select("file_id", "lineno", "xref", "k", F.posexplode(text.wrap_value(V("part"), F.lit(240))).alias("j", "part"))
    new = F.when((V("k") == 0) & (V("j") == 0), F.rtrim(F.concat_ws(" ", F.lit("0"), "xref", F.lit("NOTE"), "part"))).when(V("j") == 0, line(1, "CONT", V("part"))).otherwise(F.concat(F.lit("1 CONC "), "part"))
    kept = lines.join(bad, ["file_id", "rec_no"], "left_anti")
    return out(kept).unionByName(out(parts, new, V("k") * 1000 + V("j")))


# order
def _reordered(lines: DataFrame, *order: Column | str) -> DataFrame:
    """The same lines in another order: the k-th place of a file is the k-th line number that it has."""
    rows = lines.withColumn("place", F.row_number().over(W.partitionBy("file_id").orderBy(*order)))
    numbers = lines.select("file_id", "lineno", F.row_number().over(W.partitionBy("file_id").orderBy("lineno")).alias("place"))
    return out(rows.drop("lineno").join(numbers, ["file_id", "place"]))


@fix("record_order")
def record_order(lines: DataFrame) -> DataFrame:
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in C.RANKS.items() for x in kv])[V("rec_tag")], F.lit(8))
    return _reordered(lines, rank, "rec_no", "lineno")


@fix("sort_events")
def sort_events(lines: DataFrame) -> DataFrame:
    """Events of people and families by time, in the places that events have."""
    e = L.events(lines).withColumn("key", C.event_key(V("tag"), F.coalesce("date_raw", F.lit(""))))
    by_time = e.withColumn("n", F.row_number().over(W.partitionBy("file_id", "rec_no").orderBy("key", "l1_no")))
    by_place = e.withColumn("n", F.row_number().over(W.partitionBy("file_id", "rec_no").orderBy("l1_no"))).select("file_id", "rec_no", "n", F.col("l1_no").alias("to"))
    moved = by_time.join(by_place, ["file_id", "rec_no", "n"]).select("file_id", "rec_no", "l1_no", "to")
    rows = lines.join(moved, ["file_id", "rec_no", "l1_no"], "left")
    return _reordered(rows, "rec_no", F.coalesce("to", "l1_no", "lineno"), "lineno")


def _sorted_children(parents: Callable[[], Column], key: Callable[[], Column]) -> Fix:
    """Children of some lines in the stable order of a key, each with the lines below it."""

    def run(lines: DataFrame) -> DataFrame:
        kids = L.with_parent(lines.filter("level is not null"), "tag", "level").filter(parents()).select("file_id", "rec_no", "lineno", F.col("parent_lineno").alias("owner"), key().alias("key"))
        rows = lines.join(kids, ["file_id", "rec_no", "lineno"], "left")
        chunk = L.last_in(F.when(V("key").isNotNull() | (V("level") <= 1), F.struct("lineno", "owner", "key")))
        rows = rows.withColumn("chunk", chunk)
        return _reordered(rows, "rec_no", F.coalesce("chunk.owner", "lineno"), F.when(V("chunk.owner").isNull(), 0).otherwise(V("chunk.key") + 1), F.coalesce("chunk.lineno", "lineno"), "lineno")

    return run


FIXES["name_piece_order"] = _sorted_children(lambda: (V("parent_tag") == "NAME") & (V("parent_level") == 1), lambda: F.when(_tag(*C.NAME_PIECES), 0).when(_tag("TYPE"), 1).otherwise(2))
FIXES["event_source_order"] = _sorted_children(lambda: V("parent_tag").isin(*L.ORDERED_TAGS) & (V("parent_level") == 1), lambda: F.when(_tag("NOTE"), 2).when(_tag("SOUR"), 1).otherwise(0))

#: The two profiles of the linter, and the clean-up that comes before.
LINT = ("long_lines", "trailing_whitespace", "normalize_dates", "date_caps", "dateless_dates", "curly_quotes", "name_double_spaces", "unknown_surname", "name_case", "nicknames", "name_pieces", "name_piece_order", "plac", "addr_under_plac", "note_under_plac", "note_under_addr", "plac_addresses", "aka_facts", "bapm_births", "duplicate_citations", "redundant_pages", "sole_alternate", "duplicate_names", "duplicate_resi", "dangling_pointers", "bare_events", "event_source_order", "sort_events", "record_order")
FIX_ALL = (*LINT, "html_entities", "presumed_deceased", "conc_cont_levels", "note_reflow")
NORMALIZE = ("strip_vendor", "physical_attributes", "unaccented_names", "nonstandard_events", "events_to_facts", "notexml", "occupations", "blocked_occupations", *LINT)


def applied(lines: DataFrame, names: tuple[str, ...], keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """The named rewrites one after another; keep (df, name) may write each step's result and give it back, which
    bounds the plan."""

    def one(now: DataFrame, name: str) -> DataFrame:
        after = renumbered(FIXES[name](now))
        return keep(after, name) if keep else after

    return reduce(one, names, lines)


def export_minimal(lines: DataFrame, strip_notes: bool = False, keep_fact_sources: bool = False) -> DataFrame:
    """A compact file: no AKA names, persons' citations as bare pointers, none on facts, sources by title alone,
    each source once for a person, events with nothing left gone."""
    kids = L.with_parent(lines.filter("level is not null"), "tag", "level")
    aka = kids.filter("tag = 'TYPE' and upper(trim(value)) = 'AKA' and parent_tag = 'NAME'").select("file_id", "rec_no", F.col("parent_lineno").alias("lineno"))
    roots = aka
    if not keep_fact_sources:
        roots = roots.unionByName(lines.filter("tag = 'SOUR' and level = 2 and rec_tag in ('INDI', 'FAM')").select("file_id", "rec_no", "lineno"))
    if strip_notes:
        roots = roots.unionByName(lines.filter("tag = 'NOTE' and level > 0").select("file_id", "rec_no", "lineno"))
    roots = roots.unionByName(kids.filter("parent_tag = 'SOUR' and parent_level = 1 and rec_tag in ('INDI', 'FAM')").select("file_id", "rec_no", "lineno"))
    roots = roots.unionByName(lines.filter("rec_tag = 'SOUR' and level = 1 and tag not in ('TITL')").select("file_id", "rec_no", "lineno"))
    nth = F.row_number().over(W.partitionBy("file_id", "rec_no", "l1_no", "source_xref").orderBy("lineno"))
    again = L.citations(lines.filter("level is not null")).filter("level > 1").withColumn("nth", nth).filter("nth > 1").select("file_id", "rec_no", "lineno")
    left = without(lines, subtree(lines, roots.unionByName(again)))
    empty = left.withColumn("next", F.lead("level").over(L.by_file())).filter(V("tag").isin(*L.EVENT_TAGS) & (V("level") == 1) & (F.trim("value") == "") & (F.coalesce("next", F.lit(0)) < 2))
    return out(without(left, empty))


def delete_person(lines: DataFrame, file_id: str, xref: str) -> DataFrame:
    """Without a person: their record, pointers to them, and families that have no members or had been a couple
    and are now one alone, with the pointers to those."""
    own = lines.filter((V("file_id") == file_id) & (V("rec_xref") == xref)).select("file_id", "rec_no").distinct()
    edges = L.edges(lines.filter("level is not null")).filter(V("file_id") == file_id)
    count = lambda t: F.count_if(t)
    spouse = V("role") != "CHIL"
    by = edges.groupBy("file_id", "fam").agg(count(V("indi") != xref).alias("left"), count(spouse).alias("had"), count(spouse & (V("indi") != xref)).alias("couple"), count(~spouse & (V("indi") != xref)).alias("kids"), count(V("indi") == xref).alias("own"))
    dead = by.filter("own > 0 and (left = 0 or (had = 2 and couple < 2 and kids = 0))").select("file_id", F.col("fam").alias("rec_xref"))
    kept = lines.join(own, ["file_id", "rec_no"], "left_anti").join(dead, ["file_id", "rec_xref"], "left_anti")
    gone = dead.select("file_id", F.col("rec_xref").alias("target"))
    refs = L.pointers(kept.filter("level is not null")).filter(V("file_id") == file_id)
    bad = refs.filter((V("target") == xref) & _tag("HUSB", "WIFE", "CHIL", "ASSO")).select("file_id", "rec_no", "lineno").unionByName(refs.filter(_tag("FAMS", "FAMC")).join(gone, ["file_id", "target"]).select("file_id", "rec_no", "lineno"))
    return out(without(kept, subtree(kept, bad)))


def write_lines(after: DataFrame, path: str) -> None:
    """Each file's lines in order, as text: a folder for each file, named by its id in URL encoding, in order within."""
    rows = after.repartitionByRange("file_id", "lineno").sortWithinPartitions("file_id", "lineno", "seq")
    rows.select(F.url_encode("file_id").alias("file"), F.col("raw").alias("value")).write.partitionBy("file").text(path)
