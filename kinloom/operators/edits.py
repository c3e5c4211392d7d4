"""Edits of a lineage file as operators: locate a block by its occurrence, then take lines away or put lines in.

Blocks are addressed as TAG:n, the n-th level-1 line of that tag in the record. Each edit returns the file again,
as the rewrites do, so edits chain and can be reviewed with ``rewrites.changes`` before they are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinloom.functions import dates, text
from kinloom.operators.rewrites import line, out, subtree, without
from kinloom.sources import lineage as L

V = F.col
MANAGED = ("TYPE", "DATE", "PLAC", "ADDR", "NOTE", "AGE", "CAUS")


def nth_block(lines: DataFrame, xref: str, tag: str, n: int = 0) -> DataFrame:
    """The level-1 line that starts the block."""
    own = lines.filter((V("rec_xref") == xref) & (V("level") == 1) & (V("tag") == tag))
    return own.withColumn("nth", F.row_number().over(W.partitionBy("file_id", "rec_no").orderBy("lineno")) - 1).filter(V("nth") == n).drop("nth")


def nth_child(lines: DataFrame, block: DataFrame, tag: str, n: int = 0) -> DataFrame:
    kids = lines.filter(V("tag") == tag).join(block.select("file_id", "rec_no", V("lineno").alias("parent_lineno")), ["file_id", "rec_no", "parent_lineno"])
    return kids.withColumn("nth", F.row_number().over(W.partitionBy("file_id", "rec_no", "parent_lineno").orderBy("lineno")) - 1).filter(V("nth") == n).select(*lines.columns)


def block_end(lines: DataFrame, block: DataFrame) -> DataFrame:
    """(file_id, lineno) of the block's last line."""
    return subtree(lines, block).groupBy("file_id").agg(F.max("lineno").alias("lineno"))


def record_end(lines: DataFrame, xref: str) -> DataFrame:
    return lines.filter(V("rec_xref") == xref).groupBy("file_id").agg(F.max("lineno").alias("lineno"))


def inserted(lines: DataFrame, at: DataFrame, new: list[str]) -> DataFrame:
    """new lines after the line that ``at`` (file_id, lineno) names."""
    rows = at.select("file_id", "lineno", F.posexplode(F.array(*map(F.lit, new))).alias("k", "raw"))
    return out(lines).unionByName(rows.select("file_id", "lineno", (V("k") + 1).cast("int").alias("seq"), "raw"))


def delete_block(lines: DataFrame, xref: str, tag: str, n: int = 0) -> DataFrame:
    """Facts, notes, names, marriages: the n-th block of a tag goes."""
    return out(without(lines, subtree(lines, nth_block(lines, xref, tag, n))))


def note_lines(level: int, value: str, limit: int = 248) -> list[str]:
    """NOTE lines of a text: @ doubled, line breaks as CONT, long lines cut with CONC."""
    rows = []
    for k, part in enumerate(value.replace("@", "@@").split("\n")):
        first, *rest = text.wrapped(part, limit)
        rows.append(f"{level} NOTE {first}".rstrip() if k == 0 else f"{level + 1} CONT {first}".rstrip())
        rows += [f"{level + 1} CONC {x}" for x in rest]
    return rows


def add_note(lines: DataFrame, xref: str, value: str) -> DataFrame:
    if not value.strip():
        raise ValueError("a note needs text")
    return inserted(lines, record_end(lines, xref), note_lines(1, value))


def edit_note(lines: DataFrame, xref: str, n: int, value: str) -> DataFrame:
    block = nth_block(lines, xref, "NOTE", n)
    kept = without(lines, subtree(lines, block))
    rows = block.select("file_id", "lineno", F.posexplode(F.array(*map(F.lit, note_lines(1, value)))).alias("k", "raw"))
    return out(kept).unionByName(rows.select("file_id", "lineno", V("k").cast("int").alias("seq"), "raw"))


def check_date(value: str | Column) -> Column:
    """The normalized date, or null where it is none."""
    v = dates.normalize_date(F.lit(value) if isinstance(value, str) else value)
    return F.when(v.rlike(dates.GRAMMAR), v)


def edit_event(lines: DataFrame, xref: str, tag: str, n: int, fields: dict[str, str]) -> DataFrame:
    """Sets or (with '') removes managed subtags of an event; others stay."""
    block = nth_block(lines, xref, tag, n)
    kids = lines.filter(V("tag").isin(*[f for f in fields if f in MANAGED])).join(block.select("file_id", "rec_no", V("lineno").alias("parent_lineno")), ["file_id", "rec_no", "parent_lineno"]).select(*lines.columns)
    left = without(lines, subtree(lines, kids))
    new = [f"2 {k} {v}" for k, v in fields.items() if v and k in MANAGED]
    return inserted(left, block.select("file_id", "lineno"), new) if new else out(left)


def add_event(lines: DataFrame, xref: str, tag: str, fields: dict[str, str]) -> DataFrame:
    fields = {k: v for k, v in fields.items() if v}
    if tag == "DEAT" and fields == {"DATE": "Y"}:
        return inserted(lines, record_end(lines, xref), ["1 DEAT Y"])
    return inserted(lines, record_end(lines, xref), [f"1 {tag}", *[f"2 {k} {v}" for k, v in fields.items()]])


def convert_event(lines: DataFrame, xref: str, tag: str, n: int, to: str) -> DataFrame:
    block = nth_block(lines, xref, tag, n).select("file_id", "lineno", F.lit(True).alias("hit"))
    rows = lines.join(block, ["file_id", "lineno"], "left")
    return out(rows, F.when(V("hit"), line(1, to, V("value"))).otherwise(V("raw")))


def add_name(lines: DataFrame, xref: str, name: str, kind: str = "AKA") -> DataFrame:
    first, _, last = name.strip().rpartition(" ")
    shown = name if "/" in name else f"{first} /{last}/".strip()
    return inserted(lines, record_end(lines, xref), [f"1 NAME {shown}", f"2 TYPE {kind}"])


def edit_name(lines: DataFrame, xref: str, n: int, name: str) -> DataFrame:
    """The n-th NAME (0: the primary) with its pieces made anew."""
    block = nth_block(lines, xref, "NAME", n)
    kids = lines.filter(V("tag").isin("GIVN", "SURN", "NSFX")).join(block.select("file_id", "rec_no", V("lineno").alias("parent_lineno")), ["file_id", "rec_no", "parent_lineno"])
    given, _, rest = name.partition("/")
    hit = block.select("file_id", "lineno", F.lit(True).alias("hit"))
    rows = without(lines, kids).join(hit, ["file_id", "lineno"], "left")
    pieces = [f"2 {t} {v.strip()}" for t, v in (("GIVN", given), ("SURN", rest.partition("/")[0])) if v.strip()]
    changed = out(rows, F.when(V("hit"), F.lit(f"1 NAME {name}")).otherwise(V("raw")))
    new = block.select("file_id", "lineno", F.posexplode(F.array(*map(F.lit, pieces))).alias("k", "raw")).select("file_id", "lineno", (V("k") + 1).cast("int").alias("seq"), "raw")
    return changed.unionByName(new)


def next_id(lines: DataFrame, prefix: str) -> DataFrame:
    """One row with the next free id of a kind."""
    number = F.max(F.regexp_extract("xref", rf"^@{prefix}(\d+)@$", 1).try_cast("long"))
    return lines.filter("level = 0").agg(F.concat(F.lit(f"@{prefix}"), (F.coalesce(number, F.lit(0)) + 1).cast("string"), F.lit("@")).alias("xref"))


def add_source(lines: DataFrame, fields: dict[str, str]) -> DataFrame:
    """A new source record before the file's end."""
    at = lines.filter("level = 0 and tag = 'TRLR'").select("file_id", (V("lineno") - 1).alias("lineno"))
    rows = at.crossJoin(F.broadcast(next_id(lines, "S"))).withColumn("raws", F.array(F.concat_ws(" ", F.lit("0"), "xref", F.lit("SOUR")), *[F.lit(f"1 {k} {v}") for k, v in fields.items() if v]))
    new = rows.select("file_id", "lineno", F.posexplode("raws").alias("k", "raw")).select("file_id", "lineno", (V("k") + 1).cast("int").alias("seq"), "raw")
    return out(lines).unionByName(new)


def edit_source(lines: DataFrame, xref: str, fields: dict[str, str]) -> DataFrame:
    own = lines.filter((V("rec_xref") == xref) & (V("level") == 1) & V("tag").isin(*fields))
    head = lines.filter((V("xref") == xref) & (V("level") == 0)).select("file_id", "lineno")
    return inserted(without(lines, subtree(lines, own)), head, [f"1 {k} {v}" for k, v in fields.items() if v])


def add_citation(lines: DataFrame, xref: str, source: str, page: str = "", tag: str | None = None, n: int = 0) -> DataFrame:
    """A citation on a person (tag None) or on the n-th block of a tag, unless it has one of that source and page."""
    level = 1 if tag is None else 2
    have = L.citations(lines.filter("level is not null")).filter((V("rec_xref") == xref) & (V("source_xref") == source) & (F.coalesce("page", F.lit("")) == page) & (V("level") == level))
    at = record_end(lines, xref) if tag is None else block_end(lines, nth_block(lines, xref, tag, n))
    if tag is not None:
        have = have.join(nth_block(lines, xref, tag, n).select("file_id", V("lineno").alias("l1_no")), ["file_id", "l1_no"])
    new = [f"{level} SOUR {source}", *([f"{level + 1} PAGE {page}"] if page else [])]
    return inserted(lines, at.join(have.select("file_id").distinct(), "file_id", "left_anti"), new)


def delete_citation(lines: DataFrame, xref: str, tag: str, n: int, m: int) -> DataFrame:
    """The m-th citation of the n-th block of a tag (tag SOUR: the person's own n-th)."""
    block = nth_block(lines, xref, tag, n)
    return out(without(lines, subtree(lines, block if tag == "SOUR" else nth_child(lines, block, "SOUR", m))))


def find_family(edges: DataFrame, one: str, other: str) -> DataFrame:
    """Families of this couple, whoever is husband."""
    by = edges.filter("role <> 'CHIL'").groupBy("file_id", "fam").agg(F.array_sort(F.collect_set("indi")).alias("couple"))
    return by.filter(V("couple") == F.array(*[F.lit(x) for x in sorted((one, other))])).select("file_id", "fam")


def add_godparent(lines: DataFrame, xref: str, godparent: str) -> DataFrame:
    """An association and its reverse."""
    one = inserted(lines, record_end(lines, xref), [f"1 ASSO {godparent}", "2 RELA Godparent"])
    back = record_end(lines, godparent).select("file_id", "lineno", F.posexplode(F.array(F.lit(f"1 ASSO {xref}"), F.lit("2 RELA Godchild"))).alias("k", "raw"))
    return one.unionByName(back.select("file_id", "lineno", (V("k") + 1).cast("int").alias("seq"), "raw"))


def delete_godparent(lines: DataFrame, xref: str, godparent: str) -> DataFrame:
    """Both directions of an association."""
    pair = ((V("rec_xref") == xref) & (F.trim("value") == godparent)) | ((V("rec_xref") == godparent) & (F.trim("value") == xref))
    return out(without(lines, subtree(lines, lines.filter((V("tag") == "ASSO") & (V("level") == 1) & pair))))


def change_parent(lines: DataFrame, child: str, family: str) -> DataFrame:
    """The child leaves its family and joins another."""
    gone = lines.filter(((V("rec_xref") == child) & (V("tag") == "FAMC")) | ((V("tag") == "CHIL") & (F.trim("value") == child)))
    left = without(lines, subtree(lines, gone))
    one = inserted(left, record_end(left, child), [f"1 FAMC {family}"])
    back = record_end(left, family).select("file_id", "lineno", F.lit(1).alias("seq"), F.lit(f"1 CHIL {child}").alias("raw"))
    return one.unionByName(back)


def add_person(lines: DataFrame, name: str, sex: str, child_of: str | None = None) -> DataFrame:
    """A new person before the file's end, and a child of a family if one is named."""
    at = lines.filter("level = 0 and tag = 'TRLR'").select("file_id", (V("lineno") - 1).alias("lineno"))
    rows = at.crossJoin(F.broadcast(next_id(lines, "I")))
    raws = [F.concat_ws(" ", F.lit("0"), "xref", F.lit("INDI")), F.lit(f"1 NAME {name}"), F.lit(f"1 SEX {sex}")]
    raws += [F.lit(f"1 FAMC {child_of}")] if child_of else []
    new = rows.select("file_id", "lineno", F.posexplode(F.array(*raws)).alias("k", "raw")).select("file_id", "lineno", (V("k") + 1).cast("int").alias("seq"), "raw")
    done = out(lines).unionByName(new)
    if child_of:
        link = record_end(lines, child_of).crossJoin(F.broadcast(next_id(lines, "I")))
        done = done.unionByName(link.select("file_id", "lineno", F.lit(1).alias("seq"), F.concat(F.lit("1 CHIL "), "xref").alias("raw")))
    return done
