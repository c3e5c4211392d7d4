"""Rewrites of whole records: families that are one, families that say nothing, sources and media.

As in ``rewrites``, each takes parsed lines and returns the whole file as (file_id, lineno, seq, raw).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinloom.functions import dates
from kinloom.operators import rewrites as R
from kinloom.sources import lineage as L
from kinloom.staging import staged

V = F.col
URL = r"(?i)^(https?|ftps?)://"
FILE, RECORD = ["file_id"], ["file_id", "rec_no"]


def family_contents(lines: DataFrame) -> DataFrame:
    """(file_id, rec_no, xref, husb, wife, events, children, citations) of each family record; no spouse is ''."""
    rows = lines.filter("rec_tag = 'FAM' and level <= 1")
    last = lambda tag: F.coalesce(F.max_by(F.trim("value"), F.when(V("tag") == tag, V("lineno"))), F.lit(""))
    at_one = V("level") == 1
    return rows.groupBy("file_id", "rec_no", V("rec_xref").alias("xref")).agg(
        last("HUSB").alias("husb"), last("WIFE").alias("wife"), F.count_if(at_one & V("tag").isin(*L.EVENT_TAGS)).alias("events"),
        F.count_if(at_one & (V("tag") == "CHIL")).alias("children"), F.count_if(at_one & (V("tag") == "SOUR")).alias("citations"),
    )


def duplicates(families: DataFrame) -> DataFrame:
    """Families of one couple but for the one that stands for them: (file_id, rec_no, xref, keeper, keeper_xref).

    The one that stays is not newly numbered, has the most events, children and citations, and is the first."""
    order = W.partitionBy("file_id", "husb", "wife").orderBy(V("xref").contains("_MERGE_"), -(V("events") + V("children") + V("citations")), "rec_no")
    first = lambda c: F.first(c).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = families.filter("husb <> '' or wife <> ''").withColumn("keeper", first("rec_no")).withColumn("keeper_xref", first("xref"))
    return rows.filter("rec_no <> keeper").select("file_id", "rec_no", "xref", "keeper", "keeper_xref")


def _united(lines: DataFrame, gone: DataFrame) -> DataFrame:
    """Lines for the keepers' ends: the events, children and citations of the duplicates that the keeper has not."""
    members = gone.select("file_id", "rec_no", "keeper").unionByName(gone.select("file_id", V("keeper").alias("rec_no"), "keeper").distinct())
    own = lines.filter("level is not null and rec_tag = 'FAM'").join(members, RECORD)
    year = dates.parse_date(F.coalesce("date_raw", F.lit("")))["year"].cast("string")
    part = lambda df, kind, *key: df.select(*RECORD, V("l1_no"), F.lit(kind).alias("kind"), F.array(*[F.coalesce(k, F.lit("")) for k in key]).alias("key"))
    blocks = part(L.events(own), 0, V("tag"), V("type"), year)
    blocks = blocks.unionByName(part(own.filter("level = 1 and tag = 'CHIL'"), 1, F.trim("value")))
    blocks = blocks.unionByName(part(L.citations(own).filter("level = 1"), 2, V("source_xref"), V("page")))
    blocks = blocks.join(members, RECORD)
    nth = F.row_number().over(W.partitionBy("file_id", "keeper", "kind", "key").orderBy(V("rec_no") != V("keeper"), "rec_no", "l1_no"))
    moved = blocks.withColumn("nth", nth).filter("nth = 1 and rec_no <> keeper").select(*RECORD, "l1_no", "kind")
    ends = lines.join(gone.select("file_id", V("keeper").alias("rec_no")).distinct(), RECORD).groupBy("file_id", V("rec_no").alias("keeper")).agg(F.max("lineno").alias("end"))
    new = own.join(moved, [*RECORD, "l1_no"]).join(ends, ["file_id", "keeper"])
    seq = F.row_number().over(W.partitionBy("file_id", "end").orderBy("kind", "lineno"))
    return new.withColumn("seq", seq).select("file_id", V("end").alias("lineno"), "seq", "raw")


@R.fix("duplicate_families")
def duplicate_families(lines: DataFrame) -> DataFrame:
    """Families of one couple become one, with the events (by tag, type and year), children and citations (by source
    and page) of all; members point to it, each once. In files that had such families, empty ones go too.

    What else a duplicate holds (its notes, say) goes with it. A repeated xref is mapped if no record of it stays."""
    families = family_contents(lines)
    gone = staged(duplicates(families), "duplicate-families")
    united = _united(lines, gone)
    left = families.join(gone.select(*RECORD), RECORD, "left_anti").select("file_id", "xref").distinct()
    to = gone.join(left, ["file_id", "xref"], "left_anti").groupBy("file_id", V("xref").alias("target")).agg(F.min("keeper_xref").alias("to"))
    kept = lines.join(gone.select(*RECORD), RECORD, "left_anti")
    links = kept.filter("rec_tag = 'INDI' and level = 1 and tag in ('FAMS', 'FAMC')").withColumn("target", F.trim("value"))
    links = links.join(gone.select("file_id").distinct(), FILE, "left_semi").join(to, ["file_id", "target"], "left")
    nth = F.row_number().over(W.partitionBy(*RECORD, "tag", F.coalesce("to", "target")).orderBy("lineno"))
    links = links.select(*RECORD, "lineno", "to", nth.alias("nth"))
    again = R.subtree(kept, links.filter("nth > 1"))
    rows = R.without(kept, again).join(links.filter("nth = 1 and to is not null").select("file_id", "lineno", "to"), ["file_id", "lineno"], "left")
    after = R.out(rows, F.when(V("to").isNotNull(), R.with_value(V("to"))).otherwise(V("raw"))).unionByName(united)
    after = staged(after, "united-families")
    touched = gone.select("file_id").distinct()
    now = R.renumbered(after.join(touched, FILE, "left_semi"))
    # the numbers of lines that empty families take along, as they were before the new numbering
    numbers = after.withColumn("n", F.row_number().over(W.partitionBy("file_id").orderBy("lineno", "seq")).cast("long"))
    dead = empty_lines(now).select("file_id", V("lineno").alias("n"))
    return numbers.join(dead.join(touched, FILE, "left_semi"), ["file_id", "n"], "left_anti").select("file_id", "lineno", "seq", "raw")


def empty_lines(lines: DataFrame) -> DataFrame:
    """The lines of families with a spouse and no event, child or citation, and of the pointers to them. One that is
    a spouse's only link to a family stays, and so does one whose xref another record has."""
    families = family_contents(lines).withColumn("n", F.count("*").over(W.partitionBy("file_id", "xref")))
    shells = families.filter("(husb <> '' or wife <> '') and events + children + citations = 0 and n = 1").select("file_id", "rec_no", "xref", "husb", "wife")
    links = lines.filter("rec_tag = 'INDI' and level = 1 and tag in ('FAMS', 'FAMC')").select(*RECORD, "rec_xref", "lineno", "tag", F.trim("value").alias("xref"))
    people = lines.filter("level = 0 and tag = 'INDI'").select("file_id", V("rec_xref").alias("indi")).distinct()
    spouse = shells.select("file_id", "xref", F.explode(F.array_distinct(F.filter(F.array("husb", "wife"), lambda x: x != ""))).alias("indi")).join(people, ["file_id", "indi"])
    # any other link: a family as a child, or as a spouse of another family
    own = links.select("file_id", V("rec_xref").alias("indi"), "tag", V("xref").alias("other"))
    held = spouse.join(own, ["file_id", "indi"], "left").groupBy("file_id", "xref", "indi").agg(F.count_if((V("tag") == "FAMC") | (V("other") != V("xref"))).alias("others"))
    alone = held.filter("others = 0").select("file_id", "xref").distinct()
    dead = shells.join(alone, ["file_id", "xref"], "left_anti")
    refs = links.join(dead.select("file_id", "xref"), ["file_id", "xref"], "left_semi")
    return lines.join(dead.select(*RECORD), RECORD, "left_semi").select("file_id", "lineno").unionByName(R.subtree(lines, refs).select("file_id", "lineno"))


@R.fix("empty_families")
def empty_families(lines: DataFrame) -> DataFrame:
    return R.out(R.without(lines, empty_lines(lines)))


def merge_sources(lines: DataFrame, keep: str, remove: str) -> DataFrame:
    """One source in another's place: citations of ``remove`` become those of ``keep``, of an owner's citations of one
    source and page the first stays (an owner is a record, an event or a name), and the record goes. Files that
    have not both records stay as they are."""
    both = lines.filter((V("level") == 0) & (V("tag") == "SOUR") & V("rec_xref").isin(keep, remove)).groupBy("file_id").agg(F.count_distinct("rec_xref").alias("n")).filter("n = 2").select("file_id")
    kept = lines.join(both.withColumn("has", F.lit(True)), FILE, "left").withColumn("has", F.coalesce("has", F.lit(False)))
    kept = kept.filter(~(V("has") & (V("rec_tag") == "SOUR") & (V("rec_xref") == remove)))
    target = F.when(V("has") & (V("tag") == "SOUR") & (V("level") > 0) & (F.trim("value") == remove), F.lit(keep))
    mapped = kept.withColumn("raw", F.coalesce(R.with_value(target), V("raw"))).withColumn("value", F.coalesce(target, V("value")))
    cited = L.citations(mapped.filter(V("has") & V("level").isNotNull()).filter(V("rec_tag").isin("INDI", "FAM")))
    cited = cited.join(mapped.select("file_id", "lineno", "parent_lineno"), ["file_id", "lineno"])
    nth = F.row_number().over(W.partitionBy("file_id", "rec_no", "parent_lineno", "source_xref", F.coalesce("page", F.lit(""))).orderBy("lineno"))
    again = cited.withColumn("nth", nth).filter("nth > 1").select(*RECORD, "lineno")
    return R.out(R.without(mapped, R.subtree(mapped, again)))


def files_below(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the files below a folder, plain paths for local ones; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select(plain_path(F.regexp_replace("path", "^file:/+", "/")).alias("path"))


def plain_path(path: Column) -> Column:
    """A path without '.', '..' and doubled slashes; a scheme stays as it is."""
    scheme = F.regexp_extract(path, r"^[a-z0-9]+://[^/]*", 0)
    rest = F.split(F.substr(path, F.char_length(scheme) + 1), "/")
    up = lambda seen, x: F.when(x == "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0)))).otherwise(F.array_append(seen, x))
    steps = F.aggregate(F.filter(rest, lambda x: ~x.isin("", ".")), F.array().cast("array<string>"), up)
    return F.concat(scheme, F.lit("/"), F.array_join(steps, "/"))


def missing_media(lines: DataFrame, present: DataFrame, folder: Column) -> DataFrame:
    """(file_id, rec_no, lineno, xref, path): the media blocks whose first FILE is empty or no file that is present.

    present: (path), as ``files_below`` gives it; folder: where relative names of a file's lines start. Web addresses
    are never missing; media records, and blocks in other records that are not in another media block, count."""
    heads = lines.filter(V("level").isNotNull() & (V("tag") == "OBJE") & (F.coalesce(F.trim("value"), F.lit("")) == ""))
    heads = heads.filter("(level = 0 and xref is not null) or (level > 0 and rec_tag <> 'OBJE' and xref is null)")
    later = lines.filter("level is not null").select(*RECORD, "l1_no", V("lineno").alias("at"), V("level").alias("depth"), V("tag").alias("kid"), F.trim(F.coalesce("value", F.lit(""))).alias("file"))
    # a block ends in its level-1 block, that of a record with the record
    heads = heads.select(*RECORD, "l1_no", "lineno", "level", "xref")
    top = heads.filter("level = 0").join(later.drop("l1_no"), RECORD)
    inner = heads.filter("level > 0").join(later, [*RECORD, "l1_no"])
    below = top.unionByName(inner).filter((V("at") > V("lineno")) & ((V("kid") == "FILE") | (V("depth") <= V("level"))))
    found = below.groupBy(*RECORD, "l1_no", "lineno", "xref").agg(F.min(F.when(V("depth") <= V("level"), V("at"))).alias("end"), F.min(F.when((V("kid") == "FILE") & (V("depth") > V("level")), F.struct("at", "file"))).alias("first"))
    found = found.filter(V("first").isNotNull() & (V("end").isNull() | (V("first.at") < V("end"))))
    outer = F.max(F.coalesce("end", F.lit(2**62))).over(W.partitionBy(*RECORD, "l1_no").orderBy("lineno").rowsBetween(W.unboundedPreceding, -1))
    found = found.withColumn("outer", outer).filter("outer is null or lineno >= outer")
    name = V("first.file")
    found = found.select(*RECORD, "lineno", "xref", name.alias("path")).filter(~name.rlike(URL))
    full = plain_path(F.when(V("path").rlike(r"^(/|[a-z0-9]+://)"), V("path")).otherwise(F.concat(folder, F.lit("/"), "path")))
    there = present.select(V("path").alias("full")).distinct()
    return found.withColumn("full", F.when(V("path") != "", full)).join(there, ["full"], "left_anti").select(*RECORD, "lineno", "xref", "path")


def without_missing_media(lines: DataFrame, present: DataFrame, folder: Column) -> DataFrame:
    """Media blocks with missing files go, and so do the pointers to records that went."""
    bad = missing_media(lines, present, folder)
    dead = bad.filter("xref is not null").select("file_id", V("xref").alias("target"))
    refs = L.pointers(lines.filter("level is not null")).filter("tag = 'OBJE' and rec_tag <> 'OBJE'").join(dead, ["file_id", "target"], "left_semi")
    roots = bad.select(*RECORD, "lineno").unionByName(refs.select(*RECORD, "lineno"))
    return R.out(R.without(lines, R.subtree(lines, roots)))
