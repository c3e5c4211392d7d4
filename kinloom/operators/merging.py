"""Merging one data set into another, by lines: what both say stays once, what one says only is added.

a and b are parsed lines of one file each. Lines of b move as they are, with their ids and pointers renamed, so that
nothing that is not known here is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinloom.functions import dates, text
from kinloom.operators import linkage
from kinloom.operators import rewrites as R
from kinloom.sources import lineage as L
from kinloom.staging import staged

V = F.col
#: Prefixes of new ids by record tag; other records have X.
PREFIXES = {"INDI": "I", "FAM": "F", "SOUR": "S", "REPO": "R", "OBJE": "M", "NOTE": "N", "SUBM": "U"}
#: Lines that a record has once: those of a stay unless they are empty.
SINGLE = ("SEX", "HUSB", "WIFE", "TITL", "AUTH", "PUBL", "REPO", "CHAN", "RIN", "REFN")
#: Events that a person has once, whatever their dates (fixed values).
ONCE = ("BIRT", "DEAT", "BURI")
#: Lines of b follow what is added to a block of a at the same place; two numbers a line leave room for one more.
AFTER = 1 << 30


def whole_map(a: DataFrame, b: DataFrame, matched: DataFrame) -> DataFrame:
    """matched: (xref_b, xref_a) of records of any kind. (xref_b, xref_a) for all records of b: new ids for the others."""
    heads = lambda df: df.filter("level = 0 and xref is not null").select("xref", F.when(V("tag").isin(*PREFIXES), V("tag")).otherwise("").alias("tag")).distinct()
    found = matched.join(heads(a).select(V("xref").alias("xref_a")).distinct(), "xref_a", "left_semi")
    rest = staged(heads(b).withColumnRenamed("xref", "xref_b").join(found.select("xref_b"), "xref_b", "left_anti"), "merge-new")
    out = found.select("xref_b", "xref_a")
    for tag, prefix in {**PREFIXES, "": "X"}.items():
        out = out.unionByName(linkage.id_map(found.limit(0), rest.filter(V("tag") == tag), prefix))
    return out


def renamed(b: DataFrame, ids: DataFrame) -> DataFrame:
    """b's lines with the ids of the map; pointers to records that the map has not stay as they are."""
    to = lambda key, new: ids.select(V("xref_b").alias(key), V("xref_a").alias(new))
    rows = b.filter("level is not null and rec_xref <> ''").join(to("rec_xref", "own"), "rec_xref").drop("rec_xref").withColumnRenamed("own", "rec_xref")
    points = (V("level") > 0) & L.is_pointer()
    linked = rows.filter(points).withColumn("key", F.trim("value")).join(to("key", "target"), "key", "left").drop("key")
    raw = R.line(V("level"), V("tag"), V("target"))
    linked = linked.withColumn("raw", F.when(V("target").isNull(), V("raw")).otherwise(raw)).withColumn("value", F.coalesce("target", "value")).drop("target")
    head = F.concat_ws(" ", F.lit("0"), "rec_xref", "tag", F.nullif("value", F.lit("")))
    plain = rows.filter(~points).withColumn("raw", F.when(V("level") == 0, head).otherwise(V("raw")))
    return plain.unionByName(linked)


def blocks(lines: DataFrame, side: int) -> DataFrame:
    """A row for each level-1 line with what stands under it; cites and page are those of the line itself."""
    first = lambda tag: F.min_by(F.trim("value"), F.when((V("level") == 2) & (V("tag") == tag), V("lineno")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lineno", F.trim("raw").alias("raw")))), lambda x: x["raw"]), "\n")
    rows = lines.filter("l1_no is not null and level is not null").groupBy("rec_xref", "rec_tag", "l1_no").agg(
        F.max(F.when(V("level") == 1, V("tag"))).alias("tag"), F.max(F.when(V("level") == 1, F.trim("value"))).alias("value"), whole.alias("whole"), F.max("lineno").alias("end"),
        F.count_if((V("level") == 2) & (V("tag") == "SOUR")).alias("cites"), *[first(t).alias(c) for t, c in (("TYPE", "type"), ("DATE", "date_raw"), ("PLAC", "place"), ("PAGE", "page"))],
    )
    return rows.withColumn("side", F.lit(side)).withColumn("date", dates.parse_date(F.coalesce("date_raw", F.lit(""))))


def event_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: blocks of events. (a, b, what): the l1_no of events that are one, and what comes of them. Each event of a
    takes the first of b that is left, of its tag and type, and of a date like its own unless the event is had once.

    what is exact_a or exact_b where one date is exact and the other about the same, both_a or both_b where years are
    more than two apart (the better sourced one is named), else merge."""
    keys = ["rec_xref", "tag", "kind"]
    of = lambda df, name: df.groupBy("rec_xref", "tag", F.coalesce("type", F.lit("")).alias("kind")).agg(F.array_sort(F.collect_list(F.struct("l1_no", "date"))).alias(name))
    alike = lambda x, y: V("tag").isin(*ONCE) | (x["date"].isNull() & y["date"].isNull()) | (dates.date_overlap(x["date"], y["date"]) >= 0.5)

    def taken(acc: Column, x: Column) -> Column:
        y = F.get(F.filter("bs", lambda y: alike(x, y) & ~F.exists(acc, lambda p: p["b"] == y["l1_no"])), F.lit(0))
        return F.when(y.isNull(), acc).otherwise(F.concat(acc, F.array(F.struct(x["l1_no"].alias("a"), y["l1_no"].alias("b")))))

    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    pairs = of(a, "as_").join(of(b, "bs"), keys).select(F.explode(F.aggregate("as_", none, taken)).alias("p")).select("p.*")
    side = lambda df, s: df.select(V("l1_no").alias(s), *[V(c).alias(f"{c}_{s}") for c in ("rec_xref", "end", "date", "date_raw", "place", "cites")])
    rows = pairs.join(side(a, "a"), "a").join(side(b, "b"), "b")
    years, about = [V(f"date_{s}")["year"] for s in "ab"], [V(f"date_{s}")["qualifier"].isNotNull() for s in "ab"]
    both = years[0].isNotNull() & years[1].isNotNull()
    exact = both & (about[0] != about[1]) & (dates.date_overlap(V("date_a"), V("date_b")) >= 0.4)
    far = both & (F.abs(years[0] - years[1]) > 2)
    what = F.when(exact, F.when(about[0], "exact_b").otherwise("exact_a")).when(far, F.when(V("cites_a") >= V("cites_b"), "both_a").otherwise("both_b")).otherwise("merge")
    return rows.withColumn("what", what)


def _edits(pairs: DataFrame, side: str) -> DataFrame:
    """(l1_no, new_date, new_place, alternate): what changes in the events of a side that stay."""
    what = V("what")
    date = F.when((what == "merge") & (dates.specificity(V("date_b")) > dates.specificity(V("date_a"))), V("date_b_raw")) if side == "a" else F.lit(None).cast("string")
    place = F.when(what.isin("merge", f"exact_{side}"), linkage.prefer_place(V("place_a"), V("place_b")))
    rows = pairs.withColumnsRenamed({"date_raw_b": "date_b_raw"})
    other = "b" if side == "a" else "a"
    return rows.select(V(side).alias("l1_no"), date.alias("new_date"), F.nullif(place, F.lit("")).alias("new_place"), (what == f"both_{other}").alias("alternate"))


def _edited(lines: DataFrame, edits: DataFrame, base: Column) -> DataFrame:
    """lines of blocks, their events changed, as (l1_no, lineno, seq, raw); seq counts from base, two for each line."""
    plain = lines.join(edits.select("l1_no"), "l1_no", "left_anti").select("l1_no", "lineno", base.alias("seq"), "raw")
    rows = lines.join(edits, "l1_no")
    two = lambda tag: (V("level") == 2) & (V("tag") == tag)
    alternate = F.coalesce("alternate", F.lit(False))
    raw = F.when(two("DATE") & V("new_date").isNotNull(), R.line(2, "DATE", V("new_date"))).when(two("PLAC") & V("new_place").isNotNull(), R.line(2, "PLAC", V("new_place"))).otherwise(V("raw"))
    has = lambda c: F.coalesce(F.bool_or(c).over(W.partitionBy("l1_no")), F.lit(False))
    rows = rows.withColumn("dated", has(two("DATE"))).withColumn("placed", has(two("PLAC"))).withColumn("seq", base)
    more = F.filter(F.array(
        F.when(V("new_date").isNotNull() & ~V("dated"), R.line(2, "DATE", V("new_date"))), F.when(V("new_place").isNotNull() & ~V("placed"), R.line(2, "PLAC", V("new_place"))), F.when(alternate, F.lit("2 TYPE alternate")),
    ), lambda x: x.isNotNull())
    kept = rows.filter(~(alternate & two("TYPE"))).select("l1_no", "lineno", "seq", raw.alias("raw"))
    # two lines are added at most to an event of a, whose numbers have room, and one to an event of b
    added = rows.filter("level = 1").select("l1_no", "lineno", "seq", F.posexplode(more).alias("n", "line"))
    return plain.unionByName(kept).unionByName(added.select("l1_no", "lineno", (V("seq") + V("n") + 1).alias("seq"), V("line").alias("raw")))


def merged(a: DataFrame, b: DataFrame, ids: DataFrame) -> DataFrame:
    """The lines of a with those of b merged in, as (file_id, lineno, seq, raw). ids: as whole_map gives them.

    Records of b with an id that a has none of come before the trailer. Of records that both have, a's lines stay;
    b's that are new follow: names by given name and surname (as AKA if they have no type), links, notes and others
    by their text, citations by source and page (the longer page stays), single lines where a has none or an empty
    one. Events that are one are merged as event_pairs says. Without records in b, a comes out as it is."""
    ends = F.coalesce(F.min(F.when((V("level") == 0) & (V("tag") == "TRLR"), V("lineno"))), F.max("lineno") + 1)
    file_id, trailer = a.agg(F.first("file_id"), ends).first()
    a = staged(a, "merge-a")
    b = staged(renamed(b, ids), "merge-b")
    heads = a.filter("level = 0 and xref is not null").select(V("xref").alias("rec_xref"), "rec_no")
    known = a.filter("rec_xref <> ''").groupBy("rec_xref").agg(F.max("lineno").alias("rec_end"))
    new = b.join(heads, "rec_xref", "left_anti").select(F.lit(trailer).alias("lineno"), V("lineno").alias("seq"), "raw")
    own, theirs = a.join(b.select("rec_xref").distinct(), "rec_xref", "left_semi"), b.join(known, "rec_xref", "left_semi")
    both = staged(blocks(own, 0).unionByName(blocks(theirs, 1)), "merge-blocks")

    is_event, is_citation = V("tag").isin(*L.EVENT_TAGS) & V("rec_tag").isin("INDI", "FAM"), (V("tag") == "SOUR") & L.is_pointer()
    events = both.filter(is_event)
    pairs = staged(event_pairs(events.filter("side = 0"), events.filter("side = 1")), "merge-events")
    cited = both.filter(is_citation & ~is_event).select("side", V("l1_no").alias("at"), V("rec_xref").alias("owner"), V("l1_no").alias("ord"), V("value").alias("source"), "page")
    kept_citations = linkage.merge_citations(cited).select("side", V("at").alias("l1_no"))

    part = text.name_parts(V("value"))
    single = V("tag").isin(*SINGLE)
    key = F.when(single, "").when(V("tag") == "NAME", F.concat_ws("/", part["given"], part["surname"])).otherwise(V("whole"))
    order = W.partitionBy("rec_xref", "tag", "key").orderBy(V("value") == "", "side", "l1_no")
    rest = both.filter(~is_event & ~is_citation).withColumn("key", key).withColumn("n", F.row_number().over(order))
    rest = rest.filter((V("n") == 1) | ((V("side") == 0) & ~single & (V("tag") != "NAME"))).select("side", "l1_no")
    lone = events.join(pairs.select(F.lit(1).alias("side"), V("b").alias("l1_no")), ["side", "l1_no"], "left_anti").filter("side = 1").select("side", "l1_no")
    stay_a = events.filter("side = 0").join(pairs.filter("what = 'exact_b'").select(V("a").alias("l1_no")), "l1_no", "left_anti").select("side", "l1_no")
    stay = staged(rest.unionByName(kept_citations).unionByName(lone).unionByName(stay_a), "merge-stay")

    # a: lines of other records and heads stay; of merged records the blocks that stay
    gone = both.filter("side = 0").select("l1_no").join(stay.filter("side = 0").select("l1_no"), "l1_no", "left_anti")
    in_block = V("l1_no").isNotNull() & V("level").isNotNull()
    mine = _edited(a.filter(in_block).join(gone, "l1_no", "left_anti"), _edits(pairs, "a"), F.lit(0).cast("long")).drop("l1_no")
    mine = mine.unionByName(a.filter(~in_block).select("lineno", F.when(V("lineno") == trailer, F.lit(2**31 - 1)).otherwise(0).cast("long").alias("seq"), "raw"))

    # b: blocks of their own at the record's end, events where the one of a is, citations under it
    ends = theirs.join(stay.filter("side = 1").select("l1_no"), "l1_no").join(known, "rec_xref").withColumn("at", V("rec_end"))
    place = F.when(V("what") == "both_b", V("a") - 1).otherwise(V("end_a"))
    moved = theirs.join(pairs.filter("what in ('exact_b', 'both_a', 'both_b')").select(V("b").alias("l1_no"), place.alias("at")), "l1_no")
    added = ends.drop("rec_end").unionByName(moved)
    texts = _edited(added, _edits(pairs, "b"), V("lineno") * 2 + AFTER).join(added.select("l1_no", "at").distinct(), "l1_no")
    untyped = both.filter("side = 1 and tag = 'NAME' and type is null").join(stay.filter("side = 1"), ["side", "l1_no"]).join(known, "rec_xref")
    aka = untyped.select(V("rec_end").alias("lineno"), (V("l1_no") * 2 + 1 + AFTER).alias("seq"), F.lit("2 TYPE AKA").alias("raw"))

    inside = W.partitionBy("l1_no").orderBy("lineno").rowsBetween(W.unboundedPreceding, 0)
    cut = lambda df: df.withColumn("l2_no", F.last(F.when(V("level") == 2, V("lineno")), ignorenulls=True).over(inside))
    couples = pairs.filter("what = 'merge'").select("a", "b", "end_a")
    lines_a = cut(own.join(couples.select(V("a").alias("l1_no"), "a", "end_a"), "l1_no").withColumn("side", F.lit(0)))
    lines_b = cut(theirs.join(couples.select(V("b").alias("l1_no"), "a", "end_a"), "l1_no").withColumn("side", F.lit(1)))
    columns = ["side", "a", "end_a", "l2_no", "lineno", "level", "tag", "value", "raw"]
    under = staged(lines_a.select(columns).unionByName(lines_b.select(columns)).filter("l2_no is not null"), "merge-cited")
    one = under.groupBy("side", "a", "l2_no").agg(F.max(F.when(V("lineno") == V("l2_no"), V("tag"))).alias("tag"), F.max(F.when(V("lineno") == V("l2_no"), F.trim("value"))).alias("source"), F.min_by("value", F.when((V("level") == 3) & (V("tag") == "PAGE"), V("lineno"))).alias("page"))
    one = one.filter("tag = 'SOUR'").withColumn("owner", V("a")).withColumn("ord", V("l2_no"))
    kept = linkage.merge_citations(one).select("side", "a", "l2_no")
    more = under.join(kept.filter("side = 1"), ["side", "a", "l2_no"]).select(V("end_a").alias("lineno"), (V("lineno") + 2).alias("seq"), "raw")
    shorter = one.filter("side = 0").join(kept, ["side", "a", "l2_no"], "left_anti")
    shorter = under.join(shorter.select("side", "a", "l2_no"), ["side", "a", "l2_no"]).select("lineno", "raw")
    mine = mine.join(shorter, ["lineno", "raw"], "left_anti")

    out = mine.unionByName(new).unionByName(texts.select(V("at").alias("lineno"), "seq", "raw")).unionByName(aka).unionByName(more)
    return out.select(F.lit(file_id).alias("file_id"), "lineno", V("seq").cast("int").alias("seq"), "raw")
