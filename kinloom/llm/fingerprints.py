"""Document fingerprints (native): a threshold-scaled sketch of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so that a long document has
a long sketch: the sketches of two texts hold the same part of either, and the share of one in the other
estimates containment even between very unequal texts. Sketches merge by union. A text whose hashes are
all above the threshold keeps its least one, and a text without words has the empty sketch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinloom.llm.common import BLANKS, bind

SHINGLE = 5
#: Hashes have 63 bits; those below 2**60, an eighth, are kept.
KEEP_BITS = 60
_ALL = 2**63 - 1
#: Documents of one range of 2**RANGE_BITS ids are sorted together; 2**GROUP_BITS ranges make a group.
RANGE_BITS, GROUP_BITS = 8, 12


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """A 63-bit hash of each run of ``size`` lower-cased words, repeats included; fewer words make one
    shingle, none make none. Null counts as empty."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"[{BLANKS}]+"), lambda w: w != "")

    def hashes(h: Column) -> Column:
        one = lambda i: F.xxhash64(*[F.get(h, i + F.lit(k)) for k in range(size)]).bitwiseAND(F.lit(_ALL))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - F.lit(size), F.lit(0))), one))

    return bind(F.transform(words, lambda w: F.xxhash64(w)), hashes)


def sketch(text: Column, size: int = SHINGLE, keep_bits: int = KEEP_BITS) -> Column:
    """The sorted array of kept hashes."""

    def kept(h: Column) -> Column:
        low = F.filter(h, lambda x: x < F.lit(2**keep_bits))
        return bind(low, lambda x: F.when((F.size(x) > 0) | (F.size(h) == 0), F.array_sort(F.array_distinct(x))).otherwise(F.array(F.array_min(h))))

    return bind(shingle_hashes(text, size), kept)


def merged(a: Column, b: Column, keep_bits: int = KEEP_BITS) -> Column:
    """The sketch of two texts' shingles together. A hash above the threshold stays only while it is the least."""
    return bind(F.array_sort(F.array_union(a, b)), lambda u: F.filter(u, lambda x: (x < F.lit(2**keep_bits)) | (x == F.array_min(u))))


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard estimate, 0 to 1; two empty sketches are alike."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """The estimated share of a's shingles that b has; all of an empty one."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_string(sketch: Column) -> Column:
    """16 hexadecimal digits for each hash, in order."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame, extra: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """docs: (doc_id long, text string), both without nulls. Adds extra, made of the text, and next_text and
    next_extra: those of the next document in descending doc_id, after the last those of the first. Rows with one id follow each other by the hash
    of their text.

    Each id range is sorted on its own; a copy of the first row of the range below stands at its end.
    """
    docs = docs.select("doc_id", text, F.shiftright("doc_id", RANGE_BITS).alias("range"))
    tops = docs.groupBy("range").agg(F.max("doc_id").alias("top")).withColumn("group", F.shiftright("range", GROUP_BITS))
    of_group = tops.groupBy("group").agg(F.max("top").alias("group_top"))
    down = W.orderBy(F.col("group").desc())
    # a row for each 2**(RANGE_BITS + GROUP_BITS) ids
    of_group = of_group.select("group", F.coalesce(F.lead("group_top").over(down), F.max("group_top").over(W.partitionBy())).alias("below"))
    inside = tops.withColumn("in_group", F.lead("top").over(W.partitionBy("group").orderBy(F.col("range").desc())))
    ends = inside.join(of_group, "group").select(F.col("range").alias("to"), F.coalesce("in_group", "below").alias("top_id"))
    heads = docs.join(ends.select("top_id").distinct(), F.col("doc_id") == F.col("top_id")).groupBy("top_id").agg(F.min_by(text, F.xxhash64(text)).alias(text))
    ghosts = ends.join(heads, "top_id").select(F.lit(None).cast("long").alias("doc_id"), text, F.col("to").alias("range"), F.lit(1).alias("ghost"))
    rows = docs.withColumn("ghost", F.lit(0)).unionByName(ghosts)
    order = W.partitionBy("range").orderBy("ghost", F.col("doc_id").desc(), F.xxhash64(text))
    rows = rows.repartition("range").select("*", extra(F.col(text)).alias("extra"))
    following = F.lead(F.struct(text, "extra")).over(order)
    return rows.withColumn("next", following).filter("ghost = 0").select("doc_id", text, "extra", F.col("next")[text].alias("next_text"), F.col("next")["extra"].alias("next_extra"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text), other columns are ignored. A row for each document with the fingerprints of its
    text, of its edited text (the last third of the code points replaced by as many of the next document's
    first) and how alike they and the next document's are.

    Null text counts as empty; a null doc_id stands below all others and comes out as null; equal texts have
    equal fingerprints; texts without words have the empty fingerprint, alike only to itself (1.0, else 0.0);
    a sole document is its own next one; an empty table gives an empty result.
    """
    least = -(2**62)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, sketch).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next_text", F.lit(1), cut))
    rows = rows.select(F.when(F.col("doc_id") != least, F.col("doc_id")).alias("doc_id"), "n_chars", edited.alias("edited"), "extra", "next_extra")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "extra", sketch(F.col("edited")).alias("edit"), "next_extra")
    own, edit, following = F.col("extra"), F.col("edit"), F.col("next_extra")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_string(own).alias("fingerprint"), as_string(edit).alias("edited_fingerprint"),
        likeness(own, edit).alias("near_edited"), likeness(own, following).alias("near_next"), containment(own, edit).alias("contained_in_edited"),
    )
