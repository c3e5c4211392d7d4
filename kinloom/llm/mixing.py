"""Mixing sources to target weights (native): fixed-length blocks, multinomial draws for each output
shard, and a pseudorandom permutation of block numbers for each source and pass.

All steps are DataFrame operations. The words of a source's documents, in the order of document ids,
form one stream that is cut into blocks of ``block`` words. An output shard has ``shard_slots`` slots;
each slot draws a ticket, and the ticket's owner is the slot's source, so that a shard's counts by
source are multinomial. The k-th slot that a source has drawn, over all shards, takes the block that
the source's permutation puts at k modulo its blocks. Draws beyond a source's share are void and draws
that it lacks go to shards at the end, so that each source ends within a block of its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinloom.llm.common import BLANKS, WORD, bind, fresh, staged

WEIGHTS = (3, 1, 2)
RATIO = 1.5
CAP = 2
BLOCK = 32
SHARD_SLOTS = 4096
#: Slots that a task makes, and how many tasks make them at most.
TASK_SLOTS, MOST_TASKS = 1 << 19, 100_000
#: Steps of cycle walking. Up to 400 blocks as many always suffice; beyond, one step leaves the range
#: with a chance under 1/20, so that 20 steps do with a chance under 1e-26.
WALK = 20
#: A word with the blanks before it; the last also has those after it.
PIECE = f"[{BLANKS}]*{WORD}(?:[{BLANKS}]+\\z)?"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, cap: int = CAP) -> DataFrame:
    """sizes: (source, source_size), a row for each source. Adds rank (by code point, null last), weight
    and target.

    Shares by weight of ratio times all sizes, where no share goes beyond cap times its source's size:
    a source is full if the level that the sources with a lower cap / weight leave, is above its own.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    full = F.col("cap") / F.col("weight")
    before = W.orderBy(full, "rank").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    level = (F.lit(float(ratio)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    levelled = (
        sizes.select("source", "source_size", rank.alias("rank"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * cap)
        .withColumn("level", level)
        # the first source in this order that is not full fixes the level for the rest
        .withColumn("open", F.min(F.when(F.col("level") < full, F.struct(full.alias("f"), F.col("rank").alias("r"), F.col("level").alias("l")))).over(every)["l"])
    )
    share = F.coalesce(F.col("open") * F.col("weight"), F.col("cap").cast("double"))
    return levelled.select("source", "source_size", "rank", "weight", F.least(share, F.col("cap").cast("double")).alias("target"))


def streams(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, source, size, tie). Adds start, the words before a document in its source's stream.

    Sums of sums over id ranges: a source with a third of all rows is dealt over its id ranges.
    """
    c1, c2 = F.shiftright("doc_id", 10), F.shiftright("doc_id", 20)
    rows = docs.select("doc_id", "source", "size", "tie", c1.alias("c1"), c2.alias("c2"))
    first = rows.withColumn("in_c1", F.sum("size").over(W.partitionBy("source", "c1").orderBy(F.col("doc_id").asc_nulls_last(), "tie").rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    sums1 = rows.groupBy("source", "c2", "c1").agg(F.sum("size").alias("s1"))
    second = sums1.withColumn("in_c2", F.sum("s1").over(W.partitionBy("source", "c2").orderBy(F.col("c1").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)) - F.col("s1"))
    sums2 = sums1.groupBy("source", "c2").agg(F.sum("s1").alias("s2"))
    third = sums2.withColumn("before", F.sum("s2").over(W.partitionBy("source").orderBy(F.col("c2").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)) - F.col("s2"))
    offsets = second.alias("a").join(third.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & F.col("a.c2").eqNullSafe(F.col("b.c2")))
    offsets = offsets.select(F.col("a.source").alias("source"), F.col("a.c1").alias("c1"), (F.col("in_c2") + F.col("before")).alias("offset"))
    both = first.alias("a").join(offsets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & F.col("a.c1").eqNullSafe(F.col("b.c1")))
    return both.select("a.doc_id", "a.source", "a.size", "a.tie", (F.col("in_c1") + F.col("offset")).alias("start"))


def _permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of x in a pseudorandom permutation of 0..n-1: alternating modular additions on the two
    digits of x in mixed base (a, b), a * b >= n, applied until the value is below n."""

    def once(x: Column, a: Column, b: Column) -> Column:
        add = lambda to, by, base, k: F.pmod(to + F.pmod(F.xxhash64(by, F.lit(k), *key), base), base)
        digits = lambda l, r: F.struct(l.alias("l"), r.alias("r"))
        out = digits(F.floor(x / b).cast("long"), F.pmod(x, b))
        for k in range(0, 4, 2):
            out = bind(out, lambda d, k=k: digits(add(d["l"], d["r"], a, k), d["r"]))
            out = bind(out, lambda d, k=k: digits(d["l"], add(d["r"], d["l"], b, k + 1)))
        return bind(out, lambda d: d["l"] * b + d["r"])

    def walk(base: Column) -> Column:
        step = lambda y, i: F.when((i > 1) & (y < n), y).otherwise(once(y, base["a"], base["b"]))
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), x, step)

    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1))
    return bind(bind(a, lambda v: F.struct(v.alias("a"), F.ceil(n / v).cast("long").alias("b"))), walk)


def slots(targets: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """targets: as source_targets gives them. Returns (shard, rank, k, block): the k-th slot of a source
    takes this block. The only number that the driver reads is the count of all slots."""
    spark = targets.sparkSession
    n = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    size = F.greatest("source_size", F.lit(1))
    k = F.least(n * CAP, F.round(F.col("target") / size * n).cast("long"))
    owners = targets.select("rank", n.alias("n"), k.alias("quota")).filter("quota > 0")
    owners = owners.withColumn("low", F.sum("quota").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)) - F.col("quota"))
    total = owners.agg(F.sum("quota")).first()[0] or 0
    page = max(1, total // 4096)
    pages = owners.withColumn("page", F.explode(F.sequence(F.floor(F.col("low") / page), F.floor((F.col("low") + F.col("quota") - 1) / page))))
    shards = -(-total // shard_slots)
    ticket = F.pmod(F.xxhash64(F.lit(seed), F.lit("ticket"), F.col("id")), F.lit(max(total, 1)))
    drawn = spark.range(total).select(F.floor(F.col("id") / shard_slots).alias("shard"), ticket.alias("ticket"))
    drawn = drawn.withColumn("page", F.floor(F.col("ticket") / page))
    drawn = drawn.join(pages, (drawn["page"] == pages["page"]) & (F.col("ticket") >= F.col("low")) & (F.col("ticket") < F.col("low") + F.col("quota")))
    counts = drawn.groupBy("shard", "rank").agg(F.count("*").alias("c"), F.max("n").alias("n"), F.max("quota").alias("quota"))
    before = W.partitionBy("rank").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)
    counts = counts.withColumn("base", F.sum("c").over(before) - F.col("c"))
    taken = counts.select("shard", "rank", "n", "base", F.least(F.col("base") + F.col("c"), F.col("quota")).alias("end")).filter("end > base")
    drew = counts.groupBy("rank").agg(F.sum("c").alias("drew"))
    lack = owners.join(drew, "rank", "left").select("rank", "n", "quota", F.coalesce("drew", F.lit(0)).alias("drew")).filter("quota > drew")
    tail = lack.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("quota") - F.col("drew") - 1) / shard_slots).cast("int"))))
    base = F.col("drew") + F.col("part") * shard_slots
    tail = tail.select((F.col("part") + shards).cast("long").alias("shard"), "rank", "n", base.alias("base"), F.least(base + shard_slots, F.col("quota")).alias("end"))
    # a row becomes a shard's slots: dealt out before, since the counts are few and small
    runs = taken.unionByName(tail).repartition(min(MOST_TASKS, total // TASK_SLOTS + 1), "shard")
    each = runs.select("shard", "rank", "n", F.explode(F.sequence(F.col("base"), F.col("end") - 1)).alias("k"))
    turn = F.floor(F.col("k") / F.col("n"))
    return each.select("shard", "rank", "k", turn.alias("turn"), _permuted(F.pmod(F.col("k"), F.col("n")), F.col("n"), F.lit(seed), F.col("rank"), turn).alias("block"))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """docs: (doc_id, text, source), other columns are ignored. Returns two DataFrames.

    1. A row for each document: doc_id, tie, size, source_size, target, rank, start.
    2. The mix: shard, k, turn, rank, block, start, doc_id, tie, first, words - slot k of a source holds
       ``words`` words of the document from its word number ``first``; turn counts the passes over the source.

    Nulls: text null counts as empty; source null is a source, the last; doc_id null stands after the
    ids. Empty documents have size 0 and are in no block. Rows with one doc_id are told apart by their
    text, and repeated rows each hold their own words. An empty table gives empty results.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    rows = staged(rows, "mix-sizes")
    targets = staged(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "mix-targets")
    placed = streams(rows)
    placed = placed.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    placed = staged(placed.select("a.doc_id", "a.tie", "a.size", "b.source_size", "b.target", "b.rank", "a.start"), "mix-places")
    cut = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    low = F.greatest(F.col("block") * block, F.col("start"))
    high = F.least((F.col("block") + 1) * block, F.col("start") + F.col("size"))
    cut = cut.select("rank", "block", "start", "doc_id", "tie", (low - F.col("start")).alias("first"), (high - low).alias("words"))
    # merged by sorting: slots come of few rows, whose size would have them broadcast
    return placed, slots(targets, block, shard_slots, seed).hint("merge").join(cut, ["rank", "block"])


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """A row for each document with the words that the mix takes of it: (doc_id, size, source_size, target, taken)."""
    placed, plan = mix(docs, **options)
    taken = plan.groupBy("rank", "start").agg(F.sum("words").alias("taken"))
    out = placed.join(taken.withColumnRenamed("rank", "r").withColumnRenamed("start", "s"), (F.col("rank") == F.col("r")) & (F.col("start") == F.col("s")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with the texts that the mix takes of them: a document's words of the first pass, then a line
    break and those of the second. Documents of which the mix takes nothing go; other columns stay as they
    are but n_chars, if there, is the new length."""
    _, plan = mix(docs, **options)
    runs = F.sort_array(F.collect_list(F.struct("turn", "first", "words")))
    # places are unique for rows that hold words, so repeated rows stay apart by their number among equals
    number = lambda *by: F.row_number().over(W.partitionBy("doc_id", "tie").orderBy(*by))
    held = plan.groupBy("rank", "start", "doc_id", "tie").agg(runs.alias("runs")).withColumn("nth", number("rank", "start"))
    of, at, nth, parts, tie, own = (fresh(docs, n) for n in ("id", "tie", "nth", "parts", "text_tie", "own_nth"))
    held = held.select(F.col("doc_id").alias(of), F.col("tie").alias(at), F.col("nth").alias(nth), F.col("runs").alias(parts))
    rows = docs.withColumn(tie, F.xxhash64("text"))
    rows = rows.withColumn(own, F.row_number().over(W.partitionBy(F.col("doc_id").cast("long"), tie).orderBy(F.col("source").asc_nulls_last())))
    rows = rows.join(held, F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.col(tie) == F.col(at)) & (F.col(own) == F.col(nth)))

    def build(words: Column) -> Column:
        one = lambda turn: F.array_join(F.transform(F.filter(parts, lambda p: p["turn"] == turn), lambda p: F.array_join(F.slice(words, (p["first"] + 1).cast("int"), p["words"].cast("int")), "")), "")
        return F.array_join(F.filter(F.array(*[one(t) for t in range(CAP)]), lambda t: t != ""), "\n")

    text = bind(F.regexp_extract_all("text", F.lit(PIECE), F.lit(0)), build)
    out = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
