"""Family graphs: pedigrees, components, relatives, cycles and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinloom.functions import dates
from kinloom.staging import staged

V = F.col
GENERATIONS = 60
STEPS = 60


def parents_of(edges: DataFrame) -> DataFrame:
    """(file_id, child, father, mother) by each child's first family."""
    by = edges.filter("role <> 'CHIL'").groupBy("file_id", "fam").agg(F.max(F.when(V("role") == "HUSB", V("indi"))).alias("father"), F.max(F.when(V("role") == "WIFE", V("indi"))).alias("mother"))
    kids = edges.filter("role = 'CHIL'").groupBy("file_id", V("indi").alias("child")).agg(F.min_by("fam", F.struct("ord", "fam")).alias("fam"))
    return kids.join(by, ["file_id", "fam"]).select("file_id", "child", "father", "mother")


def ancestors(parents: DataFrame, root: str | int, generations: int = GENERATIONS) -> DataFrame:
    """(k, indi): the pedigree by Ahnentafel number. A cycle ends after ``generations`` steps; within 60 the
    numbers are longs."""
    parents.createOrReplaceTempView("kinloom_parents")
    spark = parents.sparkSession
    at = F.lit(root)
    spark.range(1).select(F.lit(1).cast("long").alias("k"), at.cast(parents.schema["child"].dataType).alias("indi")).createOrReplaceTempView("kinloom_root")
    return spark.sql(f"""
        WITH RECURSIVE up(k, indi, depth) MAX RECURSION LEVEL {generations + 2} AS (
          SELECT k, indi, 0 FROM kinloom_root
          UNION ALL
          SELECT up.k * 2 + s.side, CASE WHEN s.side = 0 THEN p.father ELSE p.mother END, up.depth + 1
          FROM up JOIN kinloom_parents p ON p.child = up.indi CROSS JOIN (SELECT explode(array(0, 1)) AS side) s
          WHERE up.depth < {generations} AND CASE WHEN s.side = 0 THEN p.father ELSE p.mother END IS NOT NULL)
        SELECT k, indi FROM up""")


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """links: distinct (a, b) with a > b. Large: each neighbour above a node is linked to the least of the
    node and its neighbours. Small: each neighbour below a node, and the node, are linked to the least of them.

    The least neighbour is an aggregate, made before the shuffle, and comes back by a join on the node that
    adaptive execution can split, so that a node with very many neighbours does not fill one task.
    """
    if large:
        both = links.select(F.col("a").alias("node"), F.col("b").alias("near")).union(links.select("b", "a"))
    else:
        both = links.select(F.col("a").alias("node"), F.col("b").alias("near"))
    least = both.groupBy("node").agg(F.min("near").alias("least"))
    if large:
        joined = both.join(least, "node").filter("near > node").select(F.col("near").alias("a"), F.least("least", "node").alias("b"))
    else:
        joined = both.join(least, "node").select(F.col("near").alias("a"), F.col("least").alias("b")).union(least.select("node", "least"))
    return joined.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) of ordered ids, in any direction, repeats and loops allowed. A row (node, component) for
    each node of a link between two nodes; component is the least node that links lead to. Nulls are left out.

    Alternating large-star and small-star steps. Each step's links are written to the shared folder, which cuts
    lineage; the driver reads two sums a step.
    """
    now = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, last = staged(now, "links"), None
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    for _ in range(STEPS):
        now = staged(_stars(_stars(now, True), False), "links")
        if (found := state(now)) == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        last = found
    raise RuntimeError(f"components did not settle in {STEPS} steps")


def trees(people: DataFrame, links: DataFrame) -> DataFrame:
    """people: (node); links: (a, b). (component, size) of each connected tree; someone without links is one."""
    found = components(links)
    own = people.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return own.groupBy("component").agg(F.count("*").alias("size"))


def cycles(parents: DataFrame) -> DataFrame:
    """parents: (child, parent). Everyone who is their own ancestor, however long the way: reach doubles in each
    round over distinct pairs, until it no longer grows."""
    start = parents.select(V("child").alias("a"), V("parent").alias("b")).filter("b is not null").distinct()
    # only nodes with both a parent and a child can be on a cycle; pruning leaves little to walk
    before = -1
    while (n := start.count()) != before and n:
        before = n
        start = staged(start.join(start.select(V("b").alias("a")).distinct(), "a", "left_semi").join(start.select(V("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), "cycle-core")
    known, before = start, -1
    while n != before:
        before = n
        further = known.alias("x").join(known.alias("y"), V("x.b") == V("y.a")).select(V("x.a").alias("a"), V("y.b").alias("b"))
        known = staged(known.union(further).distinct(), "cycle-reach")
        n = known.count()
    return known.filter("a = b").select(V("a").alias("node"))


def siblings(edges: DataFrame) -> DataFrame:
    """(file_id, indi, sibling): others of the same family."""
    kids = edges.filter("role = 'CHIL'")
    return kids.alias("x").join(kids.alias("y"), (V("x.file_id") == V("y.file_id")) & (V("x.fam") == V("y.fam")) & (V("x.indi") != V("y.indi"))).select("x.file_id", V("x.indi").alias("indi"), V("y.indi").alias("sibling")).distinct()


def spouses(edges: DataFrame) -> DataFrame:
    """(file_id, indi, fam, spouse)."""
    own = edges.filter("role <> 'CHIL'")
    return own.alias("x").join(own.alias("y"), (V("x.file_id") == V("y.file_id")) & (V("x.fam") == V("y.fam")) & (V("x.role") != V("y.role"))).select("x.file_id", V("x.indi").alias("indi"), V("x.fam").alias("fam"), V("y.indi").alias("spouse")).distinct()


def half_siblings(edges: DataFrame) -> DataFrame:
    """(file_id, indi, shared_parent, half): children of the parents' other families who are not full siblings."""
    kids = edges.filter("role = 'CHIL'").select("file_id", "fam", "indi")
    up = edges.filter("role <> 'CHIL'").select("file_id", "fam", V("indi").alias("parent"))
    of = kids.join(up, ["file_id", "fam"]).select("file_id", "indi", "parent", "fam").distinct()
    pair = of.alias("x").join(of.alias("y"), (V("x.file_id") == V("y.file_id")) & (V("x.parent") == V("y.parent")) & (V("x.fam") != V("y.fam")) & (V("x.indi") != V("y.indi")))
    pair = pair.select("x.file_id", V("x.indi").alias("indi"), V("x.parent").alias("shared_parent"), V("y.indi").alias("half")).distinct()
    return pair.join(siblings(edges).withColumnRenamed("sibling", "half"), ["file_id", "indi", "half"], "left_anti")


def primary_families(links: DataFrame) -> DataFrame:
    """links: (person, fam, with_focus, on_lineage, married, other_birth, number). The family under which a person
    is shown: the one with the focus, else the one on the lineage (each only if it is the only such), else the
    earliest marriage, then the other's earliest birth, then the lowest number."""
    by = W.partitionBy("person")
    alone = lambda c: V(c) & (F.count_if(V(c)).over(by) == 1)
    rows = links.withColumn("rule", F.when(alone("with_focus"), 0).when(alone("on_lineage"), 1).otherwise(2))
    order = by.orderBy("rule", F.coalesce("married", F.lit(99999)), F.coalesce("other_birth", F.lit(99999)), F.coalesce("number", F.lit(2**62)))
    return rows.withColumn("n", F.row_number().over(order)).filter("n = 1").select("person", "fam")


def timeline(edges: DataFrame, vitals: DataFrame) -> DataFrame:
    """(file_id, indi, year, kind, relative, section): births and deaths of children, deaths of parents and spouses
    within a life (100 years where no death is known); Early up to 18, Later from the death on."""
    v = vitals.select("file_id", "xref", "birth", "death")
    up = edges.filter("role <> 'CHIL'").select("file_id", "fam", V("indi").alias("p"))
    down = edges.filter("role = 'CHIL'").select("file_id", "fam", V("indi").alias("c"))
    both = up.join(down, ["file_id", "fam"])
    of = lambda rows, me, them, kind, year: rows.join(v.select("file_id", V("xref").alias(them), V(year).alias("year")), ["file_id", them]).select("file_id", V(me).alias("indi"), "year", F.lit(kind).alias("kind"), V(them).alias("relative"))
    pairs = spouses(edges).select("file_id", "indi", "spouse")
    rows = of(both, "p", "c", "child_birth", "birth").unionByName(of(both, "p", "c", "child_death", "death")).unionByName(of(both, "c", "p", "parent_death", "death")).unionByName(of(pairs, "indi", "spouse", "spouse_death", "death"))
    me = v.select("file_id", V("xref").alias("indi"), V("birth").alias("b"), F.coalesce("death", V("birth") + 100).alias("d"))
    rows = rows.distinct().join(me, ["file_id", "indi"]).filter("year between b and d")
    return rows.select("file_id", "indi", "year", "kind", "relative", F.when(V("year") <= V("b") + 18, "Early").when(V("year") >= V("d"), "Later").otherwise("Life").alias("section"))


def collapse_runs(rows: DataFrame, key: str, order: str, value: str, low: Column, high: Column) -> DataFrame:
    """Neighbouring rows with one value as one: (key, island, value, first, last, n)."""
    w = W.partitionBy(key).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(V(value)), 0).otherwise(1)
    marked = rows.withColumn("new", new).withColumn("island", F.sum("new").over(w))
    return marked.groupBy(key, "island").agg(F.first(value).alias(value), F.min(low).alias("first"), F.max(high).alias("last"), F.count("*").alias("n"))


def subsumed(rows: DataFrame, *key: str) -> DataFrame:
    """rows: (key..., id, low, high). Those whose range lies strictly within another's of the same key: a running
    maximum over ranges by start (longest first), so that no pairs are made."""
    w = W.partitionBy(*key).orderBy("low", F.col("high").desc(), "id")
    reach = F.max("high").over(w.rowsBetween(W.unboundedPreceding, -1))
    same = F.max("high").over(W.partitionBy(*key, "low"))
    earlier = F.max("high").over(W.partitionBy(*key).orderBy("low").rangeBetween(W.unboundedPreceding, -1))
    return rows.withColumn("reach", reach).withColumn("same", same).withColumn("earlier", earlier).filter("earlier >= high or same > high").drop("reach", "same", "earlier")


def sorted_events(events: DataFrame) -> DataFrame:
    """events with n, their place in the viewer's order: birth, general, death, notices, burial, probate; by date."""
    kind = F.when(V("tag") == "BIRT", 0).when(V("tag") == "DEAT", 2).when((V("tag") == "EVEN") & F.lower(F.coalesce("type", F.lit(""))).rlike("death|obituary"), 3).when(V("tag") == "BURI", 4).when(V("tag") == "PROB", 5).otherwise(1)
    key = dates.viewer_sort_key(F.coalesce("date_raw", F.lit("")))
    return events.withColumn("n", F.row_number().over(W.partitionBy("file_id", "rec_no").orderBy(kind, key, "l1_no")))
