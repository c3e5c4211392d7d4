"""The tools' entry points as plans: lint, normalize, compact export, and linking two data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import dates, text
from kinloom.operators import checks, households, linkage, merging, rewrites
from kinloom.sources import lineage
from kinloom.staging import staged


def lint(spark: SparkSession, path: str, rules: tuple[str, ...] = ()) -> DataFrame:
    return checks.violations(checks.Scan(lineage.parse_lines(lineage.read_raw(spark, path)).persist()), rules)


def normalize(spark: SparkSession, path: str, to: str | None, steps: tuple[str, ...] = rewrites.NORMALIZE, skip: tuple[str, ...] = ()) -> DataFrame:
    """Applies the steps and writes the files; without ``to`` it is a dry run. Returns the changes by sign."""
    before = staged(lineage.parse_lines(lineage.read_raw(spark, path)), "lines")
    after = rewrites.applied(before, tuple(s for s in steps if s not in skip), staged)
    if to:
        rewrites.write_lines(rewrites.out(after), to)
    raws = lambda df, sign: df.groupBy("file_id", "raw").agg(F.count("*").alias("n")).select("file_id", "raw", (F.col("n") * sign).alias("n"))
    both = raws(before, -1).unionByName(raws(after, 1)).groupBy("file_id", "raw").agg(F.sum("n").alias("n"))
    return both.groupBy("file_id").agg(F.sum(F.greatest("n", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("removed"))


def export(spark: SparkSession, path: str, to: str, **options: bool) -> None:
    rewrites.write_lines(rewrites.export_minimal(lineage.parse_lines(lineage.read_raw(spark, path)), **options), to)


def linked_people(lines: DataFrame) -> DataFrame:
    """People as the linkage takes them: normalized names, sex, first birth and death, and what their families say:
    an estimated year of birth, surnames of husbands."""
    people, families = lineage.people(lines), lineage.families(lines)
    own = people
    parts = text.name_parts(F.coalesce(F.get("names", F.lit(0)), F.lit("")))
    people = people.select("xref", "sex", parts.alias("p")).select("xref", "sex", text.normal(F.col("p.given")).alias("given"), text.normal(F.col("p.surname")).alias("surname"))
    e = lineage.events(lines, ("BIRT", "DEAT")).filter("nth = 0 and owner_kind = 'INDI'")
    one = lambda tag, name: e.filter(F.col("tag") == tag).select(F.col("owner_xref").alias("xref"), dates.parse_date(F.coalesce("date_raw", F.lit(""))).alias(name), F.col("place").alias(f"{name}_place"))
    people = people.join(one("BIRT", "birth"), "xref", "left").join(one("DEAT", "death"), "xref", "left")
    people = staged(people.join(own.select("xref", "fams", "famc"), "xref"), "people")
    estimates = linkage.estimated_births(people.withColumn("year", F.col("birth.year")), families)
    people = people.join(estimates, "xref", "left").join(linkage.husband_surnames(people, families), "xref", "left")
    return people.drop("fams", "famc")


def link(a: DataFrame, b: DataFrame, rounds: int | None = None) -> DataFrame:
    """a, b: parsed lines of one file each. (xref_a, xref_b, score): a one-to-one choice. After each round the pairs
    found give family context to the next, until a choice comes again; ``rounds`` stops it before. A pair is chosen for its
    own likeness, in groups of names (``choose``), or for relatives that are matched (``kin_pairs``, found from these)."""
    pa, pb = (staged(linkage.name_classes(linked_people(x)), "people") for x in (a, b))
    one = lambda df: df.filter("xref = class")
    names = staged(linkage.name_scores(one(pa), one(pb)).withColumnsRenamed({"xref_a": "class_a", "xref_b": "class_b"}), "names")
    ea, eb = lineage.edges(a), lineage.edges(b)

    def kin(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        kids = edges.filter("role = 'CHIL'").select("fam", F.col("indi").alias("child"))
        own = edges.filter("role <> 'CHIL'").select("fam", "role", "indi")
        wed = own.alias("x").join(own.alias("y"), (F.col("x.fam") == F.col("y.fam")) & (F.col("x.role") != F.col("y.role"))).select(F.col("x.indi").alias("indi"), F.col("y.indi").alias("spouse"))
        return kids.join(own, "fam").select("child", "role", F.col("indi").alias("parent")), wed

    parents_a, wed_a, parents_b, wed_b = (staged(x, "kin") for e in (ea, eb) for x in kin(e))
    groups = linkage.name_groups(pa, pb, names, parents_a)
    chosen = linkage.choose(groups)
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("xref_a", "xref_b").cast("decimal(38,0)"))).first())
    seen, n = {state(chosen)}, 1
    while rounds is None or n < rounds:
        known = chosen.select(F.col("xref_a").alias("m_a"), F.col("xref_b").alias("m_b"))
        near = linkage.kin_pairs(pa, pb, names, known, parents_a, parents_b, wed_a, wed_b).filter(F.col("score") >= linkage.AUTO)
        near = linkage.without_contradiction(staged(near, "near"), known, parents_a, parents_b)
        matched = parents_b.join(known, F.col("parent") == F.col("m_b")).select(F.col("child").alias("x"), "role")
        chosen, n = linkage.choose(groups, near, linkage.roles_of(matched)), n + 1
        if (now := state(chosen)) in seen:
            break
        seen.add(now)
    return chosen


def merge(a: DataFrame, b: DataFrame, matched: DataFrame, to: str | None = None) -> DataFrame:
    """a, b: parsed lines of one file each; matched: (xref_b, xref_a) of records of any kind, as ``link``,
    ``linkage.match_families`` and ``linkage.source_scores`` give them. The merged lines, families of one couple taken
    together, written if ``to`` is given. Pointers of b to nothing go first, so that none comes to point to a record of a."""
    b = rewrites.renumbered(staged(rewrites.FIXES["dangling_pointers"](b), "merge-b"))
    lines = rewrites.renumbered(staged(merging.merged(a, b, merging.whole_map(a, b, matched)), "merged"))
    out = staged(households.duplicate_families(staged(lines, "merged-lines")), "merged-families")
    if to:
        rewrites.write_lines(out, to)
    return out
