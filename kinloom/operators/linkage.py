"""Record linkage between two data sets, and merging them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinloom.functions import dates, text
from kinloom.operators import choosing
from kinloom.operators.graph import components
from kinloom.staging import staged

V = F.col
# Weights and thresholds of the scores.
PERSON = {"surname": 0.20, "given": 0.20, "birth": 0.20, "death": 0.10, "sex": 0.05, "family": 0.25}
SOURCE = {"title": 0.60, "author": 0.15, "publisher": 0.10, "years": 0.10, "repo": 0.05}
AUTO, REVIEW, AUTO_SOURCE, REVIEW_SOURCE = 0.75, 0.50, 0.90, 0.85
#: Given names that stand for each other; of a name in several groups the last one counts.
ALIASES = (
    "george georgios giorgios kevork georgio giorgio",
    "francis francesco francois français",
    "john ioannis yiannis yannis giannis jean juan giovanni johannes yanni",
    "constantine konstantinos kostas costas constantino",
    "stephen esteban stefan stefano steve steven stephano stephane",
    "nicholas nikolaos nikos nikolas nicolas nikola nicolao nicola nico nicolo nicolò niccolo niccolò nicolaas nicorosi",
    "peter petros pierre pietro piero petar porto",
    "michael michail michalis mikael miguel mihail michel michele",
    "theodore theodoros theo",
    "dimitri dimitrios demetrios demetrius demetri",
    "thomas tomas tommaso tomaso",
    "alexander alexandros alexios alex alekos aleksander alexandre",
    "evangelos vangelis",
    "panagiotis panos panayiotis takis",
    "christos christodoulos christoforos christopher chris christo cristoforo christoforo",
    "spyros spyridon spiro spiridon spiridione",
    "vasilis vassilis vasileios basilios vaselios vasilios",
    "antonis antonios antonio anthony tony antoine",
    "emilio emil emile emin",
    "jacobo giacomo jacques jacob zaccaria",
    "paul paolo paulo pablo pauli polycarpe policarpo",
    "philip filippo philippe philippo",
    "andrew andre andrei",
    "dominic dominique domenico",
    "gregory gregoire gregorio kirkor",
    "jerome jérôme gerolamo geronimo hyeronimo",
    "louis luigi",
    "giuseppe joseph josef",
    "pantaleone pandeli leon",
    "helen eleni elena helene helena hélène ellen",
    "giuseppa giuseppina josephine joséphine josephina josefina josepha",
    "mary maria marie maruca marigho",
    "sophia sofia sophie",
    "katerina katherine catherine katarina caterina katrina kate catarina catharina kathleen chatrine catu catù",
    "anna anne ann ana",
    "evangeline vangelio",
    "fotini photini",
    "angela angele angelina angelica angelique angélique angeru angerù",
    "teresa therese thérèse theresa",
    "madeleine magdalena maddalena madalena",
    "brigida brigidina birgitta bergula",
    "apollonia appollonia plumu plumù",
    "despina despinu despinù",
    "battistina battina bettina battistine batestu batestù battu",
    "julia giulia giuliana",
    "joanna giovanna jeanne",
    "rose rosa rosine rosina rosalie",
    "louise luigia",
    "epiphanie fanny",
    "lucia lula",
    "sofronia subru subrù",
)
CLOSE = 2
#: So many pairs are chosen from in one task (a task holds the ids of those that are taken).
FEW = 500_000
#: The score of family context where parents and a spouse are matched.
BEST_FAMILY = 0.97
#: Scores down to which pairs are made and chosen in turn, before AUTO.
BANDS = (0.85, 0.80, 0.785, 0.765)
GIVEN = "_given_"


def known_words(words: Column) -> Column:
    return F.filter(words, lambda w: (w != "") & ~w.isin(*text.UNKNOWN_NAMES))


def block_keys(people: DataFrame) -> DataFrame:
    """people: (xref, given, surname), husbands (their surnames) if there. (xref, key): the surname and its words; for
    those without, their husbands' surnames, else the given name."""
    words = known_words(F.array_union(F.array("surname"), F.split("surname", " ")))
    husbands = known_words(F.coalesce(V("husbands"), F.array().cast("array<string>"))) if "husbands" in people.columns else F.array().cast("array<string>")
    own = F.when(F.size(words) > 0, words).when(F.size(husbands) > 0, husbands).otherwise(F.array(given_key()))
    return people.select("xref", F.explode(own).alias("key"))


def given_key() -> Column:
    return F.concat(F.lit(GIVEN), F.substring_index("given", " ", 1))


def close_keys(a: DataFrame, b: DataFrame, distance: int = CLOSE) -> DataFrame:
    """a, b: distinct (key). Pairs (key_a, key_b) that are equal or, from five letters on, within the distance.

    Words within k edits share one of their k + 1 parts, moved by k places at most: pairs meet on such a part, so
    no two lists of keys are crossed."""

    def parts(keys: DataFrame, side: str, slack: int) -> DataFrame:
        n = distance + 1
        size = F.floor(F.char_length("key") / n).cast("int")
        if side == "a":
            cut = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(F.char_length("key").alias("len"), k.alias("k"), F.substring("key", k * size + 1, F.when(k == n - 1, F.char_length("key")).otherwise(size)).alias("part")))
            return keys.select("key", F.explode(cut).alias("p")).select(V("key").alias("key_a"), "p.*")
        each = F.sequence(F.char_length("key") - distance, F.char_length("key") + distance)
        rows = keys.select("key", F.explode(each).alias("len")).filter("len >= 5").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        size_a = F.floor(V("len") / n).cast("int")
        length = F.when(V("k") == n - 1, V("len") - size_a * (n - 1)).otherwise(size_a)
        rows = rows.withColumn("shift", F.explode(F.sequence(F.lit(-slack), F.lit(slack)))).withColumn("at", V("k") * size_a + 1 + V("shift"))
        return rows.filter("at >= 1").select(V("key").alias("key_b"), "len", "k", F.substring("key", V("at"), length).alias("part")).distinct()

    long = lambda df: df.filter(F.char_length("key") >= 5)
    near = parts(long(a), "a", distance).join(parts(long(b), "b", distance), ["len", "k", "part"]).select("key_a", "key_b").distinct()
    near = near.filter(F.levenshtein("key_a", "key_b") <= distance)
    same = a.select(V("key").alias("key_a")).join(b.select(V("key").alias("key_b")), V("key_a") == V("key_b"))
    return near.unionByName(same).distinct()


def candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """(xref_a, xref_b) of people whose surnames' block keys are close; people of b without any meet those of a that
    are known by their given name."""
    ka, kb = block_keys(a), block_keys(b)
    by_surname = lambda keys: keys.filter(~V("key").startswith(GIVEN))
    near = close_keys(by_surname(ka).select("key").distinct(), by_surname(kb).select("key").distinct())
    pairs = ka.select(V("xref").alias("xref_a"), V("key").alias("key_a")).join(near, "key_a").join(kb.select(V("xref").alias("xref_b"), V("key").alias("key_b")), "key_b")
    pairs = staged(pairs.select("xref_a", "xref_b").distinct(), "candidates")
    rest = b.select(V("xref").alias("xref_b"), given_key().alias("key")).filter(V("key") != GIVEN).join(pairs.select("xref_b"), "xref_b", "left_anti")
    return pairs.unionByName(ka.select(V("xref").alias("xref_a"), "key").join(rest, "key").select("xref_a", "xref_b").distinct())


def estimated_births(people: DataFrame, families: DataFrame) -> DataFrame:
    """people: (xref, year, fams, famc) with the year of birth; families: (xref, husb, wife, chil). (xref, estimate)
    for people without a year: a spouse's, else of a parent's 27 years later and the first child's 27 years earlier
    the mean or the one there is. The first two families as a spouse count, and the first as a child."""
    years = people.filter("year is not null").select(V("xref").alias("indi"), V("year").alias("y"))
    year_of = lambda df, c: df.join(years.withColumnsRenamed({"indi": c, "y": f"{c}_year"}), c, "left")
    first = families.select(V("xref").alias("fam"), F.explode("chil").alias("indi")).join(years, "indi").groupBy("fam").agg(F.min("y").alias("first"))
    known = year_of(year_of(families.select(V("xref").alias("fam"), "husb", "wife"), "husb"), "wife").join(first, "fam", "left")
    open_ = people.filter("year is null")
    spouse = F.coalesce(F.when(V("husb") != V("xref"), V("husb_year")), F.when(V("wife") != V("xref"), V("wife_year")))
    wed = open_.select("xref", F.posexplode(F.slice("fams", 1, 2)).alias("n", "fam")).join(known, "fam")
    earliest = lambda c: F.min_by(c, F.when(c.isNotNull(), V("n")))
    wed = wed.groupBy("xref").agg(earliest(spouse).alias("spouse"), (earliest(V("first")) - 27).alias("child"))
    born = open_.select("xref", F.get("famc", F.lit(0)).alias("fam")).join(known, "fam").select("xref", (F.coalesce("husb_year", "wife_year") + 27).alias("parent"))
    mean = F.bround((V("parent") + V("child")) / 2, 0).cast("int")
    return wed.join(born, "xref", "full").select("xref", F.coalesce("spouse", mean, "parent", "child").alias("estimate")).filter("estimate is not null")


def husband_surnames(people: DataFrame, families: DataFrame) -> DataFrame:
    """people: (xref, sex, surname, fams). (xref, husbands): surnames of the husbands in the first two families."""
    wives = people.filter("coalesce(sex, '') <> 'M'").select("xref", F.explode(F.slice("fams", 1, 2)).alias("fam"))
    found = wives.join(families.select(V("xref").alias("fam"), V("husb").alias("h")), "fam").join(people.select(V("xref").alias("h"), "surname"), "h")
    return found.filter("h <> xref").groupBy("xref").agg(F.sort_array(F.collect_set("surname")).alias("husbands"))


def lifespan(birth: Column, death: Column, estimate: Column) -> tuple[Column, Column]:
    """The earliest year of birth and the latest of death that are plausible; null where nothing bounds them."""
    b, d = birth["year"], death["year"]
    before, after = (lambda x: F.coalesce(x["qualifier"] == "BEF", F.lit(False))), (lambda x: F.coalesce(x["qualifier"] == "AFT", F.lit(False)))
    earliest = F.when(b.isNotNull(), F.when(~before(birth), F.when(after(birth), b).otherwise(b - 10)))
    earliest = earliest.when(d.isNotNull(), F.when(before(death), d - 140).otherwise(d - 100)).otherwise(estimate - 15)
    latest = F.when(d.isNotNull(), F.when(before(death), d).when(after(death), d + 100).otherwise(F.coalesce(death["year2"], d) + 5))
    return earliest, latest.when(b.isNotNull(), b + 100).otherwise(estimate + 115)


def canonical_given(given: Column) -> Column:
    pairs = {n: f"_{k}" for k, names in enumerate(ALIASES) for n in names.split()}
    names = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(names, given), given)


def event_score(date_a: Column, place_a: Column, date_b: Column, place_b: Column, similarity: Column | None = None) -> Column:
    """0.7 of how the dates agree and 0.3 of the places; 0.5 where an event is missing. The places' similarity may be given."""
    none = lambda p: F.coalesce(p, F.lit("")) == ""
    place = F.when(none(place_a) | none(place_b), 0.5).otherwise(text.place_similarity(place_a, place_b) if similarity is None else similarity)
    return F.when((date_a.isNull() & none(place_a)) | (date_b.isNull() & none(place_b)), 0.5).otherwise(0.7 * dates.date_overlap(date_a, date_b) + 0.3 * place)


def name_classes(people: DataFrame) -> DataFrame:
    """people with ``class``: those of one given name and surname (where it is none, of one list of husbands' surnames too) have
    the same candidates; a class is named by its least xref."""
    without = F.size(known_words(F.array("surname"))) == 0
    husbands = F.when(without, V("husbands")) if "husbands" in people.columns else F.lit(None).cast("array<string>")
    return people.withColumn("class", F.min("xref").over(W.partitionBy("surname", "given", husbands)))


def name_scores(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: people with distinct names, or one of each class. Candidate pairs (xref_a, xref_b) and how alike their names are,
    (surname, given); surnames that differ clearly are left out."""
    side = lambda df, s: df.select(*[V(c).alias(f"{c}_{s}") for c in ("xref", "given", "surname")])
    pairs = candidates(a, b).join(side(a, "a"), "xref_a").join(side(b, "b"), "xref_b")
    whole = F.array_contains(F.split("surname_a", " "), V("surname_b")) | F.array_contains(F.split("surname_b", " "), V("surname_a"))
    pairs = pairs.withColumn("surname", F.greatest(text.indel_ratio("surname_a", "surname_b"), F.when(whole & (V("surname_a") != "") & (V("surname_b") != ""), 0.92).otherwise(0.0)))
    inside = (V("given_a").contains(V("given_b")) | V("given_b").contains(V("given_a"))) & (V("given_a") != "") & (V("given_b") != "")
    alias = canonical_given(F.substring_index("given_a", " ", 1)) == canonical_given(F.substring_index("given_b", " ", 1))
    pairs = pairs.withColumn("given", F.greatest(text.indel_ratio("given_a", "given_b"), F.when(inside, 0.95).when(alias, 0.92).otherwise(0.0)))
    return pairs.filter(~((V("surname_a") != "") & (V("surname_b") != "") & (V("surname") < 0.55))).select("xref_a", "xref_b", "surname", "given")


def life(people: DataFrame, s: str) -> DataFrame:
    """What the scores of pairs take of a person besides the names, under names of side s."""
    estimate = V("estimate") if "estimate" in people.columns else F.lit(None).cast("int")
    columns = ["xref", "sex", "birth", "birth_place", "death", "death_place", *(["class"] if "class" in people.columns else [])]
    first, last = lifespan(V("birth"), V("death"), estimate)
    born = F.coalesce(V("birth")["year"], estimate)
    return people.select(*[V(c).alias(f"{c}_{s}") for c in columns], *[text.compared_place(F.coalesce(f"{e}_place", F.lit(""))).alias(f"{e}_at_{s}") for e in ("birth", "death")], born.alias(f"born_{s}"), first.alias(f"first_{s}"), last.alias(f"last_{s}"))


def compared(pairs: DataFrame) -> DataFrame:
    """pairs of people (``life`` of both) with surname and given: adds birth, death and sex, leaves vetoed pairs out."""
    gap = lambda x, y, n: F.coalesce(F.abs(V(x)["year"] - V(y)["year"]) > n, F.lit(False))
    dated = lambda c: V(c)["month"].isNotNull() & V(c)["qualifier"].isNull()
    exact = F.coalesce(dated("birth_a") & dated("birth_b"), F.lit(False))
    apart = F.coalesce(F.abs(V("born_a") - V("born_b")) > 50, F.lit(False))
    disjoint = F.coalesce(V("last_a") < V("first_b"), F.lit(False)) | F.coalesce(V("last_b") < V("first_a"), F.lit(False))
    earlier = lambda x, y: F.coalesce(V(x)["year"] < V(y)["year"], F.lit(False))
    pairs = pairs.filter(~(apart | (exact & gap("birth_a", "birth_b", 5)) | gap("death_a", "death_b", 25) | earlier("death_a", "birth_b") | earlier("death_b", "birth_a") | disjoint))
    known = lambda c: F.coalesce(V(c), F.lit("U")).isin("M", "F")
    pairs = pairs.withColumn("sex", F.when(~known("sex_a") | ~known("sex_b"), 0.5).when(V("sex_a") == V("sex_b"), 1.0).otherwise(0.0))
    score = lambda e: event_score(*[V(f"{e}{c}") for c in ("_a", "_place_a", "_b", "_place_b")], text.compared_places(V(f"{e}_at_a"), V(f"{e}_at_b")))
    pairs = pairs.withColumn("birth", score("birth")).withColumn("death", score("death"))
    return pairs.filter(~((V("sex") == 0.0) & (V("surname") + V("given") + V("birth") + V("death") < 3.4)))


def total_score() -> Column:
    return sum((V(c) * w for c, w in PERSON.items()), F.lit(0.0))


def person_scores(a: DataFrame, b: DataFrame, family: Column | None = None) -> DataFrame:
    """a, b: (xref, given, surname, sex, birth DATE struct, birth_place, death DATE struct, death_place), names
    normalized; estimate, a year of birth for those without, if there. Scored candidate pairs (xref_a, xref_b, score),
    vetoed ones left out; family context 0.5 unless given."""
    pairs = compared(name_scores(a, b).join(life(a, "a"), "xref_a").join(life(b, "b"), "xref_b"))
    pairs = pairs.withColumn("family", F.lit(0.5) if family is None else family)
    undated = V("birth_a").isNull() & V("death_a").isNull() & V("birth_b").isNull() & V("death_b").isNull()
    score = F.when(undated & (V("family") <= 0.5), F.least(total_score(), F.lit(0.62))).otherwise(total_score())
    return pairs.select("xref_a", "xref_b", *PERSON, text.rounded4(score).alias("score"))


def name_lack() -> Column:
    return (1 - V("surname")) * PERSON["surname"] + (1 - V("given")) * PERSON["given"]


def name_groups(a: DataFrame, b: DataFrame, names: DataFrame, parents_a: DataFrame) -> DataFrame:
    """a, b: people with ``class``; names: (class_a, class_b, surname, given) of ``name_scores``; parents_a: (child, role, parent).
    Rows of ``choosing.SCHEMA``: people of both sides, and the names by which a pair can be chosen without matched relatives.
    A group (comp) has all names that are linked by some by which a pair can be chosen at all, with the best family context."""
    end = lambda s: F.concat(F.lit(f"{s}:"), f"class_{s}")
    links = names.filter(name_lack() <= 1 - (1 - BEST_FAMILY) * PERSON["family"] - AUTO + 1e-4)
    found = components(links.select(end("a").alias("a"), end("b").alias("b")))
    number = lambda c: F.when(V(c)["qualifier"] == "ABT", choosing.ABT).when(V(c)["qualifier"] == "BEF", choosing.BEF).when(V(c)["qualifier"] == "AFT", choosing.AFT).when(V(c)["qualifier"] == "BET", choosing.BET).otherwise(choosing.EXACT)

    def side(people: DataFrame, s: str, kind: int) -> DataFrame:
        known = F.when(V(f"sex_{s}") == "M", 1).when(V(f"sex_{s}") == "F", 2).otherwise(0)
        columns = [known.alias("sex"), *[V(f"{c}_{s}").alias(c) for c in ("born", "first", "last")]]
        for e in choosing.EVENTS:
            at = f"{e}_{s}"
            columns += [F.when(V(at).isNotNull(), number(at)).alias(f"{e}_q"), *[V(at)[c].alias(f"{e}_{c}") for c in ("year", "month", "day", "year2")]]
            columns += [V(f"{e}_at_{s}").alias(f"{e}_at"), (F.coalesce(V(f"{e}_place_{s}"), F.lit("")) == "").cast("int").alias(f"{e}_none")]
        rows = life(people, s).join(found.select(F.substring("node", 3, 1_000_000).alias(f"class_{s}"), V("component").alias("comp")).filter(V("node").startswith(f"{s}:")), f"class_{s}")
        return rows.select("comp", F.lit(kind).alias("kind"), V(f"xref_{s}").alias("x"), V(f"class_{s}").alias("y"), *columns)

    roles = roles_of(parents_a.select(V("child").alias("x"), "role"))
    left = side(a, "a", choosing.A).join(roles, "x", "left")
    kinds = names.filter(name_lack() <= 1 - 0.5 * PERSON["family"] - AUTO + 1e-4).withColumn("node", end("a")).join(found, "node")
    kinds = kinds.select(V("component").alias("comp"), F.lit(choosing.NAMES).alias("kind"), V("class_a").alias("x"), V("class_b").alias("y"), V("surname").alias("s"), V("given").alias("g"))
    rows = left.unionByName(side(b, "b", choosing.B), True).unionByName(kinds, True)
    return staged(rows.select(*[V(c).cast(t) for c, t in (x.split(" ") for x in choosing.SCHEMA.split(", "))]), "name-groups")


def roles_of(parents: DataFrame) -> DataFrame:
    """parents: (x, role). (x, roles): a bit for each role that someone has a parent in."""
    return parents.groupBy("x").agg(F.bit_or(F.when(V("role") == "HUSB", 1).otherwise(2)).alias("roles"))


def choose(groups: DataFrame, near: DataFrame | None = None, matched_roles: DataFrame | None = None) -> DataFrame:
    """groups: of ``name_groups``; near: (xref_a, xref_b, score) of pairs with matched relatives; matched_roles: (x, roles) of people
    of b, the roles in which their parents are matched. (xref_a, xref_b, score): pairs taken by descending score, then by
    xrefs, from ``near`` and from all others that reach AUTO by themselves.

    With a parent known on one side and a matched one in that role on the other, a pair is in ``near`` or contradicts it. A pair
    that is in ``near`` may be made again at its own score, which is less: one side of it is taken by then."""
    rows = groups
    if matched_roles is not None:
        mine = matched_roles.select("x", V("roles").alias("matched"), F.lit(choosing.B).alias("kind"))
        rows = rows.join(mine, ["x", "kind"], "left").withColumn("roles", F.coalesce("matched", "roles")).drop("matched")
    if near is not None:
        home = groups.filter(V("kind") == choosing.A).select(V("x").alias("xref_a"), "comp").distinct()
        near = near.join(home, "xref_a").select("comp", F.lit(choosing.NEAR).alias("kind"), V("xref_a").alias("x"), V("xref_b").alias("y"), V("score").alias("s"))
        rows = rows.unionByName(near, True)
    weights, least = dict(PERSON), AUTO

    def one(group: pd.DataFrame) -> pd.DataFrame:
        return choosing.Group(group, weights, least).choose(BANDS)

    tasks = 4 * groups.sparkSession.sparkContext.defaultParallelism
    return staged(rows.repartition(tasks, "comp").groupBy("comp").applyInPandas(one, choosing.CHOSEN), "chosen")


def kin_pairs(a: DataFrame, b: DataFrame, names: DataFrame, matched: DataFrame, parents_a: DataFrame, parents_b: DataFrame, spouses_a: DataFrame, spouses_b: DataFrame) -> DataFrame:
    """Pairs (xref_a, xref_b, score) of which a parent or a spouse is matched, with that as family context, and whatever their
    score; those that are no candidates or vetoed are not there. The other arguments as for ``name_groups`` and ``family_context``."""
    up = matched.join(parents_b.select(V("parent").alias("m_b"), V("child").alias("xref_b"), "role"), "m_b").join(parents_a.select(V("parent").alias("m_a"), V("child").alias("xref_a"), "role"), ["m_a", "role"])
    wed = matched.join(spouses_b.select(V("spouse").alias("m_b"), V("indi").alias("xref_b")), "m_b").join(spouses_a.select(V("spouse").alias("m_a"), V("indi").alias("xref_a")), "m_a")
    met = up.select("xref_a", "xref_b", F.lit(True).alias("parent"), F.lit(False).alias("wed")).unionByName(wed.select("xref_a", "xref_b", F.lit(False).alias("parent"), F.lit(True).alias("wed")))
    met = met.groupBy("xref_a", "xref_b").agg(F.bool_or("parent").alias("parent"), F.bool_or("wed").alias("wed"))
    pairs = compared(met.join(life(a, "a"), "xref_a").join(life(b, "b"), "xref_b").join(names, ["class_a", "class_b"]))
    pairs = pairs.withColumn("family", F.when(V("parent") & V("wed"), BEST_FAMILY).when(V("parent"), 0.90).otherwise(0.85))
    return pairs.select("xref_a", "xref_b", text.rounded4(total_score()).alias("score"))


def without_contradiction(pairs: DataFrame, matched: DataFrame, parents_a: DataFrame, parents_b: DataFrame) -> DataFrame:
    """pairs less those of which one's matched parent is not the other's: these never match by themselves."""
    ups_b = parents_b.select(V("child").alias("xref_b"), "role", V("parent").alias("m_b")).join(matched, "m_b").groupBy("xref_b").agg(F.collect_set(F.struct("role", "m_a")).alias("ups_b"))
    ups_a = parents_a.groupBy(V("child").alias("xref_a")).agg(F.collect_set(F.struct("role", "parent")).alias("ups_a"))
    rows = pairs.join(ups_b, "xref_b", "left").join(ups_a, "xref_a", "left")
    against = F.exists("ups_b", lambda x: F.exists("ups_a", lambda y: (x["role"] == y["role"]) & (x["m_a"] != y["parent"])))
    return rows.filter(~F.coalesce(against, F.lit(False))).select(*pairs.columns)


def family_context(pairs: DataFrame, matched: DataFrame, parents_a: DataFrame, parents_b: DataFrame, spouses_a: DataFrame, spouses_b: DataFrame) -> DataFrame:
    """pairs (xref_a, xref_b) with family: 0.05 if a matched parent of one is another's, 0.97 for parents and spouse
    matched, 0.90 a parent, 0.85 a spouse, else 0.5. matched: (m_a, m_b); parents: (child, role, parent); spouses: (indi, spouse)."""
    up = pairs.join(parents_b.select(V("child").alias("xref_b"), "role", V("parent").alias("m_b")), "xref_b").join(matched, "m_b").join(parents_a.select(V("child").alias("xref_a"), "role", V("parent").alias("p_a")), ["xref_a", "role"])
    up = up.groupBy("xref_a", "xref_b").agg(F.bool_or(V("p_a") != V("m_a")).alias("against"), F.bool_or(V("p_a") == V("m_a")).alias("parent"))
    wed = pairs.join(spouses_b.select(V("indi").alias("xref_b"), V("spouse").alias("m_b")), "xref_b").join(matched, "m_b").join(spouses_a.select(V("indi").alias("xref_a"), V("spouse").alias("m_a")), ["xref_a", "m_a"]).select("xref_a", "xref_b", F.lit(True).alias("wed")).distinct()
    rows = pairs.join(up, ["xref_a", "xref_b"], "left").join(wed, ["xref_a", "xref_b"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return rows.withColumn("family", F.when(yes("against"), 0.05).when(yes("parent") & yes("wed"), 0.97).when(yes("parent"), 0.90).when(yes("wed"), 0.85).otherwise(0.5)).drop("against", "parent", "wed")


def greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs whose sides no pair before has taken."""
    taken_a, taken_b = set(), set()
    for batch in batches:
        keep = []
        for a, b in zip(batch["xref_a"], batch["xref_b"]):
            keep.append(a not in taken_a and b not in taken_b)
            if keep[-1]:
                taken_a.add(a)
                taken_b.add(b)
        yield batch[keep]


def assign(scores: DataFrame, threshold: float, few: int = FEW) -> DataFrame:
    """scores: (xref_a, xref_b, score). A one-to-one choice: in each round the pairs that are best for both sides
    are taken (score, then xrefs), which is what taking pairs by descending score gives. The best pair of all is
    always taken, so rounds end; when few pairs are left, one task takes them in that order."""
    left = staged(scores.filter(V("score") >= threshold).select("xref_a", "xref_b", "score"), "pairs")
    best = lambda side, other: F.row_number().over(W.partitionBy(side).orderBy(V("score").desc(), other))
    chosen: list[DataFrame] = []
    while left.count() > few:
        ranked = staged(left.withColumn("ra", best("xref_a", "xref_b")).withColumn("rb", best("xref_b", "xref_a")), "ranked")
        mutual = ranked.filter("ra = 1 and rb = 1").select("xref_a", "xref_b", "score")
        chosen.append(mutual)
        left = staged(ranked.select("xref_a", "xref_b", "score").join(mutual.select("xref_a"), "xref_a", "left_anti").join(mutual.select("xref_b"), "xref_b", "left_anti"), "pairs")
    ordered = left.select("xref_a", "xref_b", "score").repartition(1).sortWithinPartitions(V("score").desc(), "xref_a", "xref_b")
    return staged(reduce(DataFrame.unionByName, chosen, ordered.mapInPandas(greedy, ordered.schema)), "chosen")


def source_classes(sources: DataFrame) -> DataFrame:
    """sources: (xref, title, author, publisher, repo), an xref once. (xref, class): sources of one title, author and publisher,
    with a repository or without, score alike; a class is named by its least xref."""
    low = lambda c: F.lower(F.coalesce(V(c), F.lit("")))
    key = ["title", low("author").alias("author"), low("publisher").alias("publisher"), (low("repo") != "").alias("repo")]
    return sources.select("xref", *key, F.min("xref").over(W.partitionBy(*key)).alias("class"))


def title_pairs(x: DataFrame, y: DataFrame, least: float) -> DataFrame:
    """x: (class_a, tokens_a), y: (class_b, tokens_b). Pairs (class_a, class_b), all those among them whose words have a Jaccard
    over ``least`` or of which one has all of the other's.

    Words are ranked by how few titles have them. Of n words more than least x n are shared, so that one of the first
    n - floor(least x n) is; of a title within another the first word is in the other. Titles without words meet each other."""
    word = lambda df, s: df.select(f"class_{s}", F.explode(F.when(F.size(f"tokens_{s}") == 0, F.array(F.lit(""))).otherwise(V(f"tokens_{s}"))).alias("w"))
    wx, wy = word(x, "a"), word(y, "b")
    counts = wx.select("w").unionByName(wy.select("w")).groupBy("w").agg(F.count("*").alias("n"))

    def ranked(words: DataFrame, s: str) -> DataFrame:
        one = W.partitionBy(f"class_{s}")
        place = F.row_number().over(one.orderBy("n", "w"))
        return staged(words.join(counts, "w").select(f"class_{s}", "w", place.alias("at"), F.count("*").over(one).alias("of")), "title-words")

    wx, wy = ranked(wx, "a"), ranked(wy, "b")
    first = lambda df: df.filter("at = 1").drop("at", "of")
    prefix = lambda df: df.filter(V("at") <= V("of") - F.floor(V("of") * least)).drop("at", "of")
    all_ = lambda df: df.drop("at", "of")
    met = [p.join(q, "w").select("class_a", "class_b") for p, q in ((prefix(wx), prefix(wy)), (first(wx), all_(wy)), (all_(wx), first(wy)))]
    return met[0].unionByName(met[1]).unionByName(met[2]).distinct()


def class_scores(a: DataFrame, b: DataFrame, threshold: float = REVIEW_SOURCE) -> DataFrame:
    """a, b: as ``source_classes`` gives them. (class_a, class_b, score) from the threshold on."""
    least = (threshold - 1e-4 - 1 + SOURCE["title"]) / SOURCE["title"]
    if least <= 0:
        raise ValueError("sources whose titles share no word reach this threshold")
    side = lambda df, s: df.filter(V("xref") == V("class")).select(V("class").alias(f"class_{s}"), text.title_tokens(V("title")).alias(f"tokens_{s}"), *[V(c).alias(f"{c}_{s}") for c in ("title", "author", "publisher", "repo")])
    x, y = staged(side(a, "a"), "sources"), staged(side(b, "b"), "sources")
    pairs = title_pairs(x, y, min(least, 0.5)).join(x, "class_a").join(y, "class_b")
    ja = text.jaccard(V("tokens_a"), V("tokens_b"))
    within = (F.size(F.array_except("tokens_a", "tokens_b")) == 0) | (F.size(F.array_except("tokens_b", "tokens_a")) == 0)
    subset = within & (F.size("tokens_a") > 0) & (F.size("tokens_b") > 0)
    prefix = lambda c: F.when(V(c).contains(","), F.lower(F.trim(F.substring_index(c, ",", 1))))
    pa, pb = prefix("title_a"), prefix("title_b")
    veto = F.coalesce(~(pa.startswith(pb) | pb.startswith(pa)), F.lit(False))
    pairs = pairs.filter(~veto & (subset | (ja >= min(least, 0.5))))
    fuzzy = text.indel_ratio(F.lower("title_a"), F.lower("title_b"))
    title = F.when(subset, 0.97).when((ja > 0.5) & (ja < 0.85), (ja + fuzzy) / 2).otherwise(ja)
    ratio = lambda c: F.when((V(f"{c}_a") == "") & (V(f"{c}_b") == ""), 1.0).when((V(f"{c}_a") == "") | (V(f"{c}_b") == ""), 0.0).otherwise(text.indel_ratio(f"{c}_a", f"{c}_b"))
    years = lambda s: F.filter(f"tokens_{s}", lambda t: t.rlike(r"^\d{4}$"))
    repo = F.when(V("repo_a") & V("repo_b"), 0.8).when(V("repo_a") | V("repo_b"), 0.0).otherwise(1.0)
    total = SOURCE["title"] * title + SOURCE["author"] * ratio("author") + SOURCE["publisher"] * ratio("publisher") + SOURCE["years"] * text.jaccard(years("a"), years("b")) + SOURCE["repo"] * repo
    return pairs.select("class_a", "class_b", text.rounded4(total).alias("score")).filter(V("score") >= threshold)


def source_scores(a: DataFrame, b: DataFrame, threshold: float = REVIEW_SOURCE) -> DataFrame:
    """a, b: (xref, title, author, publisher, repo), an xref once. All pairs (xref_a, xref_b, score) from the threshold on: as many
    as the square of a class that is in both. ``source_links`` leaves them by class."""
    a, b = staged(source_classes(a), "source-classes"), staged(source_classes(b), "source-classes")
    members = lambda df, s: df.select(V("xref").alias(f"xref_{s}"), V("class").alias(f"class_{s}"))
    return class_scores(a, b, threshold).join(members(a, "a"), "class_a").join(members(b, "b"), "class_b").select("xref_a", "xref_b", "score")


def source_links(sources: DataFrame, threshold: float = REVIEW_SOURCE) -> DataFrame:
    """What ``source_scores`` finds between sources and themselves, by class: (kind, xref_a, xref_b, score, links). A ``pair``
    has two classes, named by a member each, and the number of pairs of sources that it stands for; a ``member`` a source, its
    class, the score of two sources of it (null below the threshold) and how many sources the source is linked to, itself included."""
    classes = staged(source_classes(sources), "source-classes")
    scores = staged(class_scores(classes, classes, threshold), "source-pairs")
    sizes = classes.groupBy("class").agg(F.count("*").alias("n"))
    size = lambda s: sizes.select(V("class").alias(f"class_{s}"), V("n").alias(f"n_{s}"))
    sized = scores.join(size("a"), "class_a").join(size("b"), "class_b")
    pairs = sized.select(F.lit("pair").alias("kind"), V("class_a").alias("xref_a"), V("class_b").alias("xref_b"), "score", (V("n_a") * V("n_b")).alias("links"))
    own = F.max(F.when(V("class_a") == V("class_b"), V("score")))
    of = sized.groupBy(V("class_a").alias("class")).agg(F.sum("n_b").alias("links"), own.alias("score"))
    members = classes.select("xref", "class").join(of, "class", "left")
    members = members.select(F.lit("member").alias("kind"), V("xref").alias("xref_a"), V("class").alias("xref_b"), "score", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return pairs.unionByName(members)


def match_families(a: DataFrame, b: DataFrame, people: DataFrame) -> DataFrame:
    """a, b: (xref, husb, wife, chil); people: (m_a, m_b). (xref_b, xref_a, rule): both spouses; one spouse and a
    child; two children and no spouse against. Most shared children, then the smaller xref, win."""
    mapped = b.join(people.select(V("m_b").alias("husb"), V("m_a").alias("h")), "husb", "left").join(people.select(V("m_b").alias("wife"), V("m_a").alias("w")), "wife", "left")
    kids = b.select(V("xref").alias("xref_b"), F.explode_outer("chil").alias("m_b")).join(people, "m_b").select("xref_b", V("m_a").alias("kid"))
    own = a.select(V("xref").alias("xref_a"), F.explode_outer("chil").alias("kid"))
    shared = kids.join(own, "kid").groupBy("xref_a", "xref_b").agg(F.count("*").alias("shared"))
    m = mapped.select(V("xref").alias("xref_b"), "h", "w")
    f = a.select(V("xref").alias("xref_a"), V("husb").alias("ah"), V("wife").alias("aw"))
    couple = m.join(f, (V("h") == V("ah")) & (V("w") == V("aw"))).select("xref_b", "xref_a", F.lit(1).alias("rule"), F.lit(0).cast("long").alias("shared"))
    by_kids = shared.join(m, "xref_b").join(f, "xref_a")
    one = by_kids.filter((V("h") == V("ah")) | (V("w") == V("aw"))).select("xref_b", "xref_a", F.lit(2).alias("rule"), "shared")
    against = F.coalesce(V("h") != V("ah"), F.lit(False)) | F.coalesce(V("w") != V("aw"), F.lit(False))
    two = by_kids.filter((V("shared") >= 2) & ~against).select("xref_b", "xref_a", F.lit(3).alias("rule"), "shared")
    order = W.partitionBy("xref_b").orderBy("rule", V("shared").desc(), "xref_a")
    return couple.unionByName(one).unionByName(two).withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def id_map(matches: DataFrame, unmatched: DataFrame, prefix: str = "I") -> DataFrame:
    """(xref_b, xref_a): matched ids, and new ones in order for those to add: numbered in ranges of ids, after the
    counts of the ranges before."""
    dealt = unmatched.select("xref_b").repartitionByRange("xref_b").withColumn("part", F.spark_partition_id())
    dealt = staged(dealt, "id-ranges")
    ends = dealt.groupBy("part").agg(F.count("*").alias("n"))
    ends = ends.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - V("n")).alias("before"))
    n = F.row_number().over(W.partitionBy("part").orderBy("xref_b")) + V("before")
    new = dealt.join(ends, "part").select("xref_b", F.format_string(f"@{prefix}_MERGE_%04d@", n).alias("xref_a"))
    return matches.select("xref_b", "xref_a").unionByName(new)


def remapped(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """rows with a column's ids replaced where the map has them."""
    m = ids.select(V("xref_b").alias("_from"), V("xref_a").alias("_to"))
    return rows.join(m, V(column) == V("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def prefer_date(a: Column, b: Column) -> Column:
    return F.when(dates.specificity(b) > dates.specificity(a), b).otherwise(a)


def prefer_place(a: Column, b: Column) -> Column:
    parts = lambda p: F.size(text.place_parts(F.coalesce(p, F.lit(""))))
    return F.when(parts(b) > parts(a), b).otherwise(F.coalesce(a, b))


def merge_unique(a: DataFrame, b: DataFrame, owner: str, key: Column, order: str) -> DataFrame:
    """Rows of a, then those of b whose key the owner has not: notes by trimmed text, names by given and surname,
    citations by source and page, links by id."""
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)))
    first = W.partitionBy(owner, key).orderBy("_side", order)
    return both.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_side")


def merge_people(a: DataFrame, b: DataFrame, ids: DataFrame) -> DataFrame:
    """Full outer merge by the id map: sex and dates of a unless b's say more, lists united, new people added."""
    mapped = remapped(b, "xref", ids).select("xref", *[V(c).alias(f"{c}_b") for c in b.columns if c != "xref"])
    rows = a.join(mapped, "xref", "full_outer")
    lists = [c for c, t in a.dtypes if t.startswith("array") and c in b.columns]
    empty = lambda c: F.coalesce(V(c), F.array().cast(dict(rows.dtypes)[c]))
    out = [V("xref"), F.coalesce("sex", "sex_b").alias("sex")]
    out += [F.array_union(empty(c), empty(f"{c}_b")).alias(c) for c in lists]
    out += [prefer_date(V(c), V(f"{c}_b")).alias(c) for c in ("birth", "death") if c in a.columns]
    return rows.select(*out)


def merge_citations(citations: DataFrame) -> DataFrame:
    """citations: (owner, side, ord, source, page). One for each source and page; of pages of one source where one
    holds another, the longer stays."""
    page = F.lower(F.coalesce("page", F.lit("")))
    rows = citations.withColumn("p", page).withColumn("n", F.row_number().over(W.partitionBy("owner", "source", "p").orderBy("side", "ord"))).filter("n = 1")
    longer = F.max(F.struct(F.char_length("p"), "p")).over(W.partitionBy("owner", "source"))["p"]
    return rows.withColumn("longest", longer).filter((V("p") == V("longest")) | ~F.contains("longest", "p")).drop("p", "n", "longest")


def canonical_sources(pairs: DataFrame, keep: DataFrame) -> DataFrame:
    """pairs: (a, b) of sources that are one; keep: (xref). (xref_b, xref_a): the source that stands for each: of a
    component the one that is not newly numbered, then the smallest."""
    found = components(pairs)
    rank = F.struct(V("node").contains("_MERGE_"), "node")
    best = found.groupBy("component").agg(F.min(rank).alias("m"))
    return found.join(best, "component").select(V("node").alias("xref_b"), V("m")["node"].alias("xref_a")).filter("xref_a <> xref_b").join(keep.select(V("xref").alias("xref_b")), "xref_b", "left_semi")


def search_top(queries: DataFrame, people: DataFrame, n: int = 3) -> DataFrame:
    """queries, people: as for person_scores. The n best candidates for each query with a score over zero."""
    scores = person_scores(people, queries)
    order = W.partitionBy("xref_b").orderBy(V("score").desc(), "xref_a")
    return scores.filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(V("rank") <= n).select("xref_b", "rank", "xref_a", "score")
