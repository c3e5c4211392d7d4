import pytest
from pyspark.sql import functions as F

from kinloom.functions import dates, text
from kinloom.operators import checks, edits, graph, households, linkage, merging, rewrites
from kinloom.plans import pipelines
from kinloom.sources import lineage

FILE = """0 HEAD
1 GEDC
2 VERS 5.5.1
1 CHAR UTF-8
0 @I1@ INDI
1 NAME Anna "Annie" /Berg/
2 GIVN Anna
1 SEX F
1 BIRT
2 DATE about 1850
2 PLAC Oslo ,Norway
2 SOUR @S1@
3 PAGE p. 1
2 SOUR @S1@
3 PAGE p. 1
1 NOTE one
2 CONC  two
2 CONT three
1 FAMS @F1@
0 @I2@ INDI
1 NAME Karl /Berg/
1 SEX M
1 DEAT
2 DATE 3 mar 1840
1 BIRT
2 DATE 1848
1 FAMS @F1@
0 @I3@ INDI
1 NAME Eva /Berg/
3 DATE 1 JAN 2000
1 FAMC @F1@
0 @F1@ FAM
1 HUSB @I2@
1 WIFE @I1@
1 CHIL @I3@
1 CHIL @I9@
0 @S1@ SOUR
1 TITL Parish register
0 TRLR
"""


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("ged")
    (folder / "one.ged").write_text("﻿" + FILE.replace("\n", "\r\n"), encoding="utf-8")
    return lineage.parse_lines(lineage.read_raw(spark, str(folder))).persist()


def found(lines, name):
    return {(r.xref, r.detail) for r in checks.RULES[name][1](checks.Scan(lines)).collect()}


def test_lines_keep_order_and_parents(lines):
    rows = {r.lineno: r for r in lines.collect()}
    assert [rows[k].raw for k in sorted(rows)] == FILE.splitlines()
    assert rows[13].parent_lineno == 12 and rows[13].l1_no == 9 and rows[13].rec_xref == "@I1@"


def test_continuations_fold(lines):
    assert lineage.fold(lines).filter("tag = 'NOTE'").first().value == "one two\nthree"


def test_tables(lines):
    e = {(r.owner_xref, r.tag): r.date_raw for r in lineage.events(lines).collect()}
    assert e["@I2@", "DEAT"] == "3 mar 1840" and e["@I1@", "BIRT"] == "about 1850"
    assert {(r.role, r.indi) for r in lineage.edges(lines).collect()} == {("HUSB", "@I2@"), ("WIFE", "@I1@"), ("CHIL", "@I3@"), ("CHIL", "@I9@")}
    assert [r.page for r in lineage.citations(lines).collect()] == ["p. 1", "p. 1"]


@pytest.mark.parametrize(
    ("rule", "expected"),
    [
        ("level_jump", {("@I3@", "1>3")}), ("missing_sex", {("@I3@", "INDI")}), ("broken_xref", {("@F1@", "CHIL @I9@")}), ("duplicate_citation", {("@I1@", "@S1@")}),
        ("nickname_in_name", {("@I1@", 'Anna "Annie" /Berg/')}), ("death_before_birth", {("@I2@", "8")}), ("unsorted_events", {("@I2@", "1")}), ("plac_spacing", {("@I1@", "Oslo ,Norway")}),
        ("header_fields", {("", "SOUR"), ("", "SUBM"), ("", "GEDC.FORM")}), ("parent_too_young", set()),
    ],
)
def test_rules(lines, rule, expected):
    assert found(lines, rule) == expected


def test_violations_name_rule_and_severity(lines):
    rows = checks.violations(checks.Scan(lines), ("level_jump", "missing_sex")).collect()
    assert {(r.check, r.severity) for r in rows} == {("level_jump", "ERROR"), ("missing_sex", "WARNING")}


@pytest.mark.parametrize("name", ["normalize_dates", "date_caps", "nicknames", "plac", "duplicate_citations", "sort_events", "record_order", "name_pieces", "dangling_pointers"])
def test_rewrites_settle(lines, name):
    once = rewrites.renumbered(rewrites.FIXES[name](lines)).persist()
    assert rewrites.changes(lines, rewrites.FIXES[name](lines)).count() or name == "record_order"
    assert rewrites.changes(once, rewrites.FIXES[name](once)).count() == 0


def test_sorted_events_take_each_others_places(lines):
    raws = [r.raw for r in rewrites.renumbered(rewrites.FIXES["sort_events"](lines)).filter("rec_xref = '@I2@'").orderBy("lineno").collect()]
    assert raws == ["0 @I2@ INDI", "1 NAME Karl /Berg/", "1 SEX M", "1 BIRT", "2 DATE 1848", "1 DEAT", "2 DATE 3 mar 1840", "1 FAMS @F1@"]


def test_normalize_writes_or_only_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ged").write_text(FILE)
    steps = ("normalize_dates", "duplicate_citations")
    dry = pipelines.normalize(spark, str(tmp_path / "in"), None, steps).collect()
    wet = pipelines.normalize(spark, str(tmp_path / "in"), str(tmp_path / "out"), steps).collect()
    assert [(r.added, r.removed) for r in dry] == [(r.added, r.removed) for r in wet] == [(2, 4)]
    assert "2 DATE ABT 1850" in [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]


def test_edits(lines):
    now = rewrites.renumbered(edits.add_note(lines, "@I2@", "a@b\nc")).persist()
    assert [r.raw for r in edits.nth_block(now, "@I2@", "NOTE").collect()] == ["1 NOTE a@@b"]
    gone = rewrites.renumbered(edits.delete_block(now, "@I2@", "NOTE"))
    assert rewrites.changes(lines, rewrites.out(gone)).count() == 0
    left = rewrites.renumbered(rewrites.delete_person(lines, lines.first().file_id, "@I2@"))
    assert not left.filter(F.col("raw").contains("@I2@")).count() and left.filter("raw = '1 WIFE @I1@'").count()
    event = rewrites.renumbered(edits.edit_event(lines, "@I2@", "BIRT", 0, {"DATE": "1849", "PLAC": "Rome"}))
    assert event.filter("raw in ('2 DATE 1849', '2 PLAC Rome')").count() == 2


@pytest.mark.parametrize(
    ("written", "normal"),
    [("1900-03-15", "15 MAR 1900"), ("1880-1890", "BET 1880 AND 1890"), ("about 1850", "ABT 1850"), ("the 3rd of March 1850", "3 MAR 1850"), ("12/24/1850", "24 DEC 1850"), ("mai 1850", "MAY 1850"), ("before April 2, 1850", "BEF 2 APR 1850")],
)
def test_normal_dates(spark, written, normal):
    assert spark.range(1).select(dates.normalize_date(F.lit(written)).alias("x")).first().x == normal


def test_parsed_dates(spark):
    parsed = lambda v: spark.range(1).select(dates.parse_date(F.lit(v)).alias("d")).first().d
    assert tuple(parsed("BET 1888 AND 1892")) == ("BET", 1888, None, None, 1892)
    assert tuple(parsed("CAL 1890")) == ("ABT", 1890, None, None, None) and parsed("TO 1890") is None and parsed("x") is None
    assert tuple(parsed("3 MAR 1850")) == (None, 1850, 3, 3, None)


@pytest.mark.parametrize(("a", "b", "score"), [("3 MAR 1850", "3 MAR 1850", 1.0), ("MAR 1850", "MAR 1850", 0.9), ("1850", "1850", 0.8), ("1850", "1852", 0.5), ("1850", "x", 0.3), ("1850", "1870", 0.0), ("ABT 1850", "1851", 0.7), ("ABT 1850", "1856", 0.4)])
def test_date_overlap(spark, a, b, score):
    assert spark.range(1).select(dates.date_overlap(dates.parse_date(F.lit(a)), dates.parse_date(F.lit(b))).alias("x")).first().x == score


def test_place_similarity(spark):
    of = lambda a, b: spark.range(1).select(text.place_similarity(F.lit(a), F.lit(b)).alias("x")).first().x
    assert of("", None) == 1.0 and of("Oslo", "") == 0.0 and of("Oslo, Norway", "oslo, norway,") == 1.0 and abs(of("Oslo, Norway", "Oslo, Sweden") - (1 / 3 + 0.2)) < 1e-9


def test_indel_ratio_is_by_common_subsequence():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return 2 * t[-1][-1] / (len(a) + len(b)) if a or b else 1.0

    for a, b in [("hancy", "banca"), ("smith", "smyth"), ("", ""), ("a", ""), ("müller", "mueller")]:
        assert text._indel(a, b) == pytest.approx(plain(a, b))


def test_assign_is_greedy_by_score(spark):
    rows = [("a1", "b1", 0.9), ("a1", "b2", 0.95), ("a2", "b2", 0.9), ("a2", "b1", 0.8), ("a3", "b3", 0.7), ("a4", "b3", 0.99)]
    taken, expected = set(), set()
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if s >= 0.75 and a not in taken and b not in taken:
            taken |= {a, b}
            expected.add((a, b))
    got = linkage.assign(spark.createDataFrame(rows, "xref_a string, xref_b string, score double"), 0.75).collect()
    assert {(r.xref_a, r.xref_b) for r in got} == expected


def test_assign_by_rounds_and_by_one_task_agree(spark):
    rows = [(f"a{k % 7}", f"b{k % 5}", 0.75 + k % 4 / 100) for k in range(35)]
    chosen, taken = set(), set()
    for x, y, score in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if not {x, y} & taken:
            taken |= {x, y}
            chosen.add((x, y, score))
    df = spark.createDataFrame(rows, "xref_a string, xref_b string, score double")
    for few in (100, 12, 0):
        assert {tuple(r) for r in linkage.assign(df, 0.75, few).collect()} == chosen


def test_close_keys_are_all_within_two_edits(spark):
    words = ["smith", "smyth", "smithe", "smit", "olsen", "olson", "hansen", "jansen", "johansen", "lee", "lea"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, last = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
        return row[-1]

    df = spark.createDataFrame([(w,) for w in words], "key string")
    got = {(r.key_a, r.key_b) for r in linkage.close_keys(df, df).collect()}
    assert got == {(a, b) for a in words for b in words if a == b or (min(len(a), len(b)) >= 5 and distance(a, b) <= 2)}


def test_same_people_are_linked_to_themselves(lines):
    got = {(r.xref_a, r.xref_b) for r in pipelines.link(lines, lines, rounds=1).collect()}
    assert got and all(a == b for a, b in got)


def test_linkage_and_source_scores_take_all_files(spark, tmp_path):
    from kinloom import queries

    names = ["Anna", "Karl", "Olga", "Ivar", "Ruth", "Emma"]
    people = [(k, c, n) for k, c in enumerate(["Berg", "Quist", "Zamora"]) for n in names]
    raw = []
    for k, surname in enumerate(["Berg", "Quist", "Zamora"]):
        rows = [x for i, n in enumerate(names) for x in (f"0 @I{i}@ INDI", f"1 NAME {n} /{surname}/", "1 SEX " + "FMFMFF"[i], "1 BIRT", f"2 DATE {3 + i} MAY {1700 + 60 * k + i}", "2 PLAC Oslo, Norway", "1 DEAT", f"2 DATE {1750 + 60 * k + i}", "2 PLAC Oslo, Norway")]
        raw += [(f"f{k}", n, x) for n, x in enumerate([*rows, "0 @S1@ SOUR", f"1 TITL {surname} parish register"])]
    parsed = lineage.parse_lines(spark.createDataFrame(raw, "file_id string, lineno long, raw string")).persist()
    queries._LINES[(spark.sparkContext.applicationId, id(spark), str(tmp_path))] = parsed
    got = {(r.xref_a, r.xref_b) for r in queries.q_link(spark, str(tmp_path)).collect()}
    assert got == {(f"@f{k}:I{names.index(n)}@",) * 2 for k, _, n in people}
    assert {(r.xref_a, r.xref_b) for r in queries.q_source_scores(spark, str(tmp_path)).collect() if r.xref_a == r.xref_b} == {(f"@f{k}:S1@",) * 2 for k in range(3)}


def test_choices_in_groups_of_names_are_those_of_all_pairs(spark):
    """Against all scored pairs taken in order: every kind of date, places, sexes, names alike; pairs of relatives, known parents."""
    import random

    from pyspark.sql import functions as F

    from kinloom.functions import dates

    rng = random.Random(7)

    def person(side, k):
        date = lambda e: rng.choice([None, "{y}", "5 MAY {y}", "MAY {y}", "6 MAY {y}", "ABT {y}", "BEF {y}", "AFT {y}", "BET {y} AND {z}"])
        years = lambda d, low: d and d.format(y=rng.randint(low, low + 14), z=rng.randint(low, low + 20))
        place = lambda: rng.choice([None, "", "Oslo, Norway", "Oslo, Norway,", "Oslo, Sweden", "Rome"])
        return (f"{side}{k:03}", rng.choice(["anna", "anna maria", "ann", "karl"]), rng.choice(["smith", "smyth", "olsen"]), rng.choice(["M", "F", "F", None]), years(date("b"), 1800), place(), years(date("d"), 1850), place())

    columns = "xref string, given string, surname string, sex string, b string, birth_place string, d string, death_place string"
    rows = {s: [person(s, k) for k in range(150)] for s in "ab"}
    a, b = (
        spark.createDataFrame(rows[s], columns).withColumn("birth", dates.parse_date(F.coalesce("b", F.lit("")))).withColumn("death", dates.parse_date(F.coalesce("d", F.lit("")))).drop("b", "d").persist()
        for s in "ab"
    )
    pairs = [(r.xref_a, r.xref_b, r.score) for r in linkage.person_scores(a, b).filter(F.col("score") >= linkage.AUTO).collect()]
    near = [(x[0], y[0], rng.choice([0.9, 0.85, 0.8, 0.76])) for x, y in zip(rows["a"], rows["b"]) if (x[2] == "olsen") == (y[2] == "olsen")]
    parents = [(f"a{k:03}", role, "p") for k in range(0, 150, 2) for role in ("HUSB", "WIFE")[: 1 + k % 3 // 2]]
    matched = {f"b{k:03}": 1 + k % 3 for k in range(0, 150, 4)}
    roles = {}
    for child, role, _ in parents:
        roles[child] = roles.get(child, 0) | (1 if role == "HUSB" else 2)

    def taken(rows):
        used, out = set(), set()
        for x, y, score in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
            if not {x, y} & used:
                used |= {x, y}
                out.add((x, y, score))
        return out

    pa, pb = linkage.name_classes(a), linkage.name_classes(b)
    names = linkage.name_scores(*(p.filter("xref = class") for p in (pa, pb))).withColumnsRenamed({"xref_a": "class_a", "xref_b": "class_b"})
    groups = linkage.name_groups(pa, pb, names, spark.createDataFrame(parents, "child string, role string, parent string"))
    assert len(pairs) > 100 and len(near) > 50
    assert {tuple(r) for r in linkage.choose(groups).collect()} == taken(pairs)
    got = linkage.choose(groups, spark.createDataFrame(near, "xref_a string, xref_b string, score double"), spark.createDataFrame(list(matched.items()), "x string, roles int"))
    free = [r for r in pairs if not roles.get(r[0], 0) & matched.get(r[1], 0)]
    assert {tuple(r) for r in got.collect()} == taken(near + free)


def test_linking_writes_no_table_of_all_pairs_of_a_name(spark, monkeypatch):
    n, sizes = 300, []
    raw = [("f", j, x) for k in range(n) for j, x in enumerate((f"0 @I{k:03}@ INDI", "1 NAME Anna /Berg/", "1 SEX F", "1 BIRT", f"2 DATE AFT {1800 + k % 40}", "2 PLAC Oslo"), 6 * k)]
    lines = lineage.parse_lines(spark.createDataFrame(raw, "file_id string, lineno long, raw string")).persist()

    def counted(df, tag, real=linkage.staged):
        sizes.append((out := real(df, tag)).count())
        return out

    monkeypatch.setattr(linkage, "staged", counted)
    monkeypatch.setattr(pipelines, "staged", counted)
    got = {(r.xref_a, r.xref_b) for r in pipelines.link(lines, lines, rounds=1).collect()}
    assert got == {(f"@I{k:03}@",) * 2 for k in range(n)}
    assert max(sizes) <= 3 * n


def test_sources_are_scored_by_class(spark):
    """Against all pairs by brute force: titles without words, copies, titles within others, equal prefixes, repeated words."""
    import random
    import string

    rng = random.Random(5)
    words = ["parish", "register", "of", "oslo", "census", "1850", "1860", "boston", "a", "history", "the", "Berlin,", "Oslo,"]
    titles = ["?", "", "-", "X", "Oslo", "Census 1850, Boston", "The Boston census 1850"] + [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(60)]
    rows = [(f"S{k:03}", rng.choice(titles), rng.choice([None, "Nils Berg", "NILS Berg", "N. Berg"]), rng.choice([None, "", "Oslo, 1850"]), rng.choice([None, "@R1@", "@R2@"])) for k in range(180)]
    rows += [(f"T{k:03}", "Parish register of Oslo", None, None, None) for k in range(60)]
    ratio = lambda x, y: 1.0 if not x and not y else 0.0 if not x or not y else text._indel(x, y)
    jaccard = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
    tokens = lambda t: {w for w in t.lower().translate(str.maketrans(string.punctuation, " " * 32)).split() if len(w) > 1}

    def score(x, y):
        s, t = tokens(x[1]), tokens(y[1])
        p, q = (z[1].split(",")[0].strip().lower() if "," in z[1] else None for z in (x, y))
        j = jaccard(s, t)
        title = 0.97 if s and t and (s <= t or t <= s) else (j + text._indel(x[1].lower(), y[1].lower())) / 2 if 0.5 < j < 0.85 else j
        title = 0.0 if p is not None and q is not None and not (p.startswith(q) or q.startswith(p)) else title
        author, publisher = (ratio((x[k] or "").lower(), (y[k] or "").lower()) for k in (2, 3))
        years = jaccard(*({w for w in z if w.isdigit() and len(w) == 4} for z in (s, t)))
        return round(0.6 * title + 0.15 * author + 0.1 * publisher + 0.1 * years + 0.05 * (0.8 if x[4] and y[4] else 0.0 if x[4] or y[4] else 1.0), 4)

    df = spark.createDataFrame(rows, "xref string, title string, author string, publisher string, repo string")
    for threshold in (0.85, 0.65):
        want = {(x[0], y[0]): z for x in rows for y in rows if (z := score(x, y)) >= threshold}
        pairs = linkage.source_scores(df, df, threshold).collect()
        assert len(pairs) == len(want) and {(r.xref_a, r.xref_b): r.score for r in pairs} == want
        links = linkage.source_links(df, threshold).collect()
        of = {r.xref_a: r.xref_b for r in links if r.kind == "member"}
        scores = {(r.xref_a, r.xref_b): r.score for r in links if r.kind == "pair"}
        assert {(x, y): scores[of[x], of[y]] for x in of for y in of if (of[x], of[y]) in scores} == want
        assert {r.xref_a: r.links for r in links if r.kind == "member"} == {x[0]: sum(k[0] == x[0] for k in want) for x in rows}
        assert sum(r.links for r in links if r.kind == "pair") == len(want) and len({of[r[0]] for r in rows if r[0] > "T"}) == 1


def test_graph(spark, lines):
    e = lineage.edges(lines)
    up = graph.parents_of(e).select("child", "father", "mother")
    assert {(r.k, r.indi) for r in graph.ancestors(up, "@I3@").collect()} == {(1, "@I3@"), (2, "@I2@"), (3, "@I1@")}
    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 40), (40, 50), (7, 7)], "a long, b long")
    assert {(r.node, r.component) for r in graph.components(links).collect()} == {(k, 0) for k in range(31)} | {(40, 40), (50, 40)}


def test_watch_appends_new_files(spark, tmp_path):
    from kinloom.streaming.watch import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ged").write_text(FILE)
    for _ in range(2):
        watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), ("missing_sex",), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_given_names_of_one_group_stand_for_each_other(spark):
    pairs = [("stephen", "stefan"), ("nicholas", "nikolaos"), ("thomas", "tommaso"), ("alexander", "alexandros"), ("teresa", "therese"), ("julia", "giulia"), ("john", "yanni"), ("sofronia", "subru")]
    df = spark.createDataFrame([*pairs, ("mary", "anna"), ("karl", "john")], "a string, b string")
    got = [r.x for r in df.coalesce(1).select((linkage.canonical_given(F.col("a")) == linkage.canonical_given(F.col("b"))).alias("x")).collect()]
    assert got == [True] * len(pairs) + [False, False] and len(linkage.ALIASES) == 51


def test_all_events_and_attributes_have_ordered_children(spark):
    tags = "WILL BARM BASM BLES CHRA FCOM ORDN CAST DSCR IDNO NATI NCHI NMR PROP RELI SSN TITL ANUL DIVF ENGA MARB MARC MARL MARS BIRT".split()
    raw = ["0 HEAD"]
    for k, tag in enumerate(tags):
        raw += [f"0 @I{k}@ INDI", f"1 {tag}", "2 NOTE n", "2 SOUR @S1@", "3 PAGE p", "2 DATE 1900"]
    raw += ["0 @W@ INDI", "1 WILL", "2 DATE 1900", "1 EMIG", "2 DATE 1880", "0 TRLR"]
    rows = lineage.parse_lines(spark.createDataFrame([("f", k, x) for k, x in enumerate(raw, 1)], "file_id string, lineno long, raw string"))
    assert {x for x, _ in found(rows, "event_source_order")} == {f"@I{k}@" for k in range(len(tags))} and len(lineage.ORDERED_TAGS) == 46
    assert {x for x, _ in found(rows, "unsorted_events")} == {"@W@"}
    fixed = [r.raw for r in rewrites.FIXES["event_source_order"](rows).orderBy("lineno", "seq").collect()]
    for k, tag in enumerate(tags):
        at = fixed.index(f"0 @I{k}@ INDI")
        assert fixed[at + 1 : at + 6] == [f"1 {tag}", "2 DATE 1900", "2 SOUR @S1@", "3 PAGE p", "2 NOTE n"]


def parsed(spark, text, file_id="f"):
    rows = [(file_id, k + 1, x) for k, x in enumerate(text.strip().split("\n"))]
    return lineage.parse_lines(spark.createDataFrame(rows, "file_id string, lineno long, raw string"))


def rewritten(lines, name):
    return [r.raw for r in rewrites.FIXES[name](lines).orderBy("lineno", "seq").collect()]


def test_parents_at_any_depth(spark):
    levels = [*range(16), 9, 14, 3, 20, 8, 7, 7, 12, 1, 8, 0, 5]
    got = {r.lineno: r.parent_lineno for r in parsed(spark, "\n".join(f"{x} TAG" for x in levels)).collect()}
    for k, x in enumerate(levels):
        head = max(j for j in range(k + 1) if levels[j] == 0)
        above = [j + 1 for j in range(head, k) if levels[j] < x]
        assert got[k + 1] == (above[-1] if above else None)


def test_charsets(spark, tmp_path):
    text = "0 HEAD\n1 CHAR {}\n0 @I1@ INDI\n1 NOTE it’s “é” – ok\n"
    for name, charset, codec in (("a", "ANSI", "cp1252"), ("b", "UTF-8", "utf-8"), ("c", "UTF-8", "utf-8-sig"), ("d", "UNICODE", "utf-16"), ("e", "UTF-8", "cp1252"), ("f", "IBMPC", "utf-8")):
        (tmp_path / name).write_bytes(text.format(charset).encode(codec))
    got = {(r.file_id[-1], r.raw) for r in lineage.read_raw(spark, str(tmp_path)).filter("lineno in (1, 4)").collect()}
    assert got == {(n, x) for n in "abcdef" for x in ("0 HEAD", "1 NOTE it’s “é” – ok")}


def test_duplicate_events_become_one_with_all_sources(spark):
    text = """0 @I1@ INDI
1 BIRT
2 DATE 1850
2 SOUR @S1@
3 PAGE 4
1 DEAT Y
1 BIRT
2 SOUR @S1@
3 PAGE 4
2 DATE 1850
2 SOUR @S2@
3 PAGE 7
2 NOTE gone
1 BIRT
2 DATE 1851
1 BIRT
2 DATE 1850
2 SOUR @S2@
3 PAGE 7
1 DEAT
2 SOUR @S3@"""
    want = """0 @I1@ INDI
1 BIRT
2 DATE 1850
2 SOUR @S1@
3 PAGE 4
2 SOUR @S2@
3 PAGE 7
1 DEAT Y
2 SOUR @S3@
1 BIRT
2 DATE 1851"""
    assert rewritten(parsed(spark, text), "duplicate_events") == want.split("\n")


def test_web_links(spark):
    url = "https://www.ancestry.com/family-tree/person/tree/5/person/"
    text = f"""0 @I1@ INDI
1 _WLNK
2 TITL Godfather: Karl
2 NOTE {url}2
1 SEX F
1 _WLNK
2 TITL Other
2 NOTE {url}77
0 @I2@ INDI
1 _WLNK
2 TITL Page
2 NOTE https://x.example"""
    want = ["0 @I1@ INDI", "1 ASSO @I2@", "2 RELA Godfather", "1 SEX F", f"1 NOTE Other (person not in tree): {url}77", "0 @I2@ INDI", "1 NOTE Page: https://x.example"]
    assert rewritten(parsed(spark, text), "web_links") == want


def test_long_cycles_are_found(spark):
    ring = [(k, (k + 1) % 90) for k in range(90)] + [(200 + k, 201 + k) for k in range(50)]
    got = graph.cycles(spark.createDataFrame(ring, "child long, parent long"))
    assert {r.node for r in got.collect()} == set(range(90))


def test_files_with_alike_names_are_written_apart(spark, tmp_path):
    both = parsed(spark, "0 HEAD", "a/b").unionByName(parsed(spark, "0 TRLR", "a_b"))
    rewrites.write_lines(rewrites.out(both), f"file://{tmp_path}/out")
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("file=")]) == 2


def test_lint_takes_line_rules_and_others_together(spark):
    lines = parsed(spark, FILE)
    scan = checks.Scan(lines)
    got = {(r.check, r.severity, r.lineno, r.xref, r.detail) for r in checks.violations(scan).collect()}
    some = ("date_no_year", "date_bad_format", "nickname_in_name", "level_jump", "broken_xref", "duplicate_citation", "date_consistency")
    want = {(n, checks.RULES[n][0], *r[1:]) for n in some for r in checks.RULES[n][1](scan).collect()}
    assert want and {g for g in got if g[0] in some} == want and {r.check for r in checks.violations(scan, ("date_no_year", "level_jump")).collect()} <= {"date_no_year", "level_jump"}


FAMILIES = """0 @I1@ INDI
1 FAMS @F1@
1 FAMS @F1_MERGE_2@
1 FAMS @F9@
0 @I2@ INDI
1 FAMS @F3@
0 @I3@ INDI
1 FAMC @F3@
0 @I4@ INDI
1 FAMS @F8@
0 @F1@ FAM
1 HUSB @I1@
1 WIFE @I2@
1 MARR
2 DATE 3 MAR 1850
1 CHIL @I5@
0 @F1_MERGE_2@ FAM
1 HUSB @I1@
1 WIFE @I2@
1 MARR
2 DATE 1850
2 PLAC Oslo
1 MARR
2 DATE 1851
2 SOUR @S1@
1 DIV
1 CHIL @I5@
1 CHIL @I6@
1 NOTE gone
1 SOUR @S1@
2 PAGE 2
0 @F3@ FAM
1 HUSB @I1@
1 WIFE @I2@
1 CHIL @I3@
0 @F8@ FAM
1 HUSB @I4@
0 @F9@ FAM
1 HUSB @I1@
1 WIFE @I7@"""


def test_families_of_one_couple_become_one(spark):
    want = """0 @I1@ INDI
1 FAMS @F1@
0 @I2@ INDI
1 FAMS @F1@
0 @I3@ INDI
1 FAMC @F1@
0 @I4@ INDI
1 FAMS @F8@
0 @F1@ FAM
1 HUSB @I1@
1 WIFE @I2@
1 MARR
2 DATE 3 MAR 1850
1 CHIL @I5@
1 MARR
2 DATE 1851
2 SOUR @S1@
1 DIV
1 CHIL @I6@
1 CHIL @I3@
1 SOUR @S1@
2 PAGE 2
0 @F8@ FAM
1 HUSB @I4@"""
    assert rewritten(parsed(spark, FAMILIES), "duplicate_families") == want.split("\n")


def test_families_that_say_nothing_go_unless_they_are_the_only_link(spark):
    got = rewritten(parsed(spark, FAMILIES), "empty_families")
    assert got == [x for x in FAMILIES.split("\n") if "@F9@" not in x and "@I7@" not in x and x != "1 HUSB @I1@"][:8] + FAMILIES.split("\n")[9:-3]


def test_files_without_duplicate_families_keep_empty_ones(spark):
    text = "0 @I1@ INDI\n1 FAMS @F1@\n1 FAMC @F2@\n0 @F1@ FAM\n1 HUSB @I1@"
    assert rewritten(parsed(spark, text), "duplicate_families") == text.split("\n")
    assert rewritten(parsed(spark, text), "empty_families") == ["0 @I1@ INDI", "1 FAMC @F2@"]


def test_one_source_takes_anothers_place(spark):
    text = """0 @I1@ INDI
1 BIRT
2 SOUR @S1@
3 PAGE 4
2 SOUR @S2@
3 PAGE 4
2 SOUR @S2@
3 PAGE 5
1 SOUR @S2@
2 PAGE 4
0 @S1@ SOUR
1 TITL a
0 @S2@ SOUR
1 TITL b"""
    want = ["0 @I1@ INDI", "1 BIRT", "2 SOUR @S1@", "3 PAGE 4", "2 SOUR @S1@", "3 PAGE 5", "1 SOUR @S1@", "2 PAGE 4", "0 @S1@ SOUR", "1 TITL a"]
    both = parsed(spark, text).unionByName(parsed(spark, text.split("0 @S1@")[0], "g"))
    after = {f: [r.raw for r in households.merge_sources(both, "@S1@", "@S2@").filter(F.col("file_id") == f).orderBy("lineno", "seq").collect()] for f in "fg"}
    assert after == {"f": want, "g": text.split("\n")[:10]}


def test_media_with_missing_files_go(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b+c%.jpg").write_bytes(b"x")
    text = f"""0 @I1@ INDI
1 OBJE @O1@
1 OBJE @O2@
1 OBJE
2 FILE in/../in/a b+c%.jpg
1 OBJE
2 FORM jpg
3 FILE gone.jpg
2 TITL t
1 BIRT
2 OBJE
3 FILE
2 DATE 1850
1 OBJE
2 TITL no file
0 @O1@ OBJE
1 FILE {tmp_path}/in/a b+c%.jpg
0 @O2@ OBJE
1 TITL t
1 FILE x/gone.jpg
0 @O3@ OBJE
1 FILE HTTP://x.example/gone.jpg"""
    lines = parsed(spark, text)
    present = households.files_below(spark, str(tmp_path))
    got = [r.raw for r in households.without_missing_media(lines, present, F.lit(str(tmp_path))).orderBy("lineno", "seq").collect()]
    all_ = text.split("\n")
    assert got == [all_[k] for k in (0, 1, 3, 4, 9, 12, 13, 14, 15, 16, 20, 21)]
    bad = households.missing_media(lines, present, F.lit(str(tmp_path)))
    assert sorted(r.path for r in bad.collect()) == ["", "gone.jpg", "x/gone.jpg"]


def test_births_are_estimated_by_relatives(spark):
    people = [("w", None, ["f"], []), ("h", 1800, ["f"], ["up"]), ("p", 1770, ["up"], []), ("c", None, [], ["f"]), ("q", None, ["g"], ["f"]), ("d", 1851, [], ["g"]), ("e", 1860, [], ["g"]), ("z", None, ["g2"], []), ("n", None, [], [])]
    people = spark.createDataFrame(people, "xref string, year int, fams array<string>, famc array<string>")
    families = spark.createDataFrame([("f", "h", "w", ["c", "q"]), ("g", "q", None, ["e", "d"]), ("up", "p", None, ["h"]), ("g2", None, "z", ["e"])], "xref string, husb string, wife string, chil array<string>")
    got = {r.xref: r.estimate for r in linkage.estimated_births(people, families).collect()}
    assert got == {"w": 1800, "c": 1827, "q": 1826, "z": 1833}  # q: the mean of 1827 and 1824, 1825.5, goes to the even year


@pytest.mark.parametrize(
    ("birth", "death", "estimate", "span"),
    [("1850", "", None, (1840, 1950)), ("BEF 1850", "", None, (None, 1950)), ("AFT 1850", "1900", 1700, (1850, 1905)), ("", "BEF 1512", None, (1372, 1512)), ("", "AFT 1500", None, (1400, 1600)), ("", "BET 1500 AND 1510", None, (1400, 1515)), ("", "", 1700, (1685, 1815)), ("", "", None, (None, None))],
)
def test_life_spans(spark, birth, death, estimate, span):
    first, last = linkage.lifespan(dates.parse_date(F.lit(birth)), dates.parse_date(F.lit(death)), F.lit(estimate).cast("int"))
    assert tuple(spark.range(1).select(first, last).first()) == span


def test_candidates_by_husband_and_given_name(spark):
    schema = "xref string, given string, surname string, husbands array<string>"
    a = spark.createDataFrame([("a1", "anna", "", ["berg"]), ("a2", "anna", "", None), ("a3", "eva", "berg", None)], schema)
    b = spark.createDataFrame([("b1", "anna", "berg", None), ("b2", "anna", "", None), ("b3", "anne", "", None), ("b4", "anna", "", ["bergh"])], schema)
    got = {tuple(r) for r in linkage.candidates(a, b).collect()}
    # bergh has five letters and may differ by two edits only from keys of five letters and more
    assert got == {("a1", "b1"), ("a3", "b1"), ("a2", "b2"), ("a2", "b4")}


MERGE_A = """0 HEAD
1 CHAR UTF-8
0 @I1@ INDI
1 NAME Anna /Berg/
1 SEX
1 BIRT
2 DATE ABT 1850
2 PLAC Bergen
1 DEAT
2 DATE 1900
2 SOUR @S1@
3 PAGE p. 5
1 OCCU Tailor
2 DATE 1870
1 NOTE Kept
1 FAMS @F1@
0 @I2@ INDI
1 NAME Old /Man/
0 @F1@ FAM
1 WIFE @I1@
0 @S1@ SOUR
1 TITL Register
0 TRLR"""
MERGE_B = """0 HEAD
0 @I1@ INDI
1 NAME Ann /Berg/
1 NAME Anna /Berg/
1 SEX F
1 BIRT
2 DATE 3 MAY 1850
2 PLAC Bergen, Norway
1 DEAT
2 DATE 4 JUN 1900
2 SOUR @S7@
3 PAGE p. 5, line 2
2 SOUR @S8@
1 OCCU Baker
2 DATE 1890
1 NOTE Kept
1 FAMS @F5@
0 @I2@ INDI
1 NAME New /Child/
1 FAMC @F5@
0 @F5@ FAM
1 WIFE @I1@
1 CHIL @I2@
0 @S7@ SOUR
1 TITL The register
1 AUTH Clerk
0 @S8@ SOUR
1 TITL Another
0 TRLR"""
MERGED = """0 HEAD
1 CHAR UTF-8
0 @I1@ INDI
1 NAME Anna /Berg/
1 BIRT
2 DATE 3 MAY 1850
2 PLAC Bergen, Norway
1 DEAT
2 DATE 4 JUN 1900
2 SOUR @S1@
3 PAGE p. 5, line 2
2 SOUR @S_MERGE_0001@
1 OCCU Tailor
2 DATE 1870
1 NOTE Kept
1 FAMS @F1@
1 NAME Ann /Berg/
2 TYPE AKA
1 SEX F
1 OCCU Baker
2 DATE 1890
0 @I2@ INDI
1 NAME Old /Man/
0 @F1@ FAM
1 WIFE @I1@
1 CHIL @I_MERGE_0001@
0 @S1@ SOUR
1 TITL Register
1 AUTH Clerk
0 @I_MERGE_0001@ INDI
1 NAME New /Child/
1 FAMC @F1@
0 @S_MERGE_0001@ SOUR
1 TITL Another
0 TRLR"""


def test_whole_files_merge(spark):
    parsed = lambda t, name: lineage.parse_lines(spark.createDataFrame([(name, k, x) for k, x in enumerate(t.split("\n"), 1)], "file_id string, lineno long, raw string"))
    a, b = parsed(MERGE_A, "a"), parsed(MERGE_B, "b")
    matched = spark.createDataFrame([("@I1@", "@I1@"), ("@F5@", "@F1@"), ("@S7@", "@S1@")], "xref_b string, xref_a string")
    ids = merging.whole_map(a, b, matched)
    got = [r.raw for r in merging.merged(a, b, ids).orderBy("lineno", "seq").collect()]
    assert got == MERGED.split("\n")
    assert [r.raw for r in merging.merged(a, b.limit(0), ids).orderBy("lineno", "seq").collect()] == MERGE_A.split("\n")


def test_events_of_both_sides(spark):
    person = lambda *events: "\n".join(["0 HEAD", "0 @I1@ INDI", *events, "0 TRLR"])
    parsed = lambda t, name: lineage.parse_lines(spark.createDataFrame([(name, k, x) for k, x in enumerate(t.split("\n"), 1)], "file_id string, lineno long, raw string"))
    a = person("1 BIRT", "2 DATE 1850", "1 DEAT", "2 DATE 1900", "1 BURI", "2 DATE 2 MAY 1901", "2 PLAC Oslo", "1 RESI", "2 DATE 1880", "1 RESI", "1 EMIG")
    b = person("1 BIRT", "2 DATE 1840", "2 TYPE x", "1 DEAT", "2 DATE 1890", "2 SOUR @I1@", "1 BURI", "2 DATE ABT 1901", "2 PLAC Oslo, Norway", "1 RESI", "1 RESI", "2 DATE 1880", "1 RESI", "2 DATE 1883", "1 EMIG", "2 DATE 1870")
    a, b = parsed(a, "a"), parsed(b, "b")
    ids = spark.createDataFrame([("@I1@", "@I1@")], "xref_b string, xref_a string")
    got = [r.raw for r in merging.merged(a, b, ids).orderBy("lineno", "seq").collect()]
    assert got == [
        "0 HEAD", "0 @I1@ INDI", "1 BIRT", "2 DATE 1850", "1 DEAT", "2 DATE 1890", "2 SOUR @I1@", "1 DEAT", "2 TYPE alternate", "2 DATE 1900", "1 BURI", "2 DATE 2 MAY 1901", "2 PLAC Oslo, Norway",
        "1 RESI", "2 DATE 1880", "1 RESI", "1 EMIG", "1 BIRT", "2 DATE 1840", "2 TYPE x", "1 RESI", "2 DATE 1883", "1 EMIG", "2 DATE 1870", "0 TRLR",
    ]


def test_merge_takes_couples_together_and_writes(spark, tmp_path):
    parsed = lambda t, name: lineage.parse_lines(spark.createDataFrame([(name, k, x) for k, x in enumerate(t.split("\n"), 1)], "file_id string, lineno long, raw string"))
    family = "0 HEAD\n0 @I1@ INDI\n1 FAMS @F1@\n0 @I2@ INDI\n1 FAMS @F1@\n0 @F1@ FAM\n1 HUSB @I1@\n1 WIFE @I2@"
    a, b = parsed(family + "\n1 MARR\n0 TRLR", "a"), parsed(family + "\n1 CHIL @I3@\n1 CHIL @I9@\n0 @I3@ INDI\n1 FAMC @F1@\n0 TRLR", "b")
    matched = spark.createDataFrame([("@I1@", "@I1@"), ("@I2@", "@I2@")], "xref_b string, xref_a string")
    pipelines.merge(a, b, matched, f"file://{tmp_path}/out")
    got = [r.value for r in spark.read.text(f"file://{tmp_path}/out").collect()]
    assert sum(x.endswith(" FAM") for x in got) == 1 and "1 CHIL @I_MERGE_0001@" in got and not any("I9" in x for x in got)
    assert "1 MARR" in got and "1 FAMC @F1@" in got and got[-1] == "0 TRLR"
