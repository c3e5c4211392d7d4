"""Each operator against brute force, and the awkward rows: nulls, empty and long texts, ties, repeats, none, extra columns."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from kinloom.llm import chat, fingerprints, lines, media, mixing, perfect_hash, pieces, quality, simhash, token_shards, warc  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, range long, bucket string, key string, size int, tie string"
BASE = "the quick brown fox jumps over the lazy dog while seven wizards hex bold jugs of prime liquid and none complain"


def rows():
    out = [(1, BASE, "a"), (2, BASE, "b"), (3, BASE.replace("fox", "cat"), None), (4, None, "a"), (5, "", "b"), (6, "  \n\n ", "a"), (7, "a\n" + BASE + "\nb", "c"), (8, "x" * 5000 + " " + "ß ñ 日本 😀 " * 700, "b"), (None, "no id", "a"), (9, "tie", "a"), (9, "tie", "a"), (9, "other text", "c"), (10, "<|endoftext|> a  b\t\n c ", None)]
    return [(i, t, "en", s, len(t or ""), 1, "b", "k", 2, "t") for i, t, s in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# 1
def test_token_shards_read_back_what_the_library_gives(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_shards.encoded_documents(docs, path).collect())
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 0]
    want = sorted(((r[0] is not None, r[0] or 0), *(lambda x: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())))(ids(r[1]))) for r in rows())
    assert sorted(((r[1] is not None, r[1] or 0), r[2], r[3]) for r in got) == want
    assert [r[0] for r in got] == list(np.cumsum([0, *[r[2] for r in got]])[:-1]) and [r[1] for r in got if r[1]] == sorted(r[1] for r in got if r[1])


def test_token_shards_of_nothing(empty):
    assert token_shards.encoded_documents(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_perfect_hash_is_minimal_and_tells_strangers():
    keys = perfect_hash.mixed(np.arange(5000), 3)
    sizes, bits = perfect_hash.build(keys)
    slots = perfect_hash.slots(keys, sizes, bits)
    assert sorted(slots) == list(range(5000))
    order, others = np.argsort(slots), perfect_hash.mixed(np.arange(5000, 9000), 3)
    stored, at = perfect_hash.fingerprints(keys)[order], perfect_hash.slots(others, sizes, bits)
    assert not ((at >= 0) & (stored[np.maximum(at, 0)] == perfect_hash.fingerprints(others))).any()


def test_look_up_leaves_out_keys_that_are_not_there(spark):
    found = spark.range(50).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("occurrence"), F.lit(0).alias("shard"), F.col("id").alias("offset"), F.lit(3).cast("long").alias("n"), F.col("id").alias("before"))
    index, buckets = token_shards.build_index(found, bucket=16)
    got = token_shards.look_up(spark.range(100).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("occurrence")), index, buckets).collect()
    assert sorted(r.doc_id for r in got) == list(range(50)) and all(r.offset == r.doc_id for r in got)


# 2
def test_warc_round_trip(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", "", None, "x\r\n\r\ny", "é" * 3000, "<p>a</p>"]
    pages = [(k, None if k == 2 else f"http://h/{k} \r\n", h, "z") for k, h in enumerate(html)] + [(None, "u", "<p>a</p>", "z"), (4, "http://h/4 \r\n", "x\r\n\r\ny", "z")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest string").repartition(2)
    got = sorted(((r.page_id is None, r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived_pages(df).collect())
    import base64

    want = []
    for k, _, h, _ in pages:
        b = (h or "").encode()
        first = min((x[0] for x in pages if (x[2] or "") == (h or "") and x[0] is not None))
        want.append(((k is None, k or 0), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), first, k))
    assert [g[:3] for g in got] == sorted(w[:3] for w in want)
    assert sum(g[3] == "response" for g in got) == 4
    assert all(g[4] is None if g[3] == "response" else g[4] == next(w[3] for w in want if w[:3] == g[:3]) for g in got)
    assert warc.archived_pages(df.limit(0)).count() == 0


def test_warc_refuses_changed_payloads(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")
    warc.write_archive(df, f"file://{tmp_path}/a")
    (file,) = [p for p in os.listdir(tmp_path / "a") if p.startswith("part-")]
    data = gzip.decompress((tmp_path / "a" / file).read_bytes()).replace(b"abc", b"abd")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "part-0.gz").write_bytes(gzip.compress(data))
    with pytest.raises(Exception, match="does not have its digest"):
        warc.ingest(spark, f"file://{tmp_path}/b", f"file://{tmp_path}/c")


# 3
def test_line_dedup_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(200)]
    data = []
    for k in range(60):
        line = " ".join(rng.choice(vocabulary, 30))
        near = line.split()
        near[3] = "changed"
        data += [(3 * k, line + "\n\nown " + " ".join(rng.choice(vocabulary, 9)), "x"), (3 * k + 1, " ".join(near).upper() + "\n", "x"), (3 * k + 2, line + "\n" + line, "x")]
    df = spark.createDataFrame([*data, (None, None, "x"), (900, "", "x")], "doc_id long, text string, line string").repartition(3)
    got = {r.doc_id: r.text for r in lines.deduplicated(df).collect()}
    normal = lambda x: re.sub("[\x00-\x20]+", " ", x).strip(" ").lower()
    seen: list[set] = []
    for doc, t, _ in data:
        kept = []
        for x in t.split("\n"):
            if n := normal(x):
                s = lines.shingle_set(n)
                if any(len(s & o) >= 0.8 * len(s | o) for o in seen):
                    continue
                seen.append(s)
            kept.append(x)
        assert got[doc] == "\n".join(kept)
    assert got[None] is None and got[900] == ""


def test_line_dedup_of_stars_and_mixed_families(spark, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK", 150)
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    data = []
    for _ in range(2):
        template = rng.choice(vocabulary, 32).tolist()
        data += [" ".join([*template[:k], "".join(rng.choice(list("ijkl"), 6)), *template[k + 1 :]]) for k in (2 + n % 28 for n in range(400))]
        data.append(" ".join(template))
    rows = [(k + 1, x) for k, x in enumerate(data)]
    df = spark.createDataFrame(rows, "key long, line string").repartition(3)
    found = spark.createDataFrame([(b, k) for (k, _), bands in zip(rows, lines.signatures(data).tolist()) for b in bands], "bucket long, key long")
    got = {r.node - 1: r.component - 1 for r in lines.families(found, lambda bits: df).collect()}
    numbers = lines.signatures(data)
    met = {}
    for k, row in enumerate(numbers.tolist()):
        for bucket in row:
            met.setdefault(bucket, []).append(k)
    parent, sets = list(range(len(data))), [lines.shingle_set(x) for x in data]

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for keys in met.values():
        for i, a in enumerate(keys):
            for b in keys[:i]:
                if root(a) != root(b) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    assert [got.get(k, k) for k in range(len(data))] == [root(k) for k in range(len(data))]


def test_meetings_across_batches(spark):
    rng = np.random.default_rng(3)
    rows = [(int(b), int(k)) for b, k in zip(rng.integers(-3, 4, 400), rng.integers(-60, 60, 400))]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        got = sorted(tuple(r) for r in lines.meetings(spark.createDataFrame(rows, "bucket long, key long")).collect())
        assert lines.meetings(spark.createDataFrame([], "bucket long, key long")).count() == 0
    finally:
        spark.conf.set(size, before)
    keys = {b: sorted({k for c, k in rows if c == b}) for b, _ in rows}
    assert got == sorted((b, k, ks[0], p) for b, ks in keys.items() for p, k in zip(ks, ks[1:]))


def test_lines_travel_packed_and_repeats_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(lines, "HELD", 500)
    monkeypatch.setattr(lines, "PACKED", 5000)
    monkeypatch.setattr(lines, "DEALT", 7000)
    monkeypatch.setattr(lines, "SLOTS", (4, 8))
    rng = np.random.default_rng(3)
    texts = {k: [f"line {n} of some {n * 7919 % 1000} words" for n in rng.integers(0, 1200, 12).tolist()] for k in range(300)}
    rows = [(k, "\n".join(x[:6] + [""] + x[6:])) for k, x in texts.items()]
    df = spark.createDataFrame([*rows, rows[7]], "doc_id long, text string").repartition(3)
    scan = lines.scanned(df).cache()
    # rows are by task and document, not by line
    assert scan.filter("doc is null").count() < 100 and scan.count() < 400 + 100
    pairs = np.concatenate([lines.unpacked([r.bands], 2) for r in scan.filter("bands is not null").collect()]).tolist()
    distinct = sorted({x for v in texts.values() for x in v})
    assert len({tuple(p) for p in pairs}) == len(distinct) * lines.BANDS
    got = sorted(tuple(r) for r in lines.banded_meetings(scan).collect())
    assert got and got == sorted(tuple(r) for r in lines.meetings(spark.createDataFrame(pairs, "bucket long, key long")).collect())
    told = lines.firsts(scan, b"\xff" * (lines.FILTER_BITS[0] // 8)).collect()
    place = {x: min((d, n + (n > 5)) for d, v in texts.items() for n, y in enumerate(v) if x == y) for x in distinct}
    assert sorted((r.doc, r.line_no) for r in told if r.key is not None) == sorted(place.values())
    gone = {(r.doc, n) for r in [*told, *scan.collect()] if r.lines for n in r.lines}
    assert gone == {(d, n + (n > 5)) for d, v in texts.items() for n in range(12)} - set(place.values())
    assert not [r for r in lines.firsts(scan, bytes(lines.FILTER_BITS[0] // 8)).collect() if r.key is not None]


def test_places_of_lines_that_share_a_key():
    rows = np.array([[5, 1, 9, 0, 4], [5, 2, 3, 0, 1], [5, 1, 9, 0, 2], [6, 0, 1, 1, 1], [5, 1, 9, 0, 2], [5, 2, 3, 0, 1]], np.int64)
    first, gone = lines.told_apart(rows)
    assert sorted(first.tolist()) == [[5, 1, 9, 0, 2], [5, 2, 3, 0, 1], [6, 0, 1, 1, 1]] and gone.tolist() == [[5, 1, 9, 0, 4]]


@pytest.mark.parametrize("sizes", [(1 << 25, 10**9, 1 << 30), (1 << 25, 10**9, 0), (0, 0, 0)])
def test_walk_by_each_table_against_all_pairs(monkeypatch, sizes):
    for name, size in zip(("DENSE", "DENSER", "SQUARE"), sizes):
        monkeypatch.setattr(lines, name, size)
    rng = np.random.default_rng(5)
    letters = list("abcdefghij klmnop")
    data: list[str] = []
    for _ in range(12):
        base = rng.choice(letters, 90)
        for _ in range(int(rng.integers(1, 7))):
            text = base.copy()
            text[rng.integers(0, 90, int(rng.integers(0, 4)))] = "z"
            data.append("".join(text))
    data = [*dict.fromkeys(data), "short", "x"]
    parts = np.arange(len(data), dtype=np.int64) // 2 * 2
    sets = [lines.shingle_set(x) for x in data]
    like = {(i, j) for i in range(len(data)) for j in range(len(data)) if i != j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    got = lines._walk(np.arange(len(data), dtype=np.int64), parts, data, 0.8, lines.shingle_set, lines.shingle_numbers)
    assert got and set(got) <= like

    def groups(links):
        of = list(range(len(data)))
        for a, b in [*links, *((int(p), k) for k, p in enumerate(parts))]:
            of = [of[a] if x == of[b] else x for x in of]
        return of

    assert [groups(got)[k] == groups(got)[0] for k in range(len(data))] == [groups(like)[k] == groups(like)[0] for k in range(len(data))]
    assert len(set(groups(got))) == len(set(groups(like)))


def test_line_filter_has_the_keys_at_its_ends(spark):
    size = lines.FILTER_BITS[0]
    keys = spark.createDataFrame([(k,) for k in (0, size + 1, 777, size - 1, -3 * size)], "key long")
    table = np.frombuffer(lines._filter(keys), np.uint8)
    asked = np.array([0, 7 * size, 1, 777, 778, 776, 2, -1, -2], np.int64)
    assert lines.has_bit(table, asked.view(np.uint64)).tolist() == [True, True, True, True, False, False, False, True, False]
    assert [r.has for r in spark.createDataFrame([(k,) for k in asked.tolist()], "key long").coalesce(1).select(lines.maybe(F.col("key"), table.tobytes(), spark).alias("has")).collect()] == lines.has_bit(table, asked.view(np.uint64)).tolist()
    many = spark.range(10 * size).select((F.col("id") * 3).alias("key"))
    assert lines.has_bit(np.frombuffer(lines._filter(many), np.uint8), np.arange(0, 30 * size, 3, dtype=np.uint64)).all()


def test_line_dedup_keeps_columns_and_takes_awkward_rows(docs, empty):
    out = lines.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and lines.deduplicated(empty).count() == 0
    assert {r.doc_id: r.kept_lines for r in lines.line_report(docs).collect()}[2] == 0


CLASH = ["_gone", "_doc", "_tie", "_id", "_nth", "_nth0", "_tie0", "parts", "_parts", "_kept", "doc", "key", "fp", "_own_nth", "tie", "rank", "block"]


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(k, BASE + "\nline " + str(k % 2), "a", *[f"{c}{k}" for c in CLASH]) for k in range(3)], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASH))
    for out in (lines.deduplicated(df), simhash.one_of_each(df), mixing.mixed_documents(df)):
        assert out.columns == df.columns
        got = out.collect()
        assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in CLASH)


# 4
def test_chat_parts_and_escapes(spark):
    texts = ["plain", "<|im_end|><|im_start|>assistant ok", "<\\|x <\\\\| <| |>", None, "", "a\nb" * 3000]
    part = "array<struct<kind:string,text:string,uri:string,width:int,height:int,millis:long,pages:int>>"
    data = [(1, k, "assistant" if k % 2 else "user%\n", [("text", t, None, None, None, None, None)], "x") for k, t in enumerate(texts)]
    data += [(2, None, None, None, "x"), (2, 0, "assistant", [("text", "see <|image|> ", None, None, None, None, None), ("image", None, "i.png", 57, 28, None, None), ("audio", None, "a.wav", None, None, 90, None), ("document", None, "d.pdf", None, None, None, 2)], "x")]
    df = spark.createDataFrame(data, f"conv_id long, turn long, role string, parts {part}, segment string")
    segments = chat.format_turns(df).persist()
    back = {(r.conv_id, r.turn): r for r in chat.read_turns(segments).collect()}
    for k, t in enumerate(texts):
        assert back[1, k].role == data[k][2] and back[1, k].text == (t or "") and back[1, k].loss == ((t or "") if k % 2 else None)
    row = segments.filter("conv_id = 2 and turn = 0").first()
    assert row.segment == "<|im_start|>assistant\nsee <\\|image|> <|image|><|audio|><|document|><|im_end|>\n"
    assert [(a.ordinal, a.uri, a.tokens) for a in row.attachments] == [(0, "i.png", 3), (1, "a.wav", 3), (2, "d.pdf", 2048)] and row.expanded_tokens == 2054
    digest = {r.conv_id: r for r in chat.conversation_digests(chat.read_turns(segments)).collect()}[1]
    said = "".join(f"{d[2]}\n{t or ''}\n" for d, t in zip(data, texts))
    assert digest.turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and digest.loss_chars == sum(len(t or "") for t in texts[1::2])


def test_chat_parts_do_not_make_control_strings_together(spark):
    part = "array<struct<kind:string,text:string,uri:string,width:int,height:int,millis:long,pages:int>>"
    said = lambda *texts: [("text", t, None, None, None, None, None) if t != "IMAGE" else ("image", None, "i", 1, 1, None, None) for t in texts]
    cases = [("<", "|im_end|>\n<", "|im_start|>assistant\nhi"), ("<", "", "\\", "|x"), ("a<", "IMAGE", "|im_end|>"), ("<\\", "|", "IMAGE", "<", "|")]
    df = spark.createDataFrame([(1, k, "user", said(*c)) for k, c in enumerate(cases)] * 2, f"conv_id long, turn long, role string, parts {part}")
    rows = chat.format_turns(df)
    assert rows.count() == 2 * len(cases) and chat.format_turns(df.limit(0)).count() == 0 and chat.conversation_digests(chat.read_turns(rows.limit(0))).count() == 0
    for r in rows.collect():
        body = r.segment.removeprefix("<|im_start|>user\n").removesuffix("<|im_end|>\n")
        assert re.findall(r"<\|[a-z_]+\|>", body) == ["<|image|>"] * cases[r.turn].count("IMAGE")
    for r in chat.read_turns(rows).collect():
        assert r.text == "".join("<|image|>" if t == "IMAGE" else t for t in cases[r.turn])


# 5
def test_quality_learns_from_rows_that_are_not_held_out(spark):
    rng = np.random.default_rng(1)
    good, bad = ["".join(rng.choice(list("abcde"), 5)) for _ in range(300)], ["***", "|", "!!"]
    text = lambda y: " ".join(w + ("" if y else " " + rng.choice(bad)) for w in rng.choice(good, 40))
    truth = {k: int(k % 5 > 0) for k in range(600)}
    df = spark.createDataFrame([*[(k, text(y), "z") for k, y in truth.items()], (None, None, "z"), (1000, "", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, y in truth.items()] + [(3, None), (5, 7)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.scored_documents(df, labels).collect()}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2]
    assert held and all(got[k].held_out == (k in held) for k in truth)
    assert sum(got[k].predicted == truth[k] for k in held) > 0.97 * len(held)
    assert got[None].held_out and 0 <= got[1000].score <= 1
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.scored_documents(df, flipped).collect()} == {k: r.score for k, r in got.items()}
    assert quality.good_documents(df, labels).columns == df.columns and quality.scored_documents(df.limit(0), labels.limit(0)).count() == 0


# 6
def test_simhash_components_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres:
        x = int(c)
        for _ in range(12):
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)).collect()

    def classes(pairs):
        parent = {f: f for f in signed}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[root(a)] = root(b)
        groups: dict = {}
        for f in signed:
            groups.setdefault(root(f), set()).add(f)
        return {frozenset(g) for g in groups.values()}

    want = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4]
    assert classes([(r.a, r.b) for r in got]) == classes(want) and all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 4 for r in got)


def test_simhash_keeps_one_of_each_component_whatever_the_ids(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(40)) for _ in range(7)]
    data = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (1, texts[2]), (5, texts[2]), (5, texts[3]), (6, texts[3]), (7, texts[4]), (7, texts[5]), (2, texts[6])]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(data)], "doc_id long, text string, n long").repartition(3)
    got = simhash.one_of_each(df)
    want = [(None, texts[0]), (None, texts[1]), (1, texts[2]), (5, texts[3]), (7, texts[4]), (7, texts[5]), (2, texts[6])]
    assert got.columns == df.columns and sorted(((r.doc_id or 0), r.text) for r in got.collect()) == sorted(((i or 0), t) for i, t in want)


def test_near_copies_of_five_word_shingles_go(spark):
    rng = np.random.default_rng(6)
    data = []
    for k in range(30):
        text = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(70)]
        copy, other = list(text), list(text)
        copy[30] = "changed"
        for at in (5, 20, 35, 50, 65):
            other[at] = "changed"
        data += [(3 * k, " ".join(text)), (3 * k + 1, "  ".join(copy).upper()), (3 * k + 2, " ".join(other))]
    sets = [simhash.word_shingles(x) for _, x in data]
    fps = [simhash.fingerprint(simhash.shingle_hashes(x)) for _, x in data]
    assert sum((fps[3 * k] ^ fps[3 * k + 1]).bit_count() > simhash.LIMIT for k in range(30)) > 20
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) or (fps[a] ^ fps[b]).bit_count() <= simhash.LIMIT
    want = {a for a in range(len(data)) if not any(alike(a, b) for b in range(a))}
    got = simhash.one_of_each(spark.createDataFrame([*data, (900, None), (901, " ")], "doc_id long, text string").repartition(3))
    assert {r.doc_id for r in got.collect()} == want | {900}


def test_fingerprint_bits_are_majorities_of_shingle_hashes(docs):
    import xxhash

    got = {(r.doc_id, r.fingerprint) for r in simhash.near_duplicates(docs).collect()}
    for r in rows():
        low = re.sub("[A-Z]", lambda m: m.group().lower(), r[1] or "")
        parts = words(low)
        shingles = [" ".join(parts[k : k + 4]) for k in range(max(1, len(parts) - 3))] if parts else []
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert (r[0], f"{bits:016x}") in got


def test_simhash_of_awkward_rows(docs, empty):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {got[k].component_id for k in (4, 5, 6)} == {4} and got[4].fingerprint == "0" * 16 and got[1].component_id == got[2].component_id == 1
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 4} and not kept.filter("doc_id in (2, 5, 6)").count()
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


# 7
def test_pieces_equal_the_library(docs, empty):
    encoder = pieces.Encoder.of(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(4)
    texts = [r[1] or "" for r in rows()] + ["".join(rng.choice(list("aabcd eé\n▁ 日😀.,-0"), 80)) for _ in range(400)] + ["aaaaaaaaaaaa", " lead", "trail ", "\0 x"]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<i4").tolist() == encoder.library.encode(t)
    got = pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert all(r.decoded == encoder.library.decode(r.ids) for r in got.collect()) and got.count() == docs.count()
    assert pieces.digests(pieces.encoded(empty, public_tokenizers.path("piece_bpe_32k.model"))).count() == 0


# 8
def test_fingerprints_against_plain_python(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdef"), 4)) for _ in range(400)]
    texts = {k * 300: " ".join(rng.choice(vocabulary, 60 + k)) for k in range(8)} | {5: "", 6: "one", 7: "one"}
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, sketch string")
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(df).collect()}
    order = sorted(texts, reverse=True)
    shingles = lambda t: {tuple(words(t.lower())[k : k + 5]) for k in range(max(1, len(words(t)) - 4))} if words(t) else set()
    for a, b in zip(order, order[1:] + order[:1]):
        cut = len(texts[a]) // 3
        edited = texts[a][: len(texts[a]) - cut] + texts[b][:cut]
        assert got[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        x, y = shingles(texts[a]), shingles(edited)
        assert abs(got[a].near_edited - (len(x & y) / len(x | y) if x | y else 1.0)) < 0.45
    assert got[6].fingerprint == got[7].fingerprint and got[7].near_next == 1.0 and got[5].fingerprint == "" and got[0].near_next < 0.1


def test_sketches_hold_each_shingle_hash_below_the_threshold(spark):
    rng = np.random.default_rng(8)
    texts = ["", "one two", *[" ".join(rng.choice(BASE.split(), n)) for n in (5, 12, 200, 900)]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    got = {r.k: r.s for r in df.select("k", fingerprints.sketch(F.col("text")).alias("s")).collect()}
    runs = [(k, [words(t)[j : j + 5] for j in range(max(1, len(words(t)) - 4))] if t else []) for k, t in enumerate(texts)]
    hashed = spark.createDataFrame([(k, (x + [None] * 5)[:5]) for k, xs in runs for x in xs], "k long, x array<string>")
    hashed = hashed.select("k", F.xxhash64(*[F.when(F.col("x")[j].isNotNull(), F.xxhash64(F.col("x")[j])) for j in range(5)]).bitwiseAND(F.lit(2**63 - 1)).alias("h")).collect()
    for k, xs in runs:
        all_ = sorted({r.h for r in hashed if r.k == k})
        assert got[k] == ([h for h in all_ if h < 2**60] or all_[:1])


def test_fingerprints_of_awkward_rows(docs, empty):
    assert fingerprints.fingerprint_documents(docs).count() == docs.count() and fingerprints.fingerprint_documents(empty).count() == 0
    one = fingerprints.fingerprint_documents(docs.filter("doc_id = 1")).first()
    assert one.near_next == 1.0


def test_sketches_merge(spark):
    a, b = BASE + " and so on", "quite other words stand here " + BASE
    s = lambda t: fingerprints.sketch(F.lit(t), keep_bits=62)
    got = spark.range(1).select(fingerprints.merged(s(a), s(b), 62).alias("m"), s(a).alias("a"), s(b).alias("b")).first()
    assert set(got.m) == set(got.a) | set(got.b)


# 9
def test_mix_comes_near_its_targets(spark):
    rng = np.random.default_rng(7)
    data = [(k, " ".join(["w"] * int(rng.integers(0, 400))), ["a", "b", None, "Z"][k % 4] if k % 3 else "a") for k in range(800)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    got = {r.doc_id: r for r in mixing.taken_words(df).collect()}
    size = {s: sum(len(words(t)) for _, t, x in data if x == s) for s in ("Z", "a", "b", None)}
    weight, left, target = dict(zip(size, (3, 1, 2, 3))), 1.5 * sum(size.values()), {}
    while open_ := [s for s in size if s not in target]:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * size[s]]
        for s in full or open_:
            target[s] = 2 * size[s] if full else level * weight[s]
            left -= 2 * size[s] if full else 0
    for k, t, s in data:
        assert got[k].size == len(words(t)) and got[k].source_size == size[s] and got[k].target == pytest.approx(target[s]) and 0 <= got[k].taken <= 2 * got[k].size
    for s in size:
        assert abs(sum(got[k].taken for k, _, x in data if x == s) - target[s]) <= max(2 * mixing.BLOCK, 0.01 * target[s])
    assert {r.doc_id: r.taken for r in mixing.taken_words(df.repartition(7)).collect()} == {k: r.taken for k, r in got.items()}


def test_permutations_are_permutations(spark):
    for n in (1, 2, 3, 7, 100, 1009):
        got = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(1)).alias("x")).collect()
        assert sorted(r.x for r in got) == list(range(n))


def test_mixed_documents_hold_what_is_taken(docs, empty):
    taken = sorted(r.taken for r in mixing.taken_words(docs).collect() if r.taken)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and sorted(len(words(r.text)) for r in out.collect()) == taken
    assert mixing.taken_words(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


# 10
def test_media_round_trip():
    payloads = [os.urandom(64 * 70), b"\xff" * 640, b"\0" * 64, (BASE * 40).encode()[: 64 * 60], bytes(range(256)) * 4]
    files = media.encode(payloads)
    assert [p for p, _ in media.decode(files)] == payloads
    places, _ = media._riff_frames(files[0])
    assert len(places) == 3 and all(files[0][a : a + 2] == b"\xff\xd8" for a, _ in places)


def test_shots_start_where_the_histogram_changes():
    frame = lambda v: bytes([v]) * (media.COLUMNS * media.ROWS)
    got = media.shots(frame(10) * 3 + frame(200) * 2, [media.ROWS] * 5)
    assert [c[:3] for c in got] == [(0, 120, 3), (120, 200, 2)]


def test_media_of_awkward_rows(docs, empty):
    got = media.document_media(docs).collect()
    assert len(got) == docs.count() and media.document_media(empty).count() == 0
    for r in got:
        if r.doc_id in (1, 4, 8):
            raw = (next(x[1] for x in rows() if x[0] == r.doc_id) or "").encode()
            padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
