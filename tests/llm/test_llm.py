"""Edge cases, brute force and invariants of the training-data operators."""

import gzip
import hashlib
import random
import re
import tempfile
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from minuteloom.llm import decontaminate, language_id, mixing, ngram_join, quality, sharding, token_counts, topk, toxicity, warc
from minuteloom.llm.common import new_folder
from minuteloom.llm.components import components
from minuteloom.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5)))
    base = [" ".join(word() for _ in range(40)) for _ in range(30)]
    near = [b.replace(b.split()[7], "zz", 1) for b in base[:10]]
    texts = base + near + base[:5] + [None, "", " \t ", "one two", "One  TWO", "x " * 30_000] + ["same text over and over again here"] * 40
    return spark.createDataFrame([(i, t, ("en", "fr", None)[i % 3], ("a", "b", None)[i % 3], "clash") for i, t in enumerate(texts)], DOCS)


def sets_of(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets, up = {i: sets_of(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_components_equal_brute_force(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    kept = ngram_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (n, c) in got.items() if i == c or not n}


def test_jaccard_of_sparse_links(spark):
    r = random.Random(5)
    rows = []
    for i in range(60):  # chains: each text changes a few words of the one before
        w = rows[-1][1].split() if i % 12 else [str(r.random()) for _ in range(60)]
        w[r.randrange(60)] = w[r.randrange(60)] = str(r.random())
        rows.append((i, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_word_hashes_know_words_by_their_bytes():
    of = lambda t: ngram_join.word_hashes(np.frombuffer(t.encode(), np.uint8)).tolist()
    r, words = random.Random(4), {}
    texts = [" ".join("".join(r.choice("abAB\u00e9\u00a0\u65e5") for _ in range(r.randint(1, 6))) for _ in range(40)) for _ in range(50)]
    texts += ["a" * n + " b" for n in (1, ngram_join.RUN_BYTES - 1, ngram_join.RUN_BYTES, ngram_join.RUN_BYTES + 9)] + [" \t\n", "", "x\x0by  z "]
    texts.append(" ".join(texts))  # over many runs
    for t in texts:
        want = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())
        got = of(t)
        assert len(got) == len(want)
        for w, h in zip(want, got):
            assert words.setdefault(w, h) == h
    assert len(set(words.values())) == len(words)


def test_join_of_repeated_and_null_ids(spark):
    w = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(1, w("a")), (1, w("b")), (1, w("a")), (2, w("b") + " more"), (None, w("c")), (None, w("c") + " more"), (None, w("d")), (7, w("d")), (3, None), (3, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.jaccard_components(docs).collect()))
    assert got == sorted([(1, 26, 1)] * 3 + [(2, 27, 1), (0, 26, 0), (0, 27, 0), (0, 26, 7), (7, 26, 7), (3, 0, 3), (3, 0, 3), (0, 0, 0)])
    kept = sorted((r.doc_id or 0, r.text or "") for r in ngram_join.keep_one_of_each(docs).collect())
    parts = [(i or 0, t or "") for i, t in rows]
    assert len(kept) == 7 and kept.count((3, "")) == 2 and kept.count((0, "")) == 1 and (7, w("d")) in kept and set(kept) <= set(parts)
    assert sum(i == 1 for i, _ in kept) == 2 and sum(t.startswith("c0") for _, t in kept) == 1
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0 and ngram_join.keep_one_of_each(docs.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 9)] + [(20, 21), (21, 21), (None, 3)], "u long, v long")
    assert {(r.node, r.label) for r in components(edges).collect()} == {(i, 1) for i in range(1, 10)} | {(20, 20), (21, 20)}


def test_token_counts_equal_the_library(spark, docs):
    import sentencepiece

    path = tokenizer_path()
    model, counter = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.SegmentCounter(path)
    texts = ["", " ", "  a b  ", "a  ", "\n x ▁ y▁z  ", "é  ñ\t q", "<s> x </s>", "日本語 テキスト", "a" * 5000]
    assert counter.safe and counter.count(texts) == [len(x) for x in model.encode(texts)]
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, path).collect()}
    assert got == {r.doc_id: (len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in docs.collect()}


def expected_references(rows):
    """refers_to of each (id, text): the smallest id of the same text of 100 bytes or more, unless it is that id."""
    least = {}
    for i, t in rows:
        if i is not None and len((t or "").encode()) >= 100:
            least[t] = min(least.get(t, i), i)
    n = Counter(t for _, t in rows)
    return Counter((i, least[t] if n[t] > 1 and t in least and i != least[t] else None, (t or "").encode()) for i, t in rows)


@pytest.mark.parametrize("most", [warc.REPEATED_DIGESTS, 0])
@pytest.mark.parametrize("by_ranges", [True, False])
def test_warc_round_trip(spark, most, by_ranges):
    r = random.Random(2)
    big = "".join(r.choice("abcdefghij") for _ in range(1 << 17))
    copies = "copied many times " * 10
    rows = [(3, big), (1, big), (2, "tiny"), (4, "tiny"), (5, None), (6, big + "é"), (7, big), (None, big), (8, ""), (9, "\x1f\x8b\x00" * 99)]
    rows += [(20, "twice " * 30), (20, "twice " * 30), (21, "twice " * 30)]  # two rows of the smallest id
    rows += [(None, "without an id " * 10)] * 2 + [(i, copies) for i in range(100, 700)]
    pages = spark.createDataFrame([(i, f"http://x/ä\n{i}" if i else None, t) for i, t in rows], "page_id long, url string, html string").withColumn("record_type", F.lit("clash"))
    folder = new_folder(spark, "test")
    warc.write_archives(pages, folder, most=most)
    got = warc.read_archives(spark, folder, by_ranges=by_ranges).collect()
    assert all(x.verified and (x.record_type == "revisit") == (x.refers_to is not None) == (x.payload is None) for x in got)
    whole = {hashlib.sha256((t or "").encode()).hexdigest(): (t or "").encode() for _, t in rows}
    assert all(len(whole[x.payload_digest]) == x.payload_bytes and (x.payload is None or bytes(x.payload) == whole[x.payload_digest]) for x in got)
    assert Counter((x.page_id, x.refers_to, whole[x.payload_digest]) for x in got) == expected_references(rows)


def test_warc_archives_follow_the_splits(spark):
    """Large pages share archives, and archives are cut at records wherever the splits of a reader fall."""
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(1100)), lambda k: F.sha2(F.concat_ws("-", "id", k), 256))).alias("html")).repartition(3)
    folder = new_folder(spark, "test")
    warc.write_archives(pages, folder)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 18))
        read = warc.read_archives(spark, folder)
        files = read.inputFiles()
        got = read.select("page_id", "verified", "payload_bytes").collect()
        parts = read.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert len(files) == 3 and parts > 30
    assert sorted(x.page_id for x in got) == list(range(400)) and all(x.verified and x.payload_bytes == 1100 * 65 - 1 for x in got)


def test_warc_faults_are_told(spark):
    def archive(*members):
        folder = tempfile.mkdtemp(dir="/tmp")
        with open(f"{folder}/part-0.txt", "wb") as f:
            f.write(b"".join(members))
        return folder

    good = warc.record(1, "u", b"abc", 3, hashlib.sha256(b"abc").hexdigest(), None)
    bad = warc.record(2, "u", b"abd", 3, hashlib.sha256(b"abc").hexdigest(), None)
    for by_ranges in (True, False):
        got = warc.read_archives(spark, archive(warc.gzip_member(good), warc.EMPTY_MEMBER, warc.gzip_member(bad)), by_ranges=by_ranges).collect()
        assert {x.page_id: x.verified for x in got} == {1: True, 2: False}
        for broken in (archive(warc.gzip_member(good)[:-9]), archive(b"no archive"), archive(warc.gzip_member(good[:-6]))):
            with pytest.raises(Exception, match="ValueError"):
                warc.read_archives(spark, broken, by_ranges=by_ranges).collect()
    foreign = archive(gzip.compress(good, 9), gzip.compress(bad, 1))
    assert warc.read_archives(spark, foreign, by_ranges=False).count() == 2


def test_warc_members():
    long = warc.gzip_member(b"x" * (1 << 25), 1)
    for m in (warc.gzip_member(b"abc"), long):
        assert gzip.decompress(warc.line(m) + b"\0") == gzip.decompress(m)
    text = b"a" * 5000 + warc.HEAD * 3
    member = warc.gzip_member(text, 0)  # stored as it is, the head would stand inside
    assert member.find(warc.HEAD, 1) < 0 and gzip.decompress(member) == text


def test_sharding_law(docs):
    rows = sharding.assign_shards(docs.filter("length(text) < 1000 or text is null"), 4).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [sum(r["size"] for r in rows if r.shard == k) for k in range(4)]
    assert max(sizes) - min(sizes) < 600 and sharding.assign_shards(docs.limit(0)).count() == 0


def test_mixing_targets(docs):
    rows = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.orderBy(F.desc("doc_id"))).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert len(rows) == docs.count() and sorted(map(key, rows)) == sorted(map(key, again))
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    targets = {r.source: (r.target, r.source_size) for r in rows}
    assert abs(sum(t for t, _ in targets.values()) - 1.5 * sum(s for _, s in targets.values())) < 1e-6 * sum(s for _, s in targets.values())
    assert mixing.take_mix(docs).count() == sum(r.copies for r in rows)
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.take_mix(docs.limit(0)).count() == 0


def test_mixing_comes_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    taken = mixing.mix_sources(docs).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k")).collect()
    assert all(abs(r.k - r.t) <= 0.02 * r.t for r in taken) and len(taken) == 20
    own = mixing.take_mix(docs).groupBy("source").agg(F.sum(mixing.word_count("text")).alias("k")).collect()
    assert {r.source: r.k for r in own} == {r.source: r.k for r in taken}


def test_mixing_of_repeated_rows(spark):
    rows = [(1, "a b c", "s", i) for i in range(7)] + [(None, "x y z w", "s", i) for i in range(5)] + [(2, None, None, 0), (3, "one two", None, 1), (3, "two one", None, 1), (3, "two one", None, 2)]
    of = lambda r: spark.createDataFrame(r, "doc_id long, text string, source string, copies int")
    got = [sorted(map(str, mixing.take_mix(of(r)).collect())) for r in (rows, rows[::-1], rows[5:] + rows[:5])]
    assert got[0] == got[1] == got[2]
    plan = mixing.mix_sources(of(rows)).collect()
    assert len(plan) == len(rows) and max(r.copies for r in plan) <= 2 and sum(r.copies for r in plan) == len(got[0])
    assert max(r.copies for r in plan if r.doc_id == 1) - min(r.copies for r in plan if r.doc_id == 1) <= 1


def test_letters_decide_whether_a_text_has_a_language():
    assert [language_id.prepared(t) for t in ("\u00bd", "\u00b2 \u00b3", "\u2167", "12 !", None, "", "\u0301", "a\u00bdB", "\u65e5 9")] == ["", "", "", "", "", "", "", " a b ", " \u65e5 "]


def test_language_of_long_texts_in_runs(monkeypatch):
    model = language_id.fit(["the dog and the cat"] * 9 + ["le chien et le chat"] * 9, ["en"] * 9 + ["fr"] * 9)
    text = language_id.prepared("the dog et le chat " * 300)
    want = model.logits([text])
    monkeypatch.setattr(language_id, "CHUNK_CHARS", 1000)
    assert model.logits([text]) == pytest.approx(want, abs=1e-6)


def test_top_products_equal_brute_force(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(300, 8)).round(2)
    v[50:60] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [float("nan")] * 8), (902, [None] * 8)]
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5).collect()}
    q = np.floor(64 * v)
    want = {}
    for i in range(0, 300, 20):
        s = q @ q[i]
        for k, j in enumerate([j for j in np.lexsort((np.arange(300), -s)) if j != i][:5]):
            want[(i, k + 1)] = (j, int(s[j]))
    assert got == want
    assert topk.top_products(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_leaks(spark):
    r = random.Random(3)
    w = lambda n: [f"w{r.randrange(10_000)}" for _ in range(n)]
    items = [w(30) for _ in range(8)]
    edited = list(items[1])
    edited[5], edited[14] = "changed", "other"
    del edited[22]
    rows = [(0, " ".join(w(50) + items[0] + w(20))), (1, " ".join(w(50) + edited + w(9))), (2, " ".join(w(90))), (3, None), (4, ""), (5, " ".join(w(10) + items[2][:4] + w(50)))]
    rows += [(10 + i, " ".join(w(5) + items[3] + w(5))) for i in range(40)]
    bench = spark.createDataFrame([(i, " ".join(t).upper()) for i, t in enumerate(items)] + [(98, None), (99, "")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(got) == {(0, 0), (1, 1)} | {(10 + i, 3) for i in range(40)}
    assert got[0, 0].score == 1 and got[0, 0].first_word == 50 and got[0, 0].last_word == 79


def test_leaks_in_many_texts_equal_brute_force(spark):
    r = random.Random(8)
    w = lambda n: [f"w{r.randrange(10_000)}" for _ in range(n)]
    items = [w(40) for _ in range(3)]
    edited = [f"e{j}" if j % 10 == 9 else x for j, x in enumerate(items[0])]
    texts = [w(5) + edited + w(5) for _ in range(60)] + [w(5) + items[1][:25] + w(5) for _ in range(60)] + [w(5) + items[2][:12] + w(30) for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    number = {x: i for i, x in enumerate(sorted({x for t in texts + items for x in t}))}
    of = lambda t: np.array([number[x] for x in t])
    best = {(d, i): decontaminate.align(of(item), of(t))[0] for d, t in enumerate(texts) for i, item in enumerate(items)}
    got = {(x.doc_id, x.item_id): x.score for x in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {k: s for k, s in best.items() if s >= 0.5} and len(got) == 120
    assert {x.doc_id for x in decontaminate.drop_leaks(docs, bench).collect()} == set(range(120, 180))


def test_leaks_of_items_without_id(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "another text of some words")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (None, None)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.score) for r in decontaminate.find_leaks(docs, bench).collect()] == [(1, None, 1.0)]
    assert [r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()] == [2]


def test_leaks_in_long_passages_equal_whole_alignment():
    r = random.Random(6)
    for _ in range(20):
        item = [f"w{r.randrange(12)}" for _ in range(r.randint(2, 9))]  # few words: seeds chain over the whole text
        text = [f"w{r.randrange(14)}" for _ in range(r.randint(5, 300))]
        items = decontaminate.Items.of([(5, " ".join(item))])
        number = {w: i for i, w in enumerate(sorted({*item, *text}))}
        best = decontaminate.align(np.array([number[w] for w in item]), np.array([number[w] for w in text]))[0]
        got = decontaminate.leaks_of(" ".join(text), items)
        k = min(3, len(item))
        seeded = any(item[i : i + k] == text[j : j + k] for i in range(len(item) - k + 1) for j in range(len(text) - k + 1))
        assert [x["score"] for x in got] == ([best] if best >= 0.5 and seeded else [])


def test_recall_of_edited_copies():
    """Of copies whose full alignment reaches the score, at least 0.9 are found through their seeds."""
    r = random.Random(11)
    hit = all_ = 0
    for _ in range(300):
        item = [f"w{r.randrange(5000)}" for _ in range(r.randint(8, 60))]
        copy = [w if r.random() > 0.15 else f"e{r.random()}" for w in item if r.random() > 0.1]
        number = {w: i for i, w in enumerate(sorted({*item, *copy}))}
        if copy and decontaminate.align(np.array([number[w] for w in item]), np.array([number[w] for w in copy]))[0] >= 0.5:
            all_ += 1
            hit += bool(decontaminate.leaks_of(" ".join(["x", *copy, "y"]), decontaminate.Items.of([(1, " ".join(item))])))
    assert all_ > 150 and hit >= 0.9 * all_


def test_alignment_equals_plain_recurrence():
    r = np.random.default_rng(0)
    for _ in range(30):
        a, b = r.integers(0, 4, 12), r.integers(0, 4, 20)
        h = np.zeros((13, 21), int)
        for i in range(1, 13):
            for j in range(1, 21):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(a, b)[0] == h.max() / 24


def all_maximal(x):
    """By definition: recursively the best of each stretch, earlier and shorter first, with a positive sum."""
    if not len(x):
        return []
    sums = [(x[i:j].sum(), -(j - i), -i, i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)]
    best, _, _, i, j = max((round(s[0], 9), *s[1:]) for s in sums)
    return [] if best <= 0 else all_maximal(x[:i]) + [(i, j - 1, best)] + [(a + j, b + j, s) for a, b, s in all_maximal(x[j:])]


def test_maximal_segments_equal_their_definition():
    def whole(x):
        return all_maximal(x)

    r = np.random.default_rng(1)
    for _ in range(60):
        gains = np.where(r.random(24) < 0.5, r.normal(size=24) * 3, np.nan)
        at = np.flatnonzero(~np.isnan(gains))
        found = [(s.first, s.last, round(s.score, 9)) for s in toxicity.maximal_segments(at, gains[at], 0.7)]
        want = [(i, j, round(float(s), 9)) for i, j, s in whole(np.where(np.isnan(gains), -0.7, gains))]
        assert [(a, b, pytest.approx(s, abs=1e-6)) for a, b, s in want] == found


def test_maximal_segments_are_found_in_linear_time():
    began = time.time()
    assert len(toxicity.maximal_segments(np.arange(100_000) * 9, np.full(100_000, 2.0))) == 100_000
    assert time.time() - began < 5


def test_tokens_keep_combining_marks():
    assert toxicity.tokens("Caf\u0065\u0301 \u0939\u093f\u0928\u094d\u0926\u0940 x1y Don't") == ["cafe\u0301", "\u0939\u093f\u0928\u094d\u0926\u0940", "x", "y", "don", "t"]


def test_long_texts_in_runs_equal_one_pass():
    r = np.random.default_rng(2)
    net = quality.ByteNet.fresh()
    for n in (quality.RUN_BYTES + 1, 2 * quality.RUN_BYTES // quality.HALF_BYTES * quality.HALF_BYTES, 2 * quality.RUN_BYTES - 5):
        x = r.integers(0, 256, n, dtype=np.uint8).tobytes()
        assert net.long_text(x) == pytest.approx(net.forward(quality.Layout.of([x])), abs=1e-4)


def test_every_place_of_a_toxic_word_scores():
    model = toxicity.ToxicModel({"idiot": 3.0, "clown": 3.0}, {}, 1.0, 0.1, 1.0, 0.0)
    dense, calm = ["idiot", "clown", "you", "clown", "idiot"], ["calm"] * 60
    n, found = model.segments(" ".join(["idiot", *calm, "clown", *calm, *dense, *calm, *dense]))
    assert [(s.first, s.last) for s in found] == [(0, 0), (61, 61), (122, 126), (187, 191)]
    assert found[2].score == pytest.approx(4 * 3 - 0.7) and found[3].score == pytest.approx(found[2].score)


def test_toxic_prior_counts_all_texts(spark):
    docs = spark.createDataFrame([(1, "Mean mean words"), (2, "kind words"), (3, "words unlabelled words"), (4, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert all(zlib.crc32(str(i).encode()) % 5 for i in (1, 2))
    got = {r.term: tuple(r)[1:] for r in toxicity.term_counts(docs, marks, "doc_id", "text", "toxic").collect()}
    assert got["words"] == (1, 1, 4, 1, 1) and got["mean"] == (2, 0, 2, 1, 0) and got["unlabelled"] == (0, 0, 1, 0, 0) and got["word*"] == (1, 1, 4, 1, 1)
    assert {r.term for r in toxicity.log_odds(toxicity.term_counts(docs, marks, "doc_id", "text", "toxic")).collect()} == {"mean", "kind", "words", "mean*", "kind*", "word*"}


@pytest.mark.parametrize("empty", [True, False])
def test_models_handle_nulls_and_empty_tables(spark, docs, empty):
    x = docs.limit(0) if empty else docs
    marks = x.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    n = x.count()
    assert quality.score_quality(x, quality.train(x, marks)).filter("score between 0 and 1").count() == n
    assert toxicity.score_toxicity(x, toxicity.train(x, marks)).filter("score between 0 and 1").count() == n
    got = language_id.predict_languages(x, language_id.train(x)).collect()
    assert len(got) == n and all(r.lang_pred == "und" for r in got if r.doc_id in (45, 46, 47))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    share = lambda df, a, b: df.filter("held_out").agg(F.avg((F.col(a) == F.col(b)).cast("double"))).first()[0]
    assert share(quality.score_quality(docs, quality.train(docs, marks)).join(marks, "doc_id"), "predicted", "quality") > 0.85
    assert share(toxicity.score_toxicity(docs, toxicity.train(docs, marks)).join(marks, "doc_id"), "predicted", "toxic") > 0.85
    known = docs.filter("lang is not null").select("doc_id", "lang")
    assert share(language_id.predict_languages(docs, language_id.train(docs)).join(known, "doc_id"), "lang_pred", "lang") > 0.97


def test_pipeline_end_to_end(spark, tmp_path):
    """On a fixture whose right outcome is known: one of each group of copies, no leak, no text without a language."""
    import corpus_pipeline

    r = random.Random(9)
    fr, en = "le chien et la maison sont dans une ville avec des amis pour".split(), "the dog and a house are in one city with some friends for".split()
    prose = lambda w, n: " ".join(r.choice(w) + ("" if r.random() < 0.8 else str(r.randrange(9))) for _ in range(n))
    base = [(prose(fr if i % 2 else en, 60), "fr" if i % 2 else "en") for i in range(40)]
    item = " ".join(f"quiz{r.randrange(999)}" for _ in range(30))
    rows = [(i, t, la) for i, (t, la) in enumerate(base)] + [(100 + i, base[i][0] + " end", base[i][1]) for i in range(6)] + [(200, base[1][0][:150] + " " + item, "fr"), (300, "12 34 !", None), (301, None, None)]
    docs = spark.createDataFrame([(i, t, la, f"s{i % 3}", len(t or "")) for i, t, la in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    x, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        x = stage(spark, x, str(tmp_path)).persist()
        kept[name] = sorted(row.doc_id for row in x.collect())
        assert name == "sharding" or x.columns == docs.columns
    assert kept["language_id"] == sorted(i for i, _, la in rows if la)
    assert kept["ngram_join"] == [*range(40), 200] and kept["decontaminate"] == list(range(40))
    assert set(kept["mixing"]) <= set(range(40)) and max(map(kept["mixing"].count, kept["mixing"])) <= 2 and kept["sharding"] == kept["mixing"]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(row.doc_id for row in got.collect()) == kept["sharding"]
    for t in ("documents", "benchmark"):  # an empty table goes through
        spark.read.parquet(f"{tmp_path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_operators_on_empty_and_small_tables(spark, docs):
    none = docs.limit(0)
    assert token_counts.token_counts(none, tokenizer_path()).count() == 0
    assert decontaminate.find_leaks(none, spark.createDataFrame([(1, "a b c d")], "item_id long, text string")).count() == 0
    assert decontaminate.find_leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    few_vectors = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0]), (20, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = topk.top_products(few_vectors, 20).collect()
    assert sorted((x.query_id, x["rank"], x.vec_id) for x in got) == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    folder = new_folder(spark, "none")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_archives(spark, folder).count() == 0
    short = spark.createDataFrame([(1, "one two"), (2, "x one two y")], "doc_id long, text string")
    assert {x.doc_id for x in decontaminate.find_leaks(short, spark.createDataFrame([(5, "One, two!")], "item_id long, text string")).collect()} == {1, 2}
