"""Scores, shards and leaks against plain versions that go text by text; rows, ids and labels that come more than once."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from minuteloom.llm import decontaminate, language_id, quality, sharding, token_counts, topk, toxicity
from minuteloom.llm.queries import tokenizer_path

TEXTS = [b"", b"a", b"short text", bytes(range(256)) * 3, "é ü ñ 日本".encode() * 40, b"x" * 95, b"x" * 96, b"x" * 97, b"many words of one text " * 90]


def naive_quality(net, text):
    """A window, a half chunk and a chunk at a time."""
    s, taps, half = quality.STRIDE, quality.TAPS, quality.HALF_BYTES
    halves = -(-(len(text) + s * taps) // half)
    data = text + bytes(halves * half - len(text))
    mean, top = [], []
    for h in range(halves):
        out = []
        for start in range(h * half, (h + 1) * half, s):
            value = np.zeros(quality.FILTERS)
            if start < len(text):  # windows that begin behind the text are silent
                for j in range(taps):
                    value += net.embed[list(data[start + j * s : start + (j + 1) * s])].reshape(-1).astype(float) @ net.filters[j]
            out.append(np.maximum(value, 0))
        mean.append(np.sum(out, axis=0) * 2 / quality.HALF)
        top.append(np.max(out, axis=0))
    ratings = []
    for h in range(halves):
        both = slice(h, min(h + 2, halves))
        chunk = np.concatenate([np.sum(mean[both], axis=0), np.max(top[both], axis=0)])
        ratings.append(np.maximum(chunk @ net.hidden + net.hidden_bias, 0))
    z = np.max(ratings, axis=0) @ net.out + net.bias[0]
    return 1 / (1 + np.exp(-z))


def test_quality_equals_a_naive_forward_pass():
    for seed in (5, 6):
        net = quality.ByteNet.fresh(seed)
        net.bias[0], net.hidden_bias[:] = 0.3, 0.1
        assert net.scores(TEXTS) == pytest.approx([naive_quality(net, t) for t in TEXTS], abs=1e-5)


def test_quality_gradient_equals_differences():
    net, x = quality.ByteNet.fresh(), quality.Layout.of(TEXTS[1:5])
    wanted = np.array([0, 1, 0, 1], np.float32)

    def loss():
        z = net.forward(x).astype(float)
        return float(np.mean(np.log1p(np.exp(z)) - wanted * z))

    for part, grad in zip(net.parts, net.gradient(x, wanted)):
        at = np.unravel_index(np.abs(grad).argmax(), part.shape)
        kept, step = part[at], 1e-2
        part[at] = kept + step
        more = loss()
        part[at] = kept - step
        less = loss()
        part[at] = kept
        assert (more - less) / (2 * step) == pytest.approx(grad[at], rel=0.1, abs=1e-4)


def naive_language(model, text):
    p = language_id.prepared(text)
    z = model.bias.astype(float).copy()
    for n in language_id.ORDERS:
        rows = []
        for i in range(len(p) - n + 1):
            h = 0x9E3779B9 * n & 0xFFFFFFFF
            for c in p[i : i + n]:
                h = (h ^ ord(c)) * 0x85EBCA6B & 0xFFFFFFFF
                h ^= h >> 15
            rows.append(model.table[h >> (32 - language_id.BITS)].astype(float))
        z += np.mean(rows, axis=0) if rows else 0
    e = np.exp((z - z.max()) / model.temperature)
    return model.names[int(z.argmax())], e.max() / e.sum()


def test_languages_equal_naive_scores():
    said = {"en": ["the dog and the cat", "a house of words"], "fr": ["le chien et le chat", "une maison de mots"], "de": ["der Hund und die Katze", "ein Haus der Wörter"]}
    model = language_id.fit([t for x in said.values() for t in x] * 20, [k for k, x in said.items() for _ in x] * 20)
    texts = ["a", "the chat", "und?", "Wörter 12 of 3 maison", "日本", "x " * 500]
    names, scores = model.predict(texts)
    want = [naive_language(model, t) for t in texts]
    assert names == [w[0] for w in want] and scores == pytest.approx([w[1] for w in want], abs=1e-5)
    assert [model.predict([t])[0][0] for x in said.values() for t in x] == [k for k, x in said.items() for _ in x]


def test_repeated_rows_and_ids_with_two_labels(spark):
    """Each row keeps its own, rows alike score alike, and labels given twice or both ways are no error."""
    rows = [(i, ("good words here " if i % 2 else "bad mean words ") * (1 + i % 3), "en" if i % 2 else "fr") for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:20] + [(None, "good words here ", "en"), (None, None, None)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i, *_ in rows] * 2 + [(3, 0, 1), (None, 1, 1), (4, None, None), (5, 7, 7)], "doc_id long, quality int, toxic int")
    for got in (
        quality.score_quality(docs, quality.train(docs, marks)), toxicity.score_toxicity(docs, toxicity.train(docs, marks)), language_id.predict_languages(docs, language_id.train(docs)),
    ):
        got = got.collect()
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
        of = defaultdict(set)
        for r in got:
            of[r.doc_id].add(r.score)
        # the place in a batch moves the last bits of 32-bit sums
        assert all(max(s) - min(s) < 1e-5 for i, s in of.items() if i is not None) and all(0 <= x <= 1 for s in of.values() for x in s)


def test_labels_joined_by_hash_count_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ("mean bad " if i % 3 == 0 else "kind good ") + f"w{i % 7}") for i in range(90)] + [(None, "kind")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(3, 0)], "doc_id long, toxic int")
    count = lambda: sorted(map(tuple, toxicity.term_counts(docs, marks, "doc_id", "text", "toxic").collect()))
    sent = count()
    monkeypatch.setattr(toxicity, "LABEL_ROWS", 0)
    assert count() == sent
    monkeypatch.setattr(toxicity, "LEXICON_ROWS", 0)
    with pytest.raises(ValueError, match="terms have evidence"):
        toxicity.train(docs, marks)


@pytest.mark.parametrize("safe", [True, False])
def test_token_counts_of_whole_texts_and_limits(spark, monkeypatch, safe):
    import sentencepiece

    path = tokenizer_path()
    model, counter = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.SegmentCounter(path)
    counter.safe = safe
    texts = ["naïve café " * 30, "日本語 テキスト " * 9, "", " ", "🙂🙂 x", "<s></s> <unk>", "á b c", "plain " * 100]
    for most in (1, 64, 1 << 20):
        assert [n for b in token_counts.by_bytes(texts, most) for n in counter.count(b)] == [len(x) for x in model.encode(texts)]
        assert [t for b in token_counts.by_bytes(texts, most) for t in b] == texts
    docs = spark.createDataFrame(list(enumerate(texts)) + [(8, None), (0, texts[0])], "doc_id long, text string")
    n = len(model.encode(texts[0]))
    got = token_counts.token_counts(docs, path, limit=n).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got)[0, n] == 2 and all(r.over_limit == (r.n_tokens > n) for r in got)
    assert {r.over_limit for r in token_counts.token_counts(docs, path, limit=n - 1).collect() if r.doc_id == 0} == {True}


def shard_docs(spark):
    r = random.Random(9)
    texts = ["".join(r.choices("abcdefgh ", k=r.randint(0, 400))) for _ in range(2000)]
    rows = [(i, texts[i % 1200 if i % 3 else i]) for i in range(2000)]  # many texts stand in several rows
    rows += [(5000 + i, "the text of a third of all rows " * 7) for i in range(1200)]
    rows += [(7000, "x" * 90_000), (7001, "y" * 60_000), (7002, None), (7003, "")] + [(8000, "rows alike")] * 50 + [(None, "no id")] * 5
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).repartition(7)


def test_shards_of_whole_texts(spark):
    rows, docs = shard_docs(spark)
    got = sharding.assign_shards(docs, 4).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((x.doc_id, x["size"]) for x in got) == Counter((i, size(t)) for i, t in rows)
    by_shard = defaultdict(list)
    for x in got:
        by_shard[x.shard].append(x)
    assert set(by_shard) == {0, 1, 2, 3}
    assert all(sorted(x.slot for x in s) == list(range(len(s))) for s in by_shard.values())
    total, sizes = sum(x["size"] for x in got), [sum(x["size"] for x in s) for s in by_shard.values()]
    assert max(sizes) - min(sizes) <= 2 * 90_001 and sum(sizes) == total  # a piece is as small as its largest text allows
    text_of, shards = dict(rows), defaultdict(set)
    for x in got:
        shards[text_of[x.doc_id]].add(x.shard)
    hot = rows[2000][1]
    apart = [t for t, s in shards.items() if len(s) > 1 and t != hot]
    assert len(shards[hot]) > 1 and not apart


def test_shards_do_not_depend_on_the_order_of_rows(spark):
    rows, docs = shard_docs(spark)
    key = lambda d: Counter((x.doc_id, x["size"], x.text_crc32, x.shard, x.slot) for x in d.collect())
    assert key(sharding.assign_shards(docs, 4)) == key(sharding.assign_shards(docs.orderBy(F.desc("doc_id")).coalesce(2), 4))


def test_search_of_null_and_repeated_ids_and_unlike_widths(spark):
    v = [(0, [1.0, 2.0]), (None, [9.0, 9.0]), (1, [3.0]), (2, [1.0, 1.0, 5.0]), (2, [1.0, 1.0, 5.0]), (20, [2.0, 0.0]), (3, []), (4, [float("inf"), 1.0])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_products(spark.createDataFrame(v, "vec_id long, embedding array<double>"), 20).collect()]
    assert None not in {g[2] for g in got} and 4 not in {g[2] for g in got}
    pad = lambda x: np.floor(64 * np.array(x + [0.0] * (3 - len(x))))
    used = [(i, pad(x)) for i, x in v if i is not None and i != 4]
    for q in (0, 20):
        own = next(x for i, x in used if i == q)
        want = sorted(((-int(own @ x), i) for i, x in used if i != q))
        assert [(g[2], g[3]) for g in sorted(got, key=lambda g: g[1]) if g[0] == q] == [(i, -s) for s, i in want]


def test_leaks_over_several_slices(spark, monkeypatch):
    r = random.Random(4)
    items = [[f"w{r.randrange(400)}" for _ in range(r.randint(10, 40))] for _ in range(60)]
    texts = [" ".join([*(f"x{r.random()}" for _ in range(9)), *items[i % 60][: r.randint(4, 40)], "end"]) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    find = lambda: (sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect())), sorted(map(tuple, decontaminate.drop_leaks(docs, bench).collect())))
    one = find()
    assert len(decontaminate.prepare(docs, bench)) == 1 and len(one[0]) > 40
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 1500)
    assert len(decontaminate.prepare(docs, bench)) > 3 and find() == one
    assert {i for i, *_ in one[0]} | {i for i, _ in one[1]} == set(range(120)) and not {i for i, *_ in one[0]} & {i for i, _ in one[1]}
