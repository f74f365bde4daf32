"""Hard negatives, chat formatting and spelling variants against brute force, with their edge cases."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from minuteloom.llm import chat, hard_negatives, spelling


# --- spelling
def brute_words(docs):
    c = Counter()
    for i, t in docs:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = re.sub("[A-Z]", lambda m: m[0].lower(), r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            c[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 31 == 0 else r] += 1
    return {k: n for k, n in c.items() if len(k) >= 7 and n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(words, times=10):
    form, out = {}, set()
    close = {k: [x for x in words if x != k and near(k, x)] for k in words}
    for k, others in close.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= times * words[k]:
            form[k] = best
    for k in words:
        root = k
        while root in form:
            root = form[root]
        out.add((k, form.get(k), root, words[k], len(close[k]), words.get(form.get(k))))
    return out


def test_spelling_equals_brute_force(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abé") for _ in range(r.randint(6, 9))) for _ in range(40)] + ["prefixe" + x + y for x in "abcdefg" for y in "abcd"]
    texts = [(i, " ".join(r.choice(base).capitalize() if r.random() < 0.2 else r.choice(base) for _ in range(300)) + "." + "Çà1") for i in range(6)]
    rows = [*texts, texts[0], (None, texts[1][1]), (7, None), (8, ""), (9, "w" * 30_000 + " " + "w" * 30_000 + " " + "w" * 29_999 + " " + "w" * 29_999)]
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, word string")
    want = brute_forms(brute_words(rows))
    assert len(want) > 60 and any(x[4] > 5 for x in want)
    for group in (2, 64):
        words = spelling.counted_words(docs)
        got = [tuple(x) for x in spelling.spelling_forms(words, group=group).collect()]
        assert len(got) == len(want) and set(got) == want


def test_spelling_follows_forms_to_the_root(spark):
    words = {"abcdefg": 20_000_000, "abcdefgh": 2_000_000, "abcdefghi": 200_000, "abcdefghij": 20_000, "abcdefghijk": 2000, "abcdefghijkl": 200, "abcdefghijklm": 20, "abcdefghijklmn": 2, "xabcdefg": 2_000_000, "zzzzzzz": 5}
    got = spelling.spelling_forms(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {tuple(x) for x in got.collect()} == brute_forms(words)
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- hard negatives
def brute_negatives(rows):
    use = [(i, lab, np.floor(256 * np.array(v, float))) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width, out = max(len(v) for *_, v in use), []
    use = [(i, lab, np.pad(v, (0, width - len(v)))) for i, lab, v in use]
    anchors = {}
    for i, lab, v in use:
        if i % 50 == 0:
            anchors[i] = min(anchors.get(i, (lab, list(v))), (lab, list(v)))
    for a, (lab, v) in anchors.items():
        scored = sorted((-int(np.dot(v, w)), i, other) for i, other, w in use if i != a)
        for s, p, _ in [x for x in scored if x[2] == lab][:5]:
            fit = [x for x in scored if x[2] != lab and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(fit)]
    return Counter(out)


def test_hard_negatives_equal_brute_force(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(6, 8)) * 0.3
    rows = [(i, int(r.integers(0, 3)), (centres[i % 6] + r.normal(size=8) * 0.1 + 0.1).round(2).tolist()) for i in range(700)]
    rows += [(i + 1000, lab, v) for i, lab, v in rows[:40]] + rows[50:60]  # equal vectors, repeated rows
    rows += [(50, 0, rows[3][2]), (800, None, rows[1][2]), (None, 1, rows[1][2]), (801, 1, None), (802, 1, [None] * 8), (803, 1, [float("nan")] * 8), (804, 1, [float("inf")] * 8), (850, 2, [0.0] * 8), (900, 1, [0.5, 0.5]), (950, 77, rows[5][2])]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, label int, embedding array<float>, own string")
    rows = [(i, lab, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, lab, v in rows]
    want = brute_negatives(rows)
    assert sum(want.values()) > 100
    assert Counter(tuple(x) for x in hard_negatives.mine(df).collect()) == want


def test_hard_negatives_over_many_segments(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SEGMENT", 40)
    monkeypatch.setattr(hard_negatives, "COPY", 5)
    r = np.random.default_rng(5)
    rows = [(i, i % 4, (np.eye(8)[i % 5] + r.normal(size=8) * 0.2).astype(np.float32).tolist()) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert Counter(tuple(x) for x in hard_negatives.mine(df).collect()) == brute_negatives(rows)
    for none in (df.limit(0), df.filter("vec_id % 50 > 0"), df.withColumn("label", F.lit(None).cast("int"))):
        assert hard_negatives.mine(none).count() == 0


def test_lists_end_before_all_is_compared():
    r = np.random.default_rng(6)
    centre = r.normal(size=(20, 16))
    v = np.floor(256 * (centre[np.arange(8000) % 20] + r.normal(size=(8000, 16)) * 0.05))
    q = v[np.arange(0, 8000, 20)[:50]]  # anchors of one cluster
    u, length = hard_negatives.unit(v)
    centroid = hard_negatives.unit(q.sum(axis=0)[None])[0]
    wide = hard_negatives.angles(hard_negatives.unit(q)[0], centroid).max()
    bound = length * np.cos(np.minimum(np.maximum(0, hard_negatives.angles(u, centroid)[:, 0] - wide), np.pi))
    order = np.argsort(-bound, kind="stable")
    all_ = np.full((50, 1), -np.inf)
    (_, _, _, scores), seen = hard_negatives.walk(np.arange(-50, 0), q, all_, -all_, all_, np.arange(8000), v, order, bound[order], 5)
    assert seen < 0.25 * 50 * 8000
    assert sorted(scores) == sorted(np.sort(q @ v.T, axis=1)[:, -5:].ravel())


# --- chat formatting
def test_paths_and_fingerprints():
    assert chat.paths_of("OBJECT<m: OBJECT<k: ARRAY<DECIMAL(21,1)>>, messages: ARRAY<OBJECT<content: STRING, role: STRING>>>") == {"m.k[]", "messages[].content", "messages[].role"}
    assert chat.paths_of("OBJECT<`a b`: BIGINT, x: ARRAY<VOID>>") == {"a b", "x[]"}
    assert chat.paths_of("STRING") == {""}
    select = chat.selector(chat.LAYOUTS)
    assert select("OBJECT<id: BIGINT, prompt: STRING, response: STRING>")[1] == "prompt"
    assert select("OBJECT<prompt: STRING, response: STRING>") == select("OBJECT<meta: OBJECT<a: STRING>, prompt: STRING, response: STRING>")
    assert select("OBJECT<messages: ARRAY<OBJECT<content: STRING, role: STRING>>, prompt: STRING>")[1] == "messages"
    assert select("OBJECT<question: STRING>")[1] is None


def test_layouts_become_turns(spark):
    records = {
        1: ({"messages": [{"role": "user", "content": "a"}, {"role": "tool", "content": None}]}, "messages", [("user", "a"), ("tool", "")]),
        2: ({"conversations": [{"from": "human", "value": "x\n"}, {"from": "gpt", "value": "y"}, {"from": "odd", "value": "z"}]}, "exchange", [("user", "x\n"), ("assistant", "y"), ("odd", "z")]),
        3: ({"data": {"dialog": [{"speaker": {"type": "user"}, "utterance": {"text": "t"}}]}, "id": 4}, "dialog", [("user", "t")]),
        4: ({"prompt": "p", "response": "r", "system": "s"}, "prompt", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        5: ({"prompt": "p", "completion": ""}, "completion", [("user", "p"), ("assistant", "")]),
        6: ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
        7: ({"question": "?"}, None, None),
        8: ({"messages": [], "prompt": "p", "response": "r"}, "prompt", [("user", "p"), ("assistant", "r")]),
    }
    rows = [(i, json.dumps(r[0])) for i, r in records.items()] + [(9, "broken {"), (10, None), (11, json.dumps(records[1][0])), (11, json.dumps(records[1][0]))]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "id long, record string, note string")
    got = [(x.id, x.layout, x.turns and [tuple(t) for t in x.turns]) for x in chat.canonical_turns(df).collect()]
    assert len(got) == len(rows)
    for i, layout, turns in got:
        assert (layout, turns) == (records[{11: 1}.get(i, i)][1:] if i not in (9, 10) else (None, None)), i


def test_escaping_is_reversible(spark):
    r = random.Random(8)
    bits = [*chat.CONTROL, chat.ESCAPE, "<", "[", "|", "im_end", ">", "\n", "é", "\U0001f600", "a"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(i, [(t, texts[-i]), ("assistant", t)]) for i, t in enumerate(texts)], "id long, turns array<struct<role:string,text:string>>")
    out = df.withColumn("t", F.col("turns")).transform(chat.format_chats).withColumns({"back": chat.read_turns(F.col("formatted")), "learnt": chat.learnt_text(F.col("formatted"), F.col("loss"))}).collect()
    for x in out:
        assert x.back == x.t
        assert x.learnt == "".join(t.text for t in x.t if t.role == "assistant")
        assert all(x.formatted.count(mark) == (2 if mark in ("<|im_start|>", "<|im_sep|>", "<|im_end|>") else 0) for mark in chat.CONTROL)


def test_conversations_by_row(spark):
    r = random.Random(9)
    say = lambda n: "".join(r.choice("ab \n[INST]</s>é") for _ in range(n))
    rows = [(i, t, role, say(r.randint(0, 50))) for i in range(30) for t, role in enumerate(r.choice([["user", "assistant"], ["system", "user", "assistant"], ["user", "human", "assistant"], ["user"], ["assistant"] * 3, ["user", None]]))]
    rows += [(100, t, ("user", "assistant")[t % 2], say(9)) for t in range(700)] + [(101, t, "assistant", "w" * 50_000) for t in range(40)]
    rows += [(102, 0, "user", None), (102, 0, "assistant", "tie"), (None, 1, "user", "no id"), rows[0]]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, part string")
    records = chat.records_of(df)
    assert records.filter("conv_id = 100").count() > 5
    turns = chat.canonical_turns(records)
    assert turns.filter("layout is null").count() == 0 and turns.select("layout").distinct().count() >= 5
    got = {x.conv_id: x for x in chat.digests(chat.format_chats(turns)).collect()}
    told = {}
    for i, t, role, text in sorted(rows, key=lambda x: (x[0] or -1, x[1], x[2] or "", x[3] or "")):
        told.setdefault(i, []).append((role or "", text or ""))
    assert got.keys() == told.keys()
    for i, turns in told.items():
        learnt = "".join(t for role, t in turns if role == "assistant")
        assert (got[i].n_turns, got[i].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (got[i].loss_chars, got[i].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.digests(chat.format_chats(chat.canonical_turns(chat.records_of(df.limit(0))))).count() == 0
