"""Toxicity: maximum-scoring segment search over token log-odds with Dirichlet priors.

Tokens are scored, at each of their places, by how much oftener they stand in toxic than in other texts, with an
informative Dirichlet prior from all texts, labelled or not. A linear-time scan finds every maximal scoring segment of a text,
extreme-value statistics tell which of them are significant and turn their scores into one probability for the text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minuteloom.llm.common import id_remainder, labelled_sample, marked, session

STEM = 4  # characters of the word beginnings that stand in for words not seen among the labelled texts
PRIOR_SHARE = 0.01  # of the labelled tokens: the weight of the Dirichlet prior
DRIFT = 0.7  # what a token without evidence takes from a segment's score
CHANCE_TERMS = 8  # about so many terms may enter the lexicon by chance
SIGNIFICANT = 0.05  # chance at most that a clean text of the length has such a segment
#: Bounds: entries of the lexicon that tasks get (more are an error, none is left out), labels that are sent to the texts
#: (more are joined with them by hash), and bytes of text of each label for the calibration.
LEXICON_ROWS = 1_000_000
LABEL_ROWS = 2_000_000
SAMPLE_BYTES = 2_000_000
COUNTED_TERMS = 200_000  # that a counting task holds before it hands its counts on
_PLAIN, _TOKEN = re.compile(r"[a-z]+"), regex.compile(r"\p{L}[\p{L}\p{M}]*")


COUNTS = ("toxic", "other", "everywhere", "toxic_texts", "other_texts")


def tokens(text: str | None) -> list[str]:
    """Runs of letters with their combining marks, in lower case."""
    if not text:
        return []
    return (_PLAIN if text.isascii() else _TOKEN).findall(text.lower())


def stem(word: str) -> str | None:
    return word[:STEM] + "*" if len(word) >= STEM else None


def log_odds(counts: DataFrame, share: float = PRIOR_SHARE) -> DataFrame:
    """(term, COUNTS) -> those and odds, evidence, terms.

    odds: log-odds ratio of tokens with an informative Dirichlet prior, a term's part of which is its share among
    all texts. evidence: log-likelihood ratio, in nats, of the toxic share of the labelled texts with the term against
    the overall one, negative where the term is rarer in toxic texts; texts and not tokens, as a word repeated in one
    text says little about others. terms: how many terms of labelled texts were compared."""
    names = {"_t": "toxic", "_o": "other", "_e": "everywhere", "_tt": "toxic_texts", "_ot": "other_texts"}
    total = counts.agg(*(F.sum(c).alias(k) for k, c in names.items()), F.count_if(F.col("toxic_texts") + F.col("other_texts") > 0).alias("terms"))
    x = counts.filter("toxic_texts + other_texts > 0").join(F.broadcast(total))  # one row of totals
    prior = share * (F.col("_t") + F.col("_o"))
    a = prior * F.col("everywhere") / F.col("_e")
    side = lambda y, m: F.log((y + a) / (m + prior - y - a))
    t, o = F.col("toxic_texts"), F.col("other_texts")
    n, base = t + o, F.col("_tt") / (F.col("_tt") + F.col("_ot"))
    part = lambda y, p: F.when(y > 0, y * F.log(y / n / p)).otherwise(0.0)
    evidence = F.when(t / n >= base, 1).otherwise(-1) * (part(t, base) + part(o, 1 - base))
    return x.select(*counts.columns, (side(F.col("toxic"), F.col("_t")) - side(F.col("other"), F.col("_o"))).alias("odds"), evidence.alias("evidence"), "terms")


def term_counts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(term, COUNTS): tokens of toxic, of other and of all texts, and texts with the term; labels only of rows whose
    crc32(id) mod 5 is not 0, ``everywhere`` over every text of ``docs``, each read once.

    Terms are tokens, and their beginnings marked by a trailing ``*``. Up to LABEL_ROWS labels go to the texts, which then
    are not shuffled. An id with both labels counts for both; of equal rows in ``labels`` one counts."""
    marks = marked(labels, id_col, label_col).groupBy(F.col("id").alias("_id")).agg(F.count_if(F.col("y") == 1).alias("_t"), F.count_if(F.col("y") == 0).alias("_o"))
    few = marks.limit(LABEL_ROWS + 1).count() <= LABEL_ROWS
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: Counter() for k in COUNTS}

        def take() -> pa.RecordBatch:
            for k in ("toxic", "other", "everywhere"):
                beginnings = Counter()
                for w, n in held[k].items():
                    if b := stem(w):
                        beginnings[b] += n
                held[k].update(beginnings)
            terms = list(set().union(*held.values()))
            out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in held.values())], ["term", *COUNTS])
            for c in held.values():
                c.clear()
            return out

        for batch in batches:
            for text, t, o in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = tokens(text)
                held["everywhere"].update(words)
                for kind in ["toxic"] * bool(t) + ["other"] * bool(o):
                    own = set(words)
                    held[kind].update(words)
                    held[f"{kind}_texts"].update(own | {b for w in own if (b := stem(w))})
                if sum(map(len, held.values())) > COUNTED_TERMS:
                    yield take()
        yield take()

    schema = "term string, " + ", ".join(f"{c} long" for c in COUNTS)
    counts = texts.join(F.broadcast(marks) if few else marks, "_id", "left").select("_text", "_t", "_o").mapInArrow(count, schema)
    return counts.groupBy("term").agg(*(F.sum(c).alias(c) for c in COUNTS))


@dataclass
class Segment:
    first: int  # token positions
    last: int
    score: float


def maximal_segments(positions: np.ndarray, gains: np.ndarray, drift: float = DRIFT) -> list[Segment]:
    """All maximal scoring segments of a text in which each token at ``positions`` scores its gain and every other
    one -drift. Linear in the number of scored tokens: runs of other tokens are taken at once, and each segment knows the
    nearest earlier one with a smaller sum before it, so none is looked at again."""
    found: list[tuple[float, float, int, int, int]] = []  # sum before, sum at the end, first, last, that earlier segment
    total, before = 0.0, -1
    for p, g in zip(positions.tolist(), gains.tolist()):
        total -= drift * (p - before - 1)
        before = p
        start, total = total, total + g
        if g <= 0:
            continue
        left, first, j = start, p, len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= left:
                j = found[j][4]
            if j < 0 or found[j][1] >= total:
                found.append((left, total, first, p, j))
                break
            left, _, first, _, earlier = found[j]
            del found[j:]
            j = earlier
    return [Segment(a, b, right - left) for left, right, a, b, _ in found]


@dataclass
class ToxicModel:
    gains: dict[str, float]
    stems: dict[str, float]
    rate: float  # of the extreme-value law of segment scores
    scale: float
    slope: float
    offset: float

    def gain(self, word: str) -> float:
        g = self.gains.get(word)
        return g if g is not None else self.stems.get(word[:STEM], 0.0) if len(word) >= STEM else 0.0

    def segments(self, text: str) -> tuple[int, list[Segment]]:
        words = tokens(text)
        gains, stems = self.gains, self.stems
        hits = [i for i, w in enumerate(words) if w in gains or w[:STEM] in stems]
        g = np.array([self.gain(words[i]) for i in hits])
        return len(words), maximal_segments(np.array(hits, int), g)

    def chances(self, n_words: int, segments: list[Segment]) -> np.ndarray:
        """Minus the logarithm of the chance that a clean text of this length has a segment of the score, for each one."""
        s = np.array([x.score for x in segments])
        expected = np.log(self.scale * max(1, n_words)) - self.rate * s  # of the number of such segments, as a logarithm
        return np.where(expected < -30, -expected, -np.log(-np.expm1(-np.exp(np.clip(expected, -30, 3)))))

    def surprise(self, n_words: int, segments: list[Segment]) -> float:
        """Grows with the improbability of the best segment in a clean text, and half as much with that of the others."""
        if not segments:
            return 0.0
        chance = self.chances(n_words, segments)
        return float(np.log1p(chance.max() + 0.5 * (chance.sum() - chance.max())))

    def score(self, text: str | None) -> tuple[float, list[Segment]]:
        """The probability of the text, and its significant segments."""
        n, segments = self.segments(text) if text else (0, [])
        x = self.slope * self.surprise(n, segments) + self.offset
        told = [s for s, c in zip(segments, self.chances(n, segments)) if c >= -np.log(SIGNIFICANT)] if segments else []
        return float(1 / (1 + np.exp(-np.clip(x, -40, 40)))), told


def karlin(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(weight * exp(rate * score)) = 1; needs a negative mean and a positive score."""
    if not (scores @ weights < 0 and (scores > 0).any()):
        return 1.0
    f = lambda r: float(weights @ np.exp(np.minimum(r * scores, 700.0))) - 1
    low, high = 1e-6, 1.0
    while f(high) < 0:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_bytes: int = SAMPLE_BYTES) -> ToxicModel:
    """Counts over all texts, and over labelled ones whose crc32(id) mod 5 is not 0, in Spark; the tasks get every term with
    enough evidence, and more than LEXICON_ROWS of them are a ValueError. The calibration is fitted on a sample of ``sample_bytes`` of each label.
    Without labelled rows of both kinds every text scores the share of the kind that there is, or 0.5."""
    session(docs)
    counts = term_counts(docs, labels, id_col, text_col, label_col).persist()
    odds = log_odds(counts).filter(F.col("evidence") > F.log(F.col("terms") / CHANCE_TERMS))
    lexicon = odds.limit(LEXICON_ROWS + 1).toPandas().sort_values("term", ignore_index=True)
    if len(lexicon) > LEXICON_ROWS:
        raise ValueError(f"more than {LEXICON_ROWS} terms have evidence: raise LEXICON_ROWS if tasks can hold them, or lower CHANCE_TERMS")
    total = counts.filter(~F.col("term").endswith("*")).agg(F.sum("other")).first()[0] or 1
    counts.unpersist()
    whole = lexicon[~lexicon.term.str.endswith("*")]
    stems = lexicon[lexicon.term.str.endswith("*")]
    # a beginning speaks for unseen words only where it hardly ever stands in other texts
    stems = stems[stems.toxic_texts > 9 * stems.other_texts]
    model = ToxicModel(dict(zip(whole.term, whole.odds)), dict(zip(stems.term.str.rstrip("*"), 0.8 * stems.odds)), 1.0, 0.1, 1.0, 0.0)
    if len(whole):
        s, w = whole.odds.to_numpy(), (whole.other.to_numpy() + 0.5) / float(total)
        model.rate = karlin(np.r_[s, -DRIFT], np.r_[w, max(1e-9, 1 - w.sum())])
    marks = marked(labels, id_col, label_col)
    texts, known = labelled_sample(docs, marks, id_col, text_col, sample_bytes)
    share = marks.agg(F.avg("y")).first()[0]
    x = np.array([model.surprise(*model.segments(t)) for t in texts])
    y = np.array(known, float)
    if len(set(y)) < 2:
        model.slope, model.offset = 0.0, float(np.clip(40 * (2 * (share if share is not None else 0.5) - 1), -4, 4))
        return model
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    unit = max(x.max(), 1e-9)
    a = b = 0.0
    for _ in range(200):  # Newton steps of a logistic regression on one number
        z = a * x / unit + b
        p = 1 / (1 + np.exp(-z))
        h, e = weight * p * (1 - p), weight * (p - y)
        d = np.linalg.solve(np.array([[h @ (x / unit) ** 2 + 1e-3, h @ (x / unit)], [h @ (x / unit), h.sum() + 1e-6]]), [e @ (x / unit) + 1e-3 * a, e.sum()])
        a, b = a - np.clip(d[0], -5, 5), b - np.clip(d[1], -5, 5)
    model.slope, model.offset = a / unit, b
    return model


def toxicity(text: Column | str, model: ToxicModel) -> Column:
    """struct<score, segments> of each whole text; segments: first and last token and score of the
    significant ones; null and empty texts have none."""

    @F.pandas_udf("score double, segments array<struct<first:int,last:int,score:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            got = [model.score(t) for t in series]
            yield pd.DataFrame({"score": [s for s, _ in got], "segments": [[{"first": x.first, "last": x.last, "score": x.score} for x in found] for _, found in got]})

    return run(text)


def score_toxicity(docs: DataFrame, model: ToxicModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted, segments. Repeated rows keep theirs, other columns take no part, no shuffle."""
    session(docs)
    rows = docs.select(F.col(id_col), (id_remainder(id_col, 5) == 0).alias("held_out"), toxicity(F.col(text_col), model).alias("_p"))
    return rows.select(id_col, "held_out", "_p.score", (F.col("_p.score") >= threshold).cast("int").alias("predicted"), "_p.segments")
