"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

The weights are learned by follow-the-regularised-leader with L1 and L2 penalties; a temperature is
fitted on rows kept aside. Features are hashed n-grams of 1 to 3 characters of the lower-cased text, in
which every run of other characters than letters counts as one space."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minuteloom.llm.common import byte_bounded_sample, id_remainder, session

UNKNOWN = "und"
BITS = 16
ORDERS = (1, 2, 3)
#: Bound of the sample that the model is fitted on: bytes of text of each language.
SAMPLE_BYTES = 1_500_000
CHUNK_CHARS = 1 << 18
_OTHER = re.compile(r"[\W\d_]+")


def prepared(text: str | None) -> str:
    """Letters in lower case, other runs as one space, a space at both ends; empty where there is no letter."""
    letters = _OTHER.sub(" ", text.lower()) if text else ""
    if not letters.replace(" ", "").isalpha():  # numbers that are no decimal digits are no letters either
        letters = " ".join("".join(c if c.isalpha() else " " for c in letters).split())
    letters = letters.strip()
    return f" {letters} " if letters else ""


def gram_ids(codes: np.ndarray) -> list[np.ndarray]:
    """Hashed ids of the n-grams of each order that begin at each character."""
    c, out = codes.astype(np.uint32), []
    for n in ORDERS:
        if len(c) < n:
            out.append(np.zeros(0, np.int64))
            continue
        h = np.full(len(c) - n + 1, 0x9E3779B9 * n & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ c[k : len(c) - n + 1 + k]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        out.append((h >> np.uint32(32 - BITS)).astype(np.int64))
    return out


@dataclass
class LanguageModel:
    names: list[str]
    table: np.ndarray  # [2 ** BITS, languages]: idf times weight
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        """Of prepared texts that aren't empty; the grams of many texts are looked up at once, those of a long one in runs."""
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        out, i = np.zeros((len(texts), len(self.names)), np.float64), 0
        while i < len(codes):
            if len(codes[i]) > CHUNK_CHARS:
                out[i] = self.long_text(codes[i])
                i += 1
                continue
            j, size = i, 0
            while j < len(codes) and (j == i or size + len(codes[j]) <= CHUNK_CHARS):
                size += len(codes[j])
                j += 1
            ends = np.cumsum([len(c) for c in codes[i:j]])
            starts = np.r_[0, ends[:-1]]
            whole = np.concatenate(codes[i:j])
            for n, ids in zip(ORDERS, gram_ids(whole)):
                votes = np.zeros((len(whole) + 1, len(self.names)), np.float64)
                np.cumsum(self.table[ids], axis=0, out=votes[1 : len(ids) + 1])
                votes[len(ids) + 1 :] = votes[len(ids)]
                last = np.maximum(starts, ends - n + 1)  # grams that would cross a text's end take no part
                out[i:j] += (votes[last] - votes[starts]) / np.maximum(1, last - starts)[:, None]
            i = j
        return out + self.bias

    def long_text(self, codes: np.ndarray) -> np.ndarray:
        """The votes of one text from counts of its grams, a run of characters after the other."""
        counts = np.zeros((len(ORDERS), 1 << BITS))
        for at in range(0, len(codes), CHUNK_CHARS):
            for k, ids in enumerate(gram_ids(codes[at : at + CHUNK_CHARS + max(ORDERS) - 1])):
                counts[k] += np.bincount(ids[:CHUNK_CHARS], minlength=1 << BITS)
        return (counts / np.maximum(1, counts.sum(axis=1))[:, None]).sum(axis=0) @ self.table

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        ready = [prepared(t) for t in texts]
        at = [i for i, t in enumerate(ready) if t]
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if at and self.names:
            z = self.logits([ready[i] for i in at]) / self.temperature
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for i, k, s in zip(at, p.argmax(axis=1), p.max(axis=1)):
                names[i] = self.names[k]
                score[i] = s
        return names, score


def fit(texts: list[str], langs: list[str], epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4) -> LanguageModel:
    """FTRL-proximal over the texts in a fixed order; every fifth text is kept aside for the temperature."""
    names = sorted(set(langs))
    rows = [(prepared(t), names.index(la)) for t, la in zip(texts, langs)]
    rows = [r for r in rows if r[0]]
    size, k = 1 << BITS, len(names)
    if not rows:
        return LanguageModel([], np.zeros((size, 0)), np.zeros(0), 1.0)
    made, df = [], np.zeros(size)
    for t, y in rows:
        parts = [np.unique(g, return_counts=True) for g in gram_ids(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32))]
        merged = np.concatenate([p[0] for p in parts])
        tf = np.concatenate([p[1] / max(1, p[1].sum()) for p in parts])
        ids, inverse = np.unique(merged, return_inverse=True)
        made.append((ids.astype(np.int32), np.bincount(inverse, tf, len(ids)).astype(np.float32), y))
        df[ids] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    order = np.random.default_rng(11).permutation(len(made))
    aside, used = (order[::5], np.delete(order, np.s_[::5])) if len(made) >= 50 else (order, order)
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))  # the last row is the bias
    w = np.zeros((size + 1, k))
    for _ in range(epochs):
        for i in used:
            ids, tf, y = made[i]
            at, x = np.r_[ids, size], np.r_[tf * idf[ids], 0.1]
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            s = x @ wi
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            g2 = g * g
            z[at] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / alpha * wi
            n[at] = ni + g2
    np.copyto(w, np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)))
    model = LanguageModel(names, w[:size] * idf[:, None], w[size] * 0.1, 1.0)
    logits, truth = model.logits([rows[i][0] for i in aside]), np.array([rows[i][1] for i in aside])

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]))

    model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    model.table = model.table.astype(np.float32)
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_bytes: int = SAMPLE_BYTES) -> LanguageModel:
    """Fit on a sample of the rows with a text and a lang whose crc32(id) mod 3 is not 1; ``sample_bytes`` of each
    language bound it. Without such rows the model knows no language and every text is ``und``."""
    rows = docs.filter(id_remainder(id_col, 3) != 1).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sample = byte_bounded_sample(rows, "lang", "text", "id", sample_bytes).orderBy(F.xxhash64("id", "text"), "text", "lang")
    got = sample.select("text", "lang").toArrow()
    return fit(got["text"].to_pylist(), got["lang"].to_pylist())


def detect(text: Column | str, model: LanguageModel) -> Column:
    """struct<lang_pred, score> of each whole text; null texts and texts without a letter: ``und`` and 0."""

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            names, score = model.predict([None if t is None else t for t in series])
            yield pd.DataFrame({"lang_pred": names, "score": score})

    return run(text)


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, lang_pred, score. Repeated rows keep their rows, other columns take no part, no shuffle."""
    session(docs)
    rows = docs.select(F.col(id_col), (id_remainder(id_col, 3) == 1).alias("held_out"), detect(F.col(text_col), model).alias("_p"))
    return rows.select(id_col, "held_out", "_p.lang_pred", "_p.score")


def keep_known_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", least: float = 0.4) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a known language with a calibrated score of ``least`` or more; null
    texts, texts without a letter, and texts in no language or in several at once (a lower score) go."""
    session(docs)
    found = detect(F.col(text_col), model)
    return docs.filter((found["lang_pred"] != UNKNOWN) & (found["score"] >= least))
