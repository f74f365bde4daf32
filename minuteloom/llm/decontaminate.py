"""Benchmark decontamination: n-gram seeds find training passages, Smith-Waterman alignment scores them.

Every n-gram of a test item is a seed, however many texts it stands in: a leak repeated often makes its own
n-grams common. Seeds that a text and an item share mark passages. Those in which no alignment can reach the
least score, by a bound that is never too low, are passed over; the others are aligned word by word: edited
copies align with gaps and mismatches."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minuteloom.llm.common import session

SEED = 3
LEAST_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bound of the items that tasks get at once; larger benchmarks are worked through in slices of this many bytes of text.
SLICE_BYTES = 8_000_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@dataclass
class Items:
    """A slice of the benchmark, ready for looking up."""

    ids: list[int | None]
    texts: list[list[int]]
    vocabulary: dict[str, int]
    grams: dict[tuple[int, ...], list[int]]  # seed -> places in ids
    short: bool  # whether an item has fewer words than a seed

    @classmethod
    def of(cls, rows: list[tuple[int | None, str]]) -> Items:
        vocabulary: dict[str, int] = {}
        texts = [[vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(t)] for _, t in rows]
        grams: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for i, t in enumerate(texts):
            k = min(SEED, len(t))
            for g in {tuple(t[j : j + k]) for j in range(len(t) - k + 1)} if t else ():
                grams[g].append(i)
        return cls([i for i, _ in rows], texts, vocabulary, dict(grams), any(0 < len(t) < SEED for t in texts))

    def hits(self, text: str | None) -> tuple[list[int], list[tuple[int, tuple[int, ...]]]]:
        """The text's word numbers (0: in no item), and the places and n-grams that items have too."""
        get = self.vocabulary.get
        ids = [get(w, 0) for w in words(text)]
        grams, found = self.grams, []
        for k in range(1, SEED + 1) if self.short else (SEED,):
            if len(ids) < k:
                continue
            known = np.array(ids) > 0
            both = known[: len(ids) - k + 1].copy()
            for j in range(1, k):
                both &= known[j : len(ids) - k + 1 + j]
            found += [(p, g) for p in np.flatnonzero(both).tolist() if (g := tuple(ids[p : p + k])) in grams]
        return ids, found


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int, int]:
    """Best local alignment: score over that of the whole item, first and last word of the passage, matched words."""
    m, n = len(item), len(passage)
    h = np.zeros((m + 1, n + 1), np.int32)
    steps = -GAP * np.arange(n + 1)
    for i in range(1, m + 1):
        row = np.maximum(h[i - 1] + GAP, 0)
        np.maximum(row[1:], h[i - 1, :-1] + np.where(passage == item[i - 1], MATCH, MISMATCH), out=row[1:])
        h[i] = np.maximum.accumulate(row + steps) - steps  # a gap in the item: the best place before, less its length
    i, j = np.unravel_index(h.argmax(), h.shape)
    best, last, matched = int(h[i, j]), int(j) - 1, 0
    while i and j and h[i, j] > 0:
        same = item[i - 1] == passage[j - 1]
        if h[i, j] == h[i - 1, j - 1] + (MATCH if same else MISMATCH):
            matched += bool(same)
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return best / (MATCH * m), int(j), last, matched


def bound(item: Counter, passage: list[int]) -> int:
    """A score that no alignment of the item and the passage exceeds: words that the item has match at best, each
    other word inside the alignment costs, and no word matches oftener than it stands in the item."""
    best = total = 0
    for w in passage:
        total = total + MATCH if w in item else max(0, total + max(MISMATCH, GAP))
        if total > best:
            best = total
    return min(best, MATCH * sum((item & Counter(passage)).values())) if best else 0


def windows(low: int, high: int, reach: int) -> Iterator[tuple[int, int]]:
    """Overlapping windows of 2 * ``reach`` words of which one holds any stretch of ``reach`` words whole."""
    for start in range(low, max(low + 1, high - reach), reach):
        yield start, min(high, start + 2 * reach)


def leaks_of(text: str | None, items: Items, least: float = LEAST_SCORE) -> list[dict]:
    """The best aligned passage of each item that the text holds with a score of ``least`` or more."""
    ids, found = items.hits(text)
    by_item: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for p, g in found:
        for i in items.grams[g]:
            by_item[i].append((p, g))
    out = []
    all_ids = np.array(ids, np.int64) if by_item else None
    for i, marks in sorted(by_item.items()):
        item, best = items.texts[i], None
        span = 2 * len(item)
        start, own = 0, Counter(item)
        while start < len(marks):  # seeds nearer to each other than the item is long make one passage
            end = start + 1
            while end < len(marks) and marks[end][0] - marks[end - 1][0] <= len(item):
                end += 1
            low, high = max(0, marks[start][0] - span), min(len(ids), marks[end - 1][0] + SEED + span)
            # an alignment with a positive score covers 3 * len(item) words at most
            for low, high in windows(low, high, 3 * len(item)):
                if bound(own, ids[low:high]) >= least * MATCH * len(item):
                    score, first, last, matched = align(np.array(item, np.int64), all_ids[low:high])
                    if score >= least and (best is None or score > best["score"]):
                        best = {"item_id": items.ids[i], "score": score, "first_word": low + first, "last_word": low + last, "matched_words": matched}
            start = end
        if best:
            out.append(best)
    return out


def slices(bench: DataFrame, item_col: str, text_col: str) -> list[Items]:
    """The items with a text, read in order of id, those without an id too; as many slices as their size asks for. The
    driver holds all slices."""
    rows = bench.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // SLICE_BYTES))
    parts = []
    for k in range(n):
        got = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).distinct().orderBy("id", "text").collect()
        parts.append(Items.of([(r.id, r.text) for r in got]))
    return parts


def leaks(text: Column | str, items: Items, least: float = LEAST_SCORE) -> Column:
    """array of (item_id, score, first_word, last_word, matched_words) of each text; null and empty texts have none."""

    @F.pandas_udf("array<struct<item_id:long,score:double,first_word:int,last_word:int,matched_words:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([leaks_of(t, items, least) for t in series], dtype=object)

    return run(text)


def prepare(docs: DataFrame, bench: DataFrame, item_col: str = "item_id", item_text_col: str = "text") -> list[Items]:
    """The slices of the benchmark."""
    session(docs)
    return [s for s in slices(bench, item_col, item_text_col) if s.ids]


def find_leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """(id, item_id, score, first_word, last_word, matched_words): a row for each text and item of which it holds a copy.

    Null and empty texts hold nothing; items with a null or no text or without a word match nothing, those with a null id are
    found as null; repeated rows are found again each; of equal items one counts; an empty table or benchmark gives no rows.
    A long passage is aligned in overlapping windows, so memory follows the square of the item's length, not the text's."""
    out = None
    for items in prepare(docs, bench):
        rows = docs.select(F.col(id_col), F.explode(leaks(F.col(text_col), items, least)).alias("_l")).select(id_col, "_l.*")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = docs.select(F.col(id_col), *(F.lit(None).cast(t).alias(c) for c, t in (("item_id", "long"), ("score", "double"), ("first_word", "int"), ("last_word", "int"), ("matched_words", "int")))).limit(0)
    return out


def drop_leaks(docs: DataFrame, bench: DataFrame, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no copy of an item; null and empty texts stay."""
    out = docs
    for items in prepare(docs, bench):
        out = out.filter(F.size(leaks(F.col(text_col), items, least)) == 0)
    return out
