"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters run over overlapping windows of bytes; their outputs are pooled over overlapping chunks
that cover the whole document, a small layer rates each chunk, the ratings are max-pooled over the
document and combined into one probability."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minuteloom.llm.common import id_remainder, labelled_sample, marked, session

STRIDE, TAPS = 3, 4  # a window has TAPS * STRIDE bytes and moves by STRIDE
EMBED, FILTERS, HIDDEN = 6, 32, 24
HALF = 32  # windows in half a chunk; chunks overlap by a half
HALF_BYTES = HALF * STRIDE
RUN_BYTES = 1 << 19
#: Bound of the sample that the network is fitted on: bytes of text of each label.
SAMPLE_BYTES = 3_000_000


@dataclass
class Layout:
    """Where each document lies among the padded bytes."""

    data: np.ndarray
    lengths: np.ndarray
    halves: np.ndarray
    first: np.ndarray = field(init=False)
    live: np.ndarray = field(init=False)
    last: np.ndarray = field(init=False)

    @classmethod
    def of(cls, texts: list[bytes]) -> Layout:
        lengths = np.array([len(t) for t in texts], np.int64)
        halves = -(-(lengths + TAPS * STRIDE) // HALF_BYTES)
        ends = np.cumsum(halves) * HALF_BYTES
        data = np.zeros(int(ends[-1]), np.uint8)
        for t, e, h in zip(texts, ends, halves):
            data[e - h * HALF_BYTES : e - h * HALF_BYTES + len(t)] = np.frombuffer(t, np.uint8)
        return cls(data, lengths, halves)

    def __post_init__(self) -> None:
        n = int(self.halves.sum())
        self.first = np.cumsum(self.halves) - self.halves
        at = np.arange(n * HALF) * STRIDE
        self.live = (at - np.repeat(self.first * HALF_BYTES, self.halves * HALF)) < np.repeat(self.lengths, self.halves * HALF)
        self.last = np.zeros(n, bool)
        self.last[self.first + self.halves - 1] = True


@dataclass
class ByteNet:
    embed: np.ndarray
    filters: np.ndarray  # [TAPS, STRIDE * EMBED, FILTERS]
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 5) -> ByteNet:
        r = np.random.default_rng(seed)
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        return cls(f(256, EMBED, scale=1.0), f(TAPS, STRIDE * EMBED, FILTERS, scale=(TAPS * STRIDE * EMBED) ** -0.5), f(2 * FILTERS, HIDDEN, scale=(2 * FILTERS) ** -0.5), np.zeros(HIDDEN, np.float32), f(HIDDEN, scale=0.3), np.zeros(1, np.float32))

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.hidden, self.hidden_bias, self.out, self.bias]

    def pooled(self, x: Layout):
        """Embedded bytes, filter outputs, and their mean and maximum over each half chunk."""
        e = self.embed[x.data].reshape(-1, STRIDE * EMBED)
        n = len(e)
        a = e @ self.filters[0]
        for j in range(1, TAPS):
            a[: n - j] += e[j:] @ self.filters[j]
        np.maximum(a, 0, out=a)
        a *= x.live[:, None]
        blocks = a.reshape(-1, HALF, FILTERS)
        return e, blocks, blocks.sum(axis=1) * (4 / (2 * HALF)), blocks.max(axis=1)

    def rated(self, mean: np.ndarray, top: np.ndarray, first: np.ndarray, last: np.ndarray):
        """The rating of each document from its half chunks, and what the gradient needs."""
        step = ~last
        both_mean, both_top = mean.copy(), top.copy()
        both_mean[:-1][step[:-1]] += mean[1:][step[:-1]]
        later = np.zeros_like(top, bool)
        later[:-1] = step[:-1, None] & (top[1:] > top[:-1])
        both_top[:-1] = np.where(later[:-1], top[1:], top[:-1])
        chunk = np.concatenate([both_mean, both_top], axis=1)
        h = np.maximum(chunk @ self.hidden + self.hidden_bias, 0)
        m = np.maximum.reduceat(h, first, axis=0)
        return m @ self.out + self.bias[0], chunk, h, m, later, step

    def forward(self, x: Layout, keep: bool = False):
        e, blocks, mean, top = self.pooled(x)
        z, chunk, h, m, later, step = self.rated(mean, top, x.first, x.last)
        return (z, (e, blocks, chunk, h, m, later, step)) if keep else z

    def long_text(self, text: bytes) -> np.ndarray:
        """``forward`` of one text, its bytes worked through in runs; what is kept of a run are its half chunks."""
        means, tops = [], []
        run = RUN_BYTES // HALF_BYTES
        for at in range(0, -(-(len(text) + TAPS * STRIDE) // HALF_BYTES), run):
            # windows at the end of a run reach into the next one
            x = Layout.of([text[at * HALF_BYTES : (at + run) * HALF_BYTES + TAPS * STRIDE]])
            _, _, mean, top = self.pooled(x)
            means.append(mean[:run])
            tops.append(top[:run])
        mean, top = np.concatenate(means), np.concatenate(tops)
        last = np.zeros(len(mean), bool)
        last[-1] = True
        return self.rated(mean, top, np.zeros(1, int), last)[0]

    def gradient(self, x: Layout, wanted: np.ndarray) -> list[np.ndarray]:
        z, (e, blocks, chunk, h, m, later, step) = self.forward(x, keep=True)
        dz = ((1 / (1 + np.exp(-z)) - wanted) / len(z)).astype(np.float32)
        d_out, d_bias = m.T @ dz, np.array([dz.sum()], np.float32)
        dm = dz[:, None] * self.out
        dh = np.zeros_like(h)
        for i, (f, n) in enumerate(zip(x.first, x.halves)):
            dh[f + h[f : f + n].argmax(axis=0), np.arange(HIDDEN)] = dm[i]
        dh *= h > 0
        d_hidden, d_hidden_bias = chunk.T @ dh, dh.sum(axis=0)
        dc = dh @ self.hidden.T
        dmean, dtop = dc[:, :FILTERS].copy(), np.where(later, 0, dc[:, FILTERS:])
        dmean[1:][step[:-1]] += dc[:-1, :FILTERS][step[:-1]]
        dtop[1:] += np.where(later[:-1], dc[:-1, FILTERS:], 0)
        da = np.repeat(dmean * (4 / (2 * HALF)), HALF, axis=0).reshape(blocks.shape)
        best = blocks.argmax(axis=1)
        i, k = np.indices(best.shape)
        da[i, best, k] += dtop
        da = (da * (blocks > 0)).reshape(-1, FILTERS)
        n = len(e)
        d_filters = np.stack([e[j:].T @ da[: n - j] for j in range(TAPS)])
        de = da @ self.filters[0].T
        for j in range(1, TAPS):
            de[j:] += da[: n - j] @ self.filters[j].T
        de = de.reshape(-1, EMBED)
        d_embed = np.stack([np.bincount(x.data, de[:, k], 256) for k in range(EMBED)], axis=1)
        return [d_embed, d_filters, d_hidden, d_hidden_bias, d_out, d_bias]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out, i = [], 0
        while i < len(texts):
            if len(texts[i]) > RUN_BYTES:
                out.append(self.long_text(texts[i]))
                i += 1
                continue
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= RUN_BYTES):
                size += len(texts[j]) + HALF_BYTES
                j += 1
            out.append(self.forward(Layout.of(texts[i:j])))
            i = j
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-z.astype(np.float64)))


def fit(texts: list[bytes], labels: list[int], prior: float | None = None, epochs: int = 6, batch: int = 24, rate: float = 3e-3) -> ByteNet:
    """Adam on class-balanced batches; then the bias is set back to the share ``prior`` of label 1."""
    net, r = ByteNet.fresh(), np.random.default_rng(3)
    kinds = [[i for i, y in enumerate(labels) if y == k] for k in (0, 1)]
    if not all(kinds):
        net.out[:] = 0
        net.bias[0] = 4 * (1 if kinds[1] else -1 if kinds[0] else 0)
        return net
    steps = max(60, epochs * max(map(len, kinds)) * 2 // batch)
    m, v = [np.zeros_like(p) for p in net.parts], [np.zeros_like(p) for p in net.parts]
    pools: list[list[int]] = [[], []]
    for t in range(1, steps + 1):
        at = []
        for k in (0, 1):
            if len(pools[k]) < batch // 2:
                pools[k] += r.permutation(kinds[k]).tolist() * (1 + batch // len(kinds[k]))
            at += [pools[k].pop() for _ in range(batch // 2)]
        grads = net.gradient(Layout.of([texts[i] for i in at]), np.array([labels[i] for i in at], np.float32))
        now = rate * min(1, 2 * (1 - (t - 1) / steps))
        for p, g, a, b in zip(net.parts, grads, m, v):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= now * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    p = min(0.99, max(0.01, prior if prior is not None else len(kinds[1]) / len(labels)))
    net.bias[0] += np.log(p / (1 - p))
    return net


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_bytes: int = SAMPLE_BYTES) -> ByteNet:
    """Fit on a sample of the labelled rows whose crc32(id) mod 5 is not 0; ``sample_bytes`` of each label bound it.

    Rows with a null text, label or id take no part; of equal rows in ``labels`` one counts. Only ids and lengths are
    joined with the labels, so texts are not shuffled."""
    session(docs)
    marks = marked(labels, id_col, label_col)
    share = marks.agg(F.avg("y")).first()[0]
    texts, y = labelled_sample(docs, marks, id_col, text_col, sample_bytes)
    return fit([t.encode("utf-8", "surrogatepass") for t in texts], y, share)


def quality(text: Column | str, net: ByteNet) -> Column:
    """Probability of label 1 of each whole text; null counts as the empty text."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series(net.scores([b"" if t is None else t.encode("utf-8", "surrogatepass") for t in series]), dtype="float64")

    return run(text)


def score_quality(docs: DataFrame, net: ByteNet, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted. Repeated rows keep their rows, other columns take no part, no shuffle."""
    session(docs)
    rows = docs.select(F.col(id_col), (id_remainder(id_col, 5) == 0).alias("held_out"), quality(F.col(text_col), net).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
