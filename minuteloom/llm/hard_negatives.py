"""Hard negatives by anchor-clustered shared lists: candidates are sorted once for a cluster of anchors, all members walk that list.

Anchors are clustered by angle. For a cluster, an upper bound of a candidate's product with any member is the candidate's
length times the cosine of its angle to the centroid less the cluster's widest angle. Candidates in the order of that bound are
the cluster's list; a member (scaled to length 1) walks it until the bound falls under the last score it has to beat, which
certifies that nothing further on counts.

The lists are cut into segments, so that no task holds a whole one: candidates go to the nearest centroid and a bounded part of
it; a segment keeps its part of every list. Members walk the segments of their own centroid first and then only those whose bound
they have not beaten. Two such searches make the result: the positives of each anchor, then rows of other labels within the
windows that the positives' scores give."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minuteloom.llm.common import few, forget, session, stored
from minuteloom.llm.topk import matrix, quantised, usable

#: Candidates of a segment, most clusters, anchors that the clusters are fitted on, anchors that walk one copy of a segment.
SEGMENT, CLUSTERS, SAMPLE, COPY = 8192, 1024, 16_384, 65_536
#: Anchors that walk together in memory; entries of a list that are looked at in the first step, doubled up to the last.
BLOCK, FIRST_STEP, LAST_STEP = 512, 64, 1024
ANGLE = 1e-6  # what rounding may take from an angle


def unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 (zeros stay) and their lengths."""
    n = np.sqrt((v * v).sum(axis=1))
    return v / np.where(n > 0, n, 1)[:, None], n


def angles(u: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ centroids.T, -1, 1))


def fitted_centroids(sample: np.ndarray, clusters: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means over a sample, begun with rows far from each other; fewer clusters where rows coincide."""
    u = np.unique(unit(sample)[0], axis=0)
    at, near = [0], u @ u[0]
    while len(at) < min(clusters, len(u)):
        at.append(int(near.argmin()))
        near = np.maximum(near, u @ u[at[-1]])
    c = u[at]
    for _ in range(rounds):
        own = (u @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, u)
        moved, n = unit(sums)
        c = np.where(n[:, None] > 0, moved, c)
    return c


def walk(ids: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, bar: np.ndarray, c_ids: np.ndarray, v: np.ndarray, order: np.ndarray, bound: np.ndarray, k: int) -> tuple[tuple[np.ndarray, ...], int]:
    """(member, window, id, score): for every window of each member the ``k`` best rows of a list; and how many products that took.

    The list are the rows ``order`` of ``c_ids`` and ``v``, the highest ``bound`` (for a member of length 1) first. A window takes
    scores with lo <= 100 * score <= hi that reach ``bar``; ties go to smaller ids; a row with the member's id is its own."""
    q_len = np.sqrt((q * q).sum(axis=1))
    bar, seen, at, step = bar.copy(), 0, 0, FIRST_STEP
    got_s = np.full((*lo.shape, k), -np.inf)
    got_i = np.full((*lo.shape, k), np.iinfo(np.int64).max)
    active = np.arange(len(ids))
    slack = 1e-9 * (1 + q_len * np.abs(bound).max(initial=0))
    while at < len(order):
        active = active[q_len[active] * bound[at] + slack[active] >= bar[active].min(axis=1)]
        if not len(active):
            break
        rows = order[at : at + step]
        s, own = q[active] @ v[rows].astype(float).T, c_ids[rows]
        seen += s.size
        s[ids[active][:, None] == own] = -np.inf
        for w in range(lo.shape[1]):
            ok = (100 * s >= np.maximum(lo[active, w], 100 * bar[active, w])[:, None]) & (100 * s <= hi[active, w][:, None]) & (s > -np.inf)
            some = np.flatnonzero(ok.any(axis=1))
            if len(some):
                who = active[some]
                all_s = np.concatenate([got_s[who, w], np.where(ok[some], s[some], -np.inf)], axis=1)
                all_i = np.concatenate([got_i[who, w], np.broadcast_to(own, (len(some), len(own)))], axis=1)
                best = np.lexsort((all_i, -all_s), axis=-1)[:, :k]
                got_s[who, w], got_i[who, w] = np.take_along_axis(all_s, best, 1), np.take_along_axis(all_i, best, 1)
                bar[who, w] = np.maximum(bar[who, w], got_s[who, w, -1])
        at, step = at + step, min(2 * step, LAST_STEP)
    m, w, j = np.nonzero(got_s > -np.inf)
    return (ids[m], w, got_i[m, w, j], got_s[m, w, j]), seen


QUERY = "id long, label long, v array<double>, own long, lo array<double>, hi array<double>, bar array<double>"


class Lists:
    """The segments of a table of candidates, and what the driver keeps of them: a row for each segment, centroids, widths of clusters."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, width: int, n: int, n_anchors: int, peak: float):
        self.spark, self.width, self.blocks = rows.sparkSession, width, max(1, n_anchors // COPY)
        self.kind = kind = "f4" if peak < 1 << 24 else "f8"  # whole numbers that both hold exactly
        drawn = anchors.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).toArrow()
        wanted = int(min(CLUSTERS, max(8, n // SEGMENT, round(n_anchors**0.5))))
        self.centroids = centroids = fitted_centroids(matrix(drawn["v"].combine_chunks(), width), wanted)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                u, length = unit(matrix(b.column("v"), width))
                a = angles(u, centroids)
                own = a.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(a[np.arange(len(own)), own]), pa.array(length)], [*b.schema.names, "own", "angle", "length"])

        shape = "id long, label long, v array<double>, own long, angle double, length double"
        self.members = stored(anchors.select("id", "label", "v").mapInArrow(place, shape), "anchors")
        self.wide = np.zeros(len(centroids))
        for r in self.members.groupBy("own").agg(F.max("angle").alias("angle")).collect():  # a row for each cluster
            self.wide[r.own] = r.angle
        placed = stored(rows.select("id", "label", "v").mapInArrow(place, shape), "candidates")
        parts = np.ones(len(centroids), np.int64)
        for r in placed.groupBy("own").count().collect():
            parts[r.own] = -(-r["count"] // SEGMENT)
        part = F.pmod(F.xxhash64("id", "v"), F.element_at(F.array(*(F.lit(int(x)) for x in parts)), (F.col("own") + 1).cast("int")))

        def build(key: tuple, t: pa.Table) -> pa.Table:
            v = matrix(t["v"].combine_chunks(), width).astype(kind)
            return pa.table({"seg": [key[0].as_py()], "part": [key[1].as_py()], "ids": [t["id"].to_numpy().tobytes()], "labels": [t["label"].to_numpy().tobytes()], "vectors": [v.tobytes()], "angle": [t["angle"].to_numpy().max()], "length": [t["length"].to_numpy().max()]})

        made = placed.withColumn("part", part).withColumnRenamed("own", "seg").groupBy("seg", "part").applyInArrow(build, "seg long, part long, ids binary, labels binary, vectors binary, angle double, length double")
        self.segments = stored(made, "segments")
        told = self.segments.select("seg", "part", "angle", "length").orderBy("seg", "part").toArrow()
        self.seg, self.part, self.angle, self.length = (told[c].to_numpy() for c in ("seg", "part", "angle", "length"))
        forget(placed)

    def asks(self, queries: DataFrame, nearest: bool) -> DataFrame:
        """A query with each segment that it walks: those of its own centroid, or the others that may hold what its bar admits."""
        width, centroids, seg, part, angle, length = self.width, self.centroids, self.seg, self.part, self.angle, self.length

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                size = max(1, 1_000_000 // max(1, len(seg)))
                for b in (whole.slice(x, size) for x in range(0, whole.num_rows, size)):
                    own = b.column("own").to_numpy()[:, None] == seg
                    if not nearest:
                        u, q_len = unit(matrix(b.column("v"), width))
                        apart = np.maximum(0.0, angles(u, centroids)[:, seg] - angle - ANGLE)
                        least = np.array([min(x) for x in b.column("bar").to_pylist()])
                        highest = q_len[:, None] * np.maximum(0.0, np.cos(np.minimum(apart, np.pi))) * length
                        own = ~own & (highest * (1 + 1e-9) + 1e-9 >= least[:, None])
                    i, j = np.nonzero(own)
                    for at in range(0, len(i), 4096):
                        y = j[at : at + 4096]
                        yield pa.RecordBatch.from_arrays([*b.take(pa.array(i[at : at + 4096])).columns, pa.array(seg[y]), pa.array(part[y])], [*b.schema.names, "seg", "part"])

        return queries.mapInArrow(choose, f"{QUERY}, seg long, part long")

    def search(self, queries: DataFrame, k: int, same_label: bool, nearest: bool) -> DataFrame:
        """(id, w, other, score): of each window the ``k`` best rows of the same label, or of others, in each segment walked."""
        width, centroids, wide, kind = self.width, self.centroids, self.wide, self.kind
        asked = stored(self.asks(queries, nearest).withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(self.blocks))), "asks")
        none = lambda *names: [F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in names)]
        place = ["seg", "part", "block"]
        held = self.segments.join(few(asked.select(*place).distinct()), ["seg", "part"]).select(*place, F.lit(0).alias("step"), *none("id long", "label long", "v array<double>", "own long", "lo array<double>", "hi array<double>", "bar array<double>"), "ids", "labels", "vectors")
        told = asked.select(*place, F.lit(1).alias("step"), "id", "label", "v", "own", "lo", "hi", "bar", *none("ids binary", "labels binary", "vectors binary"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, c_ids, c_labels, v, u, length, own, waiting = None, None, None, None, None, None, None, []
            order, bound = None, None

            def answer() -> Iterator[pa.RecordBatch]:
                ids, labels = np.array([w[0] for w in waiting]), np.array([w[1] for w in waiting])
                q, lo, hi, bar = (np.array([w[i] for w in waiting], float) for i in (2, 3, 4, 5))
                for label in np.unique(labels):
                    mine, rows = labels == label, order[(c_labels[order] == label) == same_label]
                    found, _ = walk(ids[mine], q[mine], lo[mine], hi[mine], bar[mine], c_ids, v, rows, bound[rows], k)
                    yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1].astype(np.int32)), pa.array(found[2]), pa.array(found[3])], ["id", "w", "other", "score"])
                waiting.clear()

            for b in batches:
                keys = list(zip(*(b.column(c).to_pylist() for c in place)))
                steps, owns, ids, labels, los, his, bars = (b.column(c).to_pylist() for c in ("step", "own", "id", "label", "lo", "hi", "bar"))
                vs = matrix(b.column("v").fill_null([]), width)
                for i, key in enumerate(keys):
                    if waiting and (key != now or owns[i] != own or len(waiting) >= BLOCK):
                        yield from answer()
                    if steps[i] == 0:
                        now, own = key, None
                        c_ids, c_labels, v = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in (("ids", np.int64), ("labels", np.int64), ("vectors", kind)))
                        v = v.reshape(-1, width)
                        u, length = unit(v.astype(float))
                    elif key == now:
                        if owns[i] != own:  # the list of a cluster is sorted once
                            own = owns[i]
                            bound = length * np.cos(np.minimum(np.maximum(0.0, angles(u, centroids[own : own + 1])[:, 0] - wide[own] - ANGLE), np.pi))
                            order = np.lexsort((c_ids, -bound))
                        waiting.append((ids[i], labels[i], vs[i].copy(), los[i], his[i], bars[i]))
            if waiting:
                yield from answer()

        return held.unionByName(told).repartition(*place).sortWithinPartitions(*place, "step", "own").mapInArrow(run, "id long, w int, other long, score double")

    def both_searches(self, queries: DataFrame, k: int, same_label: bool) -> DataFrame:
        """(id, w, other, score, rank) over all segments."""
        rank = F.row_number().over(Window.partitionBy("id", "w").orderBy(F.desc("score"), "other"))
        near = stored(self.search(queries, k, same_label, True).withColumn("rank", rank).filter(F.col("rank") <= k), "near")
        full = near.filter(F.col("rank") == k).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("full"))  # an entry for each window
        bar = F.transform("bar", lambda x, i: F.greatest(x, F.coalesce(F.element_at("full", i), x)))
        rest = queries.join(full, "id", "left").withColumn("bar", F.when(F.col("full").isNull(), F.col("bar")).otherwise(bar)).drop("full")
        return near.drop("rank").unionByName(self.search(rest, k, same_label, False)).withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row whose id is divisible by ``every``
    its ``positives`` best rows of the same label, and for each of them the ``negatives`` best rows of other labels whose score is
    ``low`` to ``high`` hundredths of the positive's; scores are integer products, ties go to smaller ids.

    Rows with a null id, label or vector, or with null or non-finite components take no part. Shorter vectors count as filled with
    zeros. Rows with the anchor's id are its own; other repeated rows each take a place. Of anchors with one id the one with the
    least label and vector counts. An empty table, or one without anchors, gives no rows; other columns are left aside."""
    spark = session(vectors)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    v = F.col(vector_col)
    used = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(v))
    rows = stored(used.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), quantised(v, scale).alias("v")), "vectors")
    width, n, peak = rows.agg(F.max(F.size("v")), F.count("*"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    anchors = stored(rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v"), "anchors")
    n_anchors = anchors.count()
    if not n or not n_anchors or not width:
        return spark.createDataFrame([], out)
    lists = Lists(rows, anchors, width, n, n_anchors, peak)
    some = lambda x: F.array(F.lit(float(x)))
    best = stored(lists.both_searches(lists.members.drop("angle", "length").withColumns({"lo": some("-inf"), "hi": some("inf"), "bar": some("-inf")}), positives, True), "positives")
    by_rank = F.map_from_entries(F.collect_list(F.struct("rank", "score")))  # an entry for each positive
    ranks = F.array(*(F.lit(i + 1) for i in range(positives)))
    # a window that no score can be in (no positive, or one below zero) is never walked for
    limits = lambda x, none: F.transform(ranks, lambda i: F.coalesce(F.when(low * F.element_at("s", i) <= high * F.element_at("s", i), x * F.element_at("s", i)), F.lit(none)))
    least, most = limits(low, float("inf")), limits(high, float("-inf"))
    asked = lists.members.drop("angle", "length").join(best.groupBy("id").agg(by_rank.alias("s")), "id").withColumns({"lo": least, "hi": most, "bar": F.transform(least, lambda x: x / 100)}).drop("s")
    got = lists.both_searches(asked, negatives, False)
    of = best.select("id", (F.col("rank") - 1).alias("w"), F.col("other").alias("positive_id"), F.col("score").cast("long").alias("positive_score"))
    return got.join(of, ["id", "w"]).select(F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int"), F.col("other").alias("negative_id"), "positive_score", F.col("score").cast("long").alias("negative_score"))
