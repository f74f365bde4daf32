"""Exact top-k search by inner product with an M-tree: paged metric nodes, covering radii and best-first search.

A node covers its vectors with a ball: a pivot p and a radius r, so that no product with a query q is over q.p + |q|r. There are three
levels: routing pivots, fitted on a sample, divide the vectors into regions; a region is dealt into nodes of bounded size; a node
holds pages, got by halving it across its widest direction until a page is full. Nodes and pages have pivots and radii of their own.

A query asks its most promising nodes first, then, with the k-th product found there as its bar, those whose bound reaches it. Within
a node it visits pages by their bounds, the best first; in a page the stored distances d of vectors to the page's pivot pass over
all with q.p + |q|d under the bar, without computing their products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minuteloom.llm.common import few, session, stored

#: Vectors of a page, vectors of a node, rows that the routing pivots are fitted on, most pivots, most nodes (they grow beyond).
PAGE, NODE, SAMPLE, ROUTES, NODES = 128, 8192, 16_384, 2048, 50_000
ROUTING = 0.5  # routing pivots for the square root of the vectors
#: Queries that are searched together in one copy of a node, and in memory at once; nodes that a query asks before its bar is known.
COPY, BLOCK, FIRST = 65_536, 256, 2
SLACK = 1e-9
#: What a node is stored as.
PACKED = ("ids", "vectors", "dist", "ends", "pivots")


def quantised(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of the vectors; shorter ones are filled with zeros, which add nothing to a product."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy())
    lengths = np.diff(np.r_[0, ends])
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the rows of both."""
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, d))


def routing_pivots(sample: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """k-means over a sample, begun with rows spread over it; fewer pivots where rows coincide."""
    rows = np.unique(sample, axis=0)
    pivots = rows[np.linspace(0, len(rows) - 1, min(n, len(rows))).astype(int)]
    for _ in range(rounds):
        own = apart(rows, pivots).argmin(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, own, rows)
        counts = np.bincount(own, minlength=len(pivots))[:, None]
        pivots = np.where(counts > 0, sums / np.maximum(counts, 1), pivots)
    return pivots


def ball(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pivot of vectors, their mean, and the distance of each to it."""
    pivot = v.mean(axis=0)
    return pivot, np.sqrt(((v - pivot) ** 2).sum(axis=1))


def pages_of(v: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Row numbers of pages of ``most`` vectors or fewer: halves by rank along the line between two far vectors."""
    open_ = [np.arange(len(v))]
    while open_:
        rows = open_.pop()
        if len(rows) <= most:
            yield rows
            continue
        x = v[rows]
        a = x[ball(x)[1].argmax()]
        b = x[((x - a) ** 2).sum(axis=1).argmax()]
        order = np.argsort(x @ (b - a), kind="stable")
        open_ += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]


class Node:
    """A node as it lies in the tree: its pages one after the other, the vectors of each by distance to its pivot, the farthest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, dist: np.ndarray, ends: np.ndarray, pivots: np.ndarray):
        self.ids, self.vectors, self.dist, self.ends, self.pivots = ids, vectors, dist, ends, pivots
        self.starts = np.r_[0, ends[:-1]]
        self.radii = dist[self.starts]

    @classmethod
    def of(cls, ids: np.ndarray, v: np.ndarray, page: int = PAGE) -> Node:
        order, dist, ends, pivots = [], [], [], []
        for rows in pages_of(v, page):
            pivot, d = ball(v[rows])
            far = np.argsort(-d, kind="stable")
            order.append(rows[far])
            dist.append(d[far])
            ends.append(len(rows))
            pivots.append(pivot)
        at = np.concatenate(order)
        return cls(ids[at], v[at], np.concatenate(dist), np.cumsum(ends), np.array(pivots))

    def search(self, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray], int]:
        """Of each query the k highest products here, none below its ``floor``; and how many products that took."""
        length = np.sqrt((q * q).sum(axis=1))
        centre = q @ self.pivots.T
        highest = centre + length[:, None] * self.radii
        order = np.argsort(-highest, axis=1, kind="stable")
        eps = SLACK * (1 + np.abs(highest).max(initial=0.0))
        found, scores = [np.zeros(0, np.int64)] * len(q_ids), [np.zeros(0)] * len(q_ids)
        bar, active, seen = floor.astype(float).copy(), np.arange(len(q_ids)), 0
        for step in range(len(self.ends)):
            active = active[highest[active, order[active, step]] >= bar[active] - eps]
            if not len(active):
                break
            at = order[active, step]
            for page in np.unique(at):
                who, start, end = active[at == page], self.starts[page], self.ends[page]
                # a vector nearer to the pivot than this cannot reach the bar
                least = (bar[who] - eps - centre[who, page]) / np.where(length[who] > 0, length[who], 1)
                least = least.min() if (length[who] > 0).all() else -np.inf
                stop = start + np.searchsorted(-self.dist[start:end], -least, side="right")
                s = q[who] @ self.vectors[start:stop].astype(float).T
                seen += s.size
                ids = self.ids[start:stop]
                for row, i in zip(s, who):
                    keep = np.flatnonzero((row >= bar[i]) & (ids != q_ids[i]))
                    if len(keep):
                        found[i], scores[i] = best(np.r_[found[i], ids[keep]], np.r_[scores[i], row[keep]], k)
                        if len(scores[i]) == k:
                            bar[i] = max(bar[i], scores[i][-1])
        return found, scores, seen


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids."""
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def top_products(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, id, score): for each row whose id is divisible by ``every`` the k rows of the highest integer
    products, ties to smaller ids; all rows, if fewer.

    Null vectors, vectors with null or non-finite components and null ids take no part. Shorter vectors count as
    filled with zeros. Rows with the query's id are its own; other repeated rows each take a rank. Of queries of one id that
    with the least vector asks."""
    spark = session(vectors)
    v = F.col(vector_col)
    rows = stored(vectors.filter(F.col(id_col).isNotNull() & usable(v)).select(F.col(id_col).cast("long").alias("id"), quantised(v, scale).alias("v")), "vectors")
    width, n, peak, n_queries = rows.agg(F.max(F.size("v")), F.count("*"), F.max(F.array_max(F.transform("v", F.abs))), F.count_if(F.col("id") % every == 0)).first()
    schema = f"query_id long, rank int, {id_col} long, score long"
    if not n or not n_queries or not width:
        return spark.createDataFrame([], schema)
    kind = "f4" if peak < 1 << 24 else "f8"  # whole numbers that both hold exactly
    per_node = max(NODE, -(-n // NODES))
    drawn = rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).toArrow()
    routes = routing_pivots(matrix(drawn["v"].combine_chunks(), width), int(min(ROUTES, max(4, round(ROUTING * n**0.5)))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(apart(matrix(b.column(1), width), routes).argmin(axis=1))], ["id", "v", "route"])

    placed = stored(rows.mapInArrow(assign, "id long, v array<double>, route long"), "placed")
    parts = np.ones(len(routes), np.int64)
    for r in placed.groupBy("route").count().collect():  # a row for each pivot
        parts[r.route] = -(-r["count"] // per_node)
    part = F.pmod(F.xxhash64("id", "v"), F.element_at(F.array(*(F.lit(int(x)) for x in parts)), (F.col("route") + 1).cast("int")))

    def build(key: tuple, t: pa.Table) -> pa.Table:
        m = matrix(t["v"].combine_chunks(), width)
        node, (pivot, d) = Node.of(t["id"].to_numpy(), m), ball(m)
        packed = (node.ids, node.vectors.astype(kind), node.dist, node.ends.astype(np.int64), node.pivots)
        return pa.table({"route": [key[0].as_py()], "part": [key[1].as_py()], **{c: [x.tobytes()] for c, x in zip(PACKED, packed)}, "pivot": [pivot], "radius": [d.max()]})

    nodes = stored(placed.withColumn("part", part).groupBy("route", "part").applyInArrow(build, f"route long, part long, {', '.join(f'{c} binary' for c in PACKED)}, pivot array<double>, radius double"), "nodes")
    told = nodes.select("route", "part", "pivot", "radius").orderBy("route", "part").toArrow()  # a row for each node, NODES at most
    of_route, of_part, radius = (told[c].to_numpy() for c in ("route", "part", "radius"))
    pivots = matrix(told["pivot"].combine_chunks(), width)

    def asks(of: DataFrame, first: bool) -> DataFrame:
        """A query with the nodes that it asks: the FIRST most promising ones, or of the others those whose bound reaches its bar."""

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                size = max(1, 1_000_000 // len(radius))
                for b in (whole.slice(x, size) for x in range(0, whole.num_rows, size)):
                    q, bar = matrix(b.column("v"), width), b.column("bar").to_numpy()
                    highest = q @ pivots.T + np.sqrt((q * q).sum(axis=1))[:, None] * radius
                    ahead = np.argsort(-highest, axis=1, kind="stable")[:, :FIRST]
                    chosen = np.zeros(highest.shape, bool)
                    np.put_along_axis(chosen, ahead, True, axis=1)
                    if not first:
                        chosen = ~chosen & (highest * (1 + SLACK) + SLACK >= bar[:, None])
                    i, j = np.nonzero(chosen)
                    for at in range(0, len(i), 4096):
                        y = j[at : at + 4096]
                        yield pa.RecordBatch.from_arrays([*b.take(pa.array(i[at : at + 4096])).columns, pa.array(of_route[y]), pa.array(of_part[y])], ["id", "v", "bar", "route", "part"])

        return of.mapInArrow(choose, "id long, v array<double>, bar double, route long, part long")

    place, copies = ["route", "part", "copy"], max(1, n_queries // COPY)
    none = lambda c, t: F.lit(None).cast(t).alias(c)

    def searched(of: DataFrame, first: bool) -> DataFrame:
        """(query_id, id, score): what each query finds in the nodes that it asks."""
        x = stored(asks(of, first).withColumn("copy", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(copies))), "asks")
        held = nodes.join(few(x.select(*place).distinct()), ["route", "part"]).select(*place, F.lit(0).alias("step"), none("id", "long"), none("v", "array<double>"), none("bar", "double"), *PACKED)
        put = x.select(*place, F.lit(1).alias("step"), "id", "v", "bar", *(none(c, "binary") for c in PACKED))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, node, waiting = None, None, []

            def answer() -> Iterator[pa.RecordBatch]:
                ids = np.array([w[0] for w in waiting])
                found, scores, _ = node.search(ids, np.array([w[1] for w in waiting]), np.array([w[2] for w in waiting]), k)
                waiting.clear()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(f) for f in found])), pa.array(np.concatenate(found)), pa.array(np.concatenate(scores).astype(np.int64))], ["query_id", "id", "score"])

            for b in batches:
                keys = list(zip(*(b.column(c).to_pylist() for c in place)))
                steps, ids, bars = (b.column(c).to_pylist() for c in ("step", "id", "bar"))
                vs = matrix(b.column("v").fill_null([]), width)
                for i, key in enumerate(keys):
                    if waiting and (key != now or len(waiting) >= BLOCK):
                        yield from answer()
                    if steps[i] == 0:
                        now = key
                        own, m, d, ends, p = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in zip(PACKED, (np.int64, kind, float, np.int64, float)))
                        node = Node(own, m.reshape(-1, width), d, ends, p.reshape(-1, width))
                    elif key == now:
                        waiting.append((ids[i], vs[i].copy(), bars[i]))
            if waiting:
                yield from answer()

        return held.unionByName(put).repartition(*place).sortWithinPartitions(*place, "step").mapInArrow(run, "query_id long, id long, score long")

    def best_of(df: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return df.withColumn("rank", rank).filter(F.col("rank") <= k)

    queries = stored(rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).withColumn("bar", F.lit(float("-inf"))), "queries")
    near = stored(best_of(searched(queries, True)), "nearest")
    bars = near.filter(F.col("rank") == k).groupBy(F.col("query_id").alias("id")).agg(F.max("score").cast("double").alias("got"))
    rest = queries.join(bars, "id", "left").select("id", "v", F.coalesce("got", "bar").alias("bar"))
    out = best_of(near.drop("rank").unionByName(searched(rest, False)))
    return out.select("query_id", F.col("rank").cast("int"), F.col("id").alias(id_col), "score")
