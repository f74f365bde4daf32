"""Connected components of a link table: forests within tasks, large stars between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minuteloom.llm.common import forget, stored

#: Links that a task joins at once; its memory is bounded by them, not by its partition.
BLOCK = 500_000


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links as a forest: each node that is not the least of its part, with the least one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while True:
        x, y = up[a], up[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while True:  # every node points at its root
            higher = up[up]
            if (higher == up).all():
                break
            up = higher
    child = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[child], nodes[up[child]]


def _forest(links: DataFrame) -> DataFrame:
    """The links (u, v), v < u, as forests of what each task reads, again with v < u.

    A task works in blocks that end where u changes, so a task whose rows are sorted by u joins all that a node links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def joined(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            u, v = _roots(u, v)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            rows += b.num_rows
            if rows >= BLOCK:
                u, v = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(u == u[-1], True)) if (u[:-1] <= u[1:]).all() else len(u)
                if cut:
                    yield joined(u[:cut], v[:cut])
                    u, v = u[cut:], v[cut:]
                else:  # one node fills the block: its least link stands for the rest
                    yield joined(u, v)
                    u, v = u[:1], v.min(keepdims=True)
                held, rows = [(u, v)], len(u)
        if held:
            yield joined(*(np.concatenate(x) for x in zip(*held)))

    return links.mapInArrow(run, "u long, v long")


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours linked to the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    x = both.join(least, "u")
    return x.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _are_stars(links: DataFrame) -> bool:
    """Whether each node has one link to a smaller one, and none of those has such a link itself."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    seen = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
    return not seen.filter((F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("low") == 0))).count()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, label): the least node that each linked node can reach, itself included; nodes without links are absent.

    Null ends, loops and repeated links are passed over. Tasks first join the links that they read. In each round that
    follows, a large star brings nodes to the least neighbour of their neighbours; dealt by the larger end, tasks join
    what one node links. Each round is written to the shared folder, the last when every part is a star."""
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    now = stored(_forest(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))), "links")
    while not _are_stars(now):
        nxt = stored(_forest(_large_star(now).repartition("u").sortWithinPartitions("u")), "links")
        forget(now)
        now = nxt
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
