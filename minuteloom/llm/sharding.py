"""Sharding by sampled splitters, in DataFrame functions only.

The law is ``bytes``: shards of near equal size. Keys are (hash of the text, hash of the id), so equal
texts lie side by side. Size-weighted samples of the keys give quantile boundaries; records are dealt to
those ranges and ranges are cut evenly by key. Of a piece that is still overfull, each text that alone overfills
one is subdivided by the hash of the id, the others by a hash of the text. Shards are runs of pieces; an equal
text is split over shards only if it overfills a piece by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minuteloom.llm.common import session, stored, unit_hash

SAMPLE = 20_000  # expected sampled keys
RANGES = 64
PIECES_PER_SHARD = 64
PIECE_ROWS = 200_000


def _leaf(key: Column, bounds: list[int], first: int = 0) -> Column:
    """Index of the range that holds the key, as a balanced tree of comparisons."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(key < F.lit(bounds[mid]), _leaf(key, bounds[:mid], first)).otherwise(_leaf(key, bounds[mid + 1 :], first + mid + 1))


def splitters(rows: DataFrame, total: int, ranges: int = RANGES) -> list[int]:
    """Boundaries between ranges of about equal bytes, from keys drawn with a chance in proportion to their size."""
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(SAMPLE / max(1, total)))
    drawn = rows.filter(unit_hash("k2", "k1", seed=3) < chance)
    at = [i / ranges for i in range(1, ranges)]
    got = drawn.agg(F.percentile_approx("k1", at, 10_000)).first()[0]
    return sorted(set(got or []))


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard, within shards 0 to ``shards`` - 1.

    Null texts have size 1 and the checksum of the empty text. Repeated rows and ids keep their rows and take
    neighbouring slots; other columns take no part; an empty table gives no rows."""
    spark = session(docs)
    text = F.col(text_col)
    rows = stored(
        docs.select(
            F.col(id_col).alias("_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            F.xxhash64(text).alias("k1"), F.xxhash64(F.col(id_col), F.lit(1)).alias("k2"),
        ), "shard-keys")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    bounds = splitters(rows, total)
    edges = [-(2**63), *bounds, 2**63]
    per_range = max(1, -(-shards * PIECES_PER_SHARD // RANGES), -(-n // (RANGES * PIECE_ROWS)))
    piece_bytes = max(1, total // (shards * PIECES_PER_SHARD))
    r = _leaf(F.col("k1"), bounds)
    low, width = F.array(*[F.lit(float(x)) for x in edges[:-1]]), F.array(*[F.lit(float(b - a)) for a, b in zip(edges, edges[1:])])
    part = F.floor((F.col("k1").cast("double") - F.get(low, F.col("r"))) / F.get(width, F.col("r")) * per_range)
    dealt = rows.withColumn("r", r).withColumn("p", F.greatest(F.lit(0), F.least(F.lit(per_range - 1), part.cast("int"))))
    sums = dealt.groupBy("r", "p").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    full = lambda times: (F.col("bytes") > times * piece_bytes) | (F.col("rows") > times * PIECE_ROWS)
    cuts = F.greatest(F.lit(1), F.ceil(F.col("bytes") / piece_bytes), F.ceil(F.col("rows") / PIECE_ROWS))
    # fewer than shards * PIECES_PER_SHARD + rows / PIECE_ROWS pieces can be overfull, and as few texts can overfill one
    small = F.broadcast if n < 1_000_000 * PIECE_ROWS else (lambda df: df)
    overfull = sums.filter(full(2))
    texts = dealt.join(small(overfull.select("r", "p")), ["r", "p"], "left_semi").groupBy("r", "p", "k1").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    heavy = stored(texts.filter(full(1)).select("r", "p", "k1", "bytes", "rows", cuts.alias("own")), "shard-heavy")
    taken = heavy.groupBy("r", "p").agg(F.sum("bytes").alias("heavy_bytes"), F.sum("rows").alias("heavy_rows"))
    left = [(F.col(c) - F.coalesce(f"heavy_{c}", F.lit(0))).alias(c) for c in ("bytes", "rows")]
    rest = overfull.join(small(taken), ["r", "p"], "left").select("r", "p", *left).select("r", "p", cuts.alias("cuts"))
    dealt = dealt.join(small(rest), ["r", "p"], "left").join(small(heavy.select("r", "p", "k1", "own")), ["r", "p", "k1"], "left")
    by_text = F.pmod(F.xxhash64("k1", F.lit(2)), F.coalesce("cuts", F.lit(1)))
    alone = F.when(F.col("own").isNotNull(), F.col("k1")).otherwise(0)
    s = F.when(F.col("own").isNotNull(), F.pmod("k2", "own")).otherwise(by_text)
    dealt = stored(dealt.withColumn("t", alone).withColumn("s", s).drop("cuts", "own"), "shard-pieces")
    piece = ["r", "p", "t", "s"]  # t: the text of a piece that holds one alone, else 0
    pieces = dealt.groupBy(*piece).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    order = Window.orderBy(*piece)  # of pieces, not of records
    mid = F.sum("bytes").over(order) - F.col("bytes") / 2
    pieces = pieces.withColumn("shard", F.least(F.lit(shards - 1), F.floor(mid * shards / max(1, total))).cast("int"))
    within = Window.partitionBy("shard").orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("base", F.coalesce(F.sum("rows").over(within), F.lit(0))).select(*piece, "shard", "base")
    place = F.row_number().over(Window.partitionBy(*piece).orderBy("k1", "k2", "_id", "size"))
    return dealt.join(pieces, piece).select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + place - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
