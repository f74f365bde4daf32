"""Exact medians of groups of any size, by rank instead of a list of all values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Boundaries between which the values of a group are counted.
PARTS = 512
#: Groups whose boundaries are broadcast; those of more are joined by hash.
GROUPS = 10_000


def few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(GROUPS + 1).count() <= GROUPS else df


def exact_median(rows: DataFrame, by: list[str], value: str, parts: int = PARTS) -> DataFrame:
    """(by, median): the middle value of each group, the mean of the two middle ones of an even number, as ``percentile(value, 0.5)``.

    Values are counted between approximate quantiles; the counts tell between which two boundaries the middle ranks lie, and only
    what lies there is ranked. A stretch of one value needs no ranking, so ties of any number are no single task. Nulls are passed over."""
    x = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    cuts = x.groupBy(*by).agg(F.array_distinct(F.percentile_approx("_v", [i / parts for i in range(1, parts)], 20 * parts)).alias("_cuts"))
    named = cuts.withColumnsRenamed({c: f"_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    # a value that is a boundary is a stretch of its own
    at = F.size(F.filter("_cuts", lambda b: b < F.col("_v"))) * 2 + F.array_contains("_cuts", F.col("_v")).cast("int")
    placed = x.join(few(named), same).select(*by, "_v", at.alias("_part"))
    counts = placed.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))  # 2 * parts rows of a group
    whole = Window.partitionBy(*by)
    upto = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"_all": F.sum("_n").over(whole), "_upto": upto}).withColumn("_before", F.col("_upto") - F.col("_n"))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1  # the middle ranks, equal where the number is odd
    wanted = ranked.withColumns({"_low": low, "_high": high}).filter((F.col("_before") < F.col("_high")) & (F.col("_low") <= F.col("_upto")))
    flat = wanted.filter("_lo = _hi").select(*by, F.explode(F.filter(F.array("_low", "_high"), lambda r: (r > F.col("_before")) & (r <= F.col("_upto")))), F.col("_lo").alias("_v")).select(*by, "_v")
    open_ = wanted.filter("_lo < _hi").select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_part").alias("_p"), "_before", "_low", "_high")
    rank = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_v")) + F.col("_before")
    some = placed.join(few(open_), [*same, F.col("_part") == F.col("_p")]).withColumn("_rank", rank)
    picked = some.select(*by, "_v", F.explode(F.filter(F.array("_low", "_high"), lambda r: r == F.col("_rank")))).select(*by, "_v")
    return flat.unionByName(picked).groupBy(*by).agg(F.avg("_v").alias("median"))
