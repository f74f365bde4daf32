"""Deduplication, merging and auditing of agenda points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Parts that rows are dealt into by key before they are counted: a task of the scan would hold nearly as many groups as rows. Not the
#: session's own number (200), at which Spark counts within the joins before and merges their parts into few.
PARTS = 192


def holds(df: DataFrame, column: str) -> Column:
    """Whether the column holds something: null, 0, false, empty texts and empty lists don't."""
    kind, c = dict(df.dtypes)[column], F.col(column)
    if kind == "boolean":
        there = c
    elif kind.startswith(("struct", "date", "timestamp")):
        there = c.isNotNull()
    else:
        there = F.size(c) > 0 if kind.startswith("array") else c != ("" if kind == "string" else 0)
    return F.coalesce(there, F.lit(False))


def filled(df: DataFrame, columns: list[str]) -> Column:
    """How many of the columns hold something."""
    return sum((holds(df, c).cast("int") for c in columns), F.lit(0))


def dedup_best_filled(points: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row for each key, that with the most fields filled, the first by ``order`` on ties; null sp goes."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_score"), *order))
    return points.filter(F.col(keys[-1]).isNotNull()).withColumn("_score", filled(points, columns)).withColumn("_place", place).filter("_place = 1").drop("_score", "_place")


def upsert_points(current: DataFrame, new: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """New keys are appended; a known key's row is replaced only by one with strictly more fields filled.

    The best of the new rows need not be told first: it is the best of all rows, or a current one is. Rows are dealt by key before
    they are put in order, so that no task orders a whole split of the input."""
    both = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return dedup_best_filled(both.repartition(*keys), keys, ["_new", *order], columns).drop("_new")


def replace_by_key(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` and the rows of ``current`` whose key it lacks; doing it twice changes nothing."""
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def audit_completeness(points: DataFrame, expected: DataFrame) -> DataFrame:
    """Per meeting: expected and extracted numbers, the missing and extra ones, the pages that announce the missing ones, and
    status: ok, incomplete, or file_not_found where nothing is expected as no file was read. expected: meeting, sp, page."""
    have = points.filter("sp is not null").select("meeting", "sp").distinct().withColumn("have", F.lit(True))
    want = expected.groupBy("meeting", "sp").agg(F.min("page").alias("page"), F.lit(True).alias("want"))
    x = have.join(want, ["meeting", "sp"], "full")
    some = lambda c, v: F.sort_array(F.collect_set(F.when(c, F.col(v))))
    lacks = F.col("have").isNull()
    x = x.groupBy("meeting").agg(
        F.count("want").alias("expected"), F.count("have").alias("extracted"), some(lacks, "sp").alias("missing"), some(F.col("want").isNull(), "sp").alias("extra"), some(lacks, "page").alias("missing_pages")
    )
    status = F.when(F.col("expected") == 0, "file_not_found").when(F.size("missing") > 0, "incomplete").otherwise("ok")
    return x.withColumn("ok", F.size("missing") == 0).withColumn("status", status)


def completeness_report(audit: DataFrame) -> DataFrame:
    return audit.agg(F.sum("expected").alias("expected"), F.sum("extracted").alias("extracted"), F.count_if(~F.col("ok")).alias("incomplete"))


def incomplete_meetings(audit: DataFrame) -> DataFrame:
    """The meetings that lack numbers, those that lack most first."""
    return audit.filter(~F.col("ok")).select("meeting", "expected", "extracted", "missing").orderBy(F.desc(F.size("missing")), "meeting")


def upsert_meetings(current: DataFrame, new: DataFrame, fields: list[str], default_commune: str, order: list[str]) -> DataFrame:
    """(commune, date, fields): the current meetings, their empty fields filled by new ones of the same key, and the new keys.

    New meetings without a date are passed over; current ones stay as they are. A missing commune is the default. Of several
    new meetings of a key the first by ``order`` that holds something in a field fills it."""
    named = lambda df: df.withColumn("commune", F.lower(F.coalesce(F.nullif(F.trim("commune"), F.lit("")), F.lit(default_commune))))
    first = lambda c: F.min_by(c, F.when(holds(new, c), F.struct(*order))).alias(f"_{c}")
    n = named(new).filter("date is not null").groupBy("commune", "date").agg(*map(first, fields))
    now = named(current).select("commune", "date", *fields)
    x = now.filter("date is not null").join(n, ["commune", "date"], "full")
    merged = x.select("commune", "date", *(F.coalesce(F.when(holds(now, c), F.col(c)), f"_{c}", c).alias(c) for c in fields))
    return merged.unionByName(now.filter("date is null"))


def replace_sessions(current: DataFrame, new: DataFrame) -> DataFrame:
    """Filmed sessions, the new ones in place of those with their video_id, newest first."""
    return replace_by_key(current, new, "video_id").orderBy(F.desc_nulls_last("date"), "video_id")


def preview_merge(new: DataFrame, current: DataFrame) -> DataFrame:
    dealt = lambda df: df.select("meeting").repartition(PARTS, "meeting").groupBy("meeting")
    n = dealt(new).agg(F.count("*").alias("n_points"))
    c = dealt(current).agg(F.count("*").alias("have"))
    return n.join(c, "meeting", "left").select("meeting", "n_points", F.col("have").isNull().alias("is_new"), F.coalesce("have", F.lit(0)).alias("existing_points"))


def validate_points(points: DataFrame) -> DataFrame:
    """A row for each issue: each repeat of a number in its meeting, missing titles, amounts below 0 or over 100 million.
    A point has as many rows as it has issues."""
    untitled = F.coalesce(F.trim("titre"), F.lit("")) == ""
    suspect = (F.col("montant") < 0) | (F.col("montant") > 100_000_000)
    issues = F.filter(F.array(F.when(untitled, "untitled"), F.when(suspect, "amount")), lambda x: x.isNotNull())
    again = points.select("meeting", "sp").repartition(PARTS, "meeting", "sp").groupBy("meeting", "sp").agg(F.count("*").alias("n")).filter("n > 1")
    again = again.select("meeting", "sp", F.explode(F.expr("array_repeat('duplicate', cast(n - 1 as int))")).alias("issue"))
    return again.unionByName(points.select("meeting", "sp", F.explode(issues).alias("issue")))


def missing_meetings(calendar: DataFrame, files: DataFrame) -> DataFrame:
    return calendar.join(files.select("date").distinct(), "date", "left_anti")
