"""The index of search records as bucketed tables: new records are exchanged, the index is not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _versions(spark: SparkSession, name: str) -> list[int]:
    tables = (t.name for t in spark.catalog.listTables(pattern=f"{name.lower()}_v*"))
    return sorted(int(n) for t in tables if (n := t.rpartition("_v")[2]).isdigit())


def _write(rows: DataFrame, name: str, folder: str, version: int, buckets: int, key: str) -> None:
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", f"{folder}/v{version}").mode("overwrite").saveAsTable(f"{name}_v{version}")


def _only_once(rows: DataFrame, key: str) -> DataFrame:
    """One row of each key, the same in every run: equal keys of one load are in no order."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*rows.columns)))
    return rows.filter(F.col(key).isNotNull()).withColumn("_n", first).filter("_n = 1").drop("_n")


def index_upserts(index: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``new`` and the rows of ``index`` whose key it lacks. Where ``index`` is bucketed by the key it stays where it is."""
    return index.join(new.select(key), key, "left_anti").unionByName(new)


def open_index(spark: SparkSession, name: str) -> DataFrame:
    """The newest version of an index."""
    return spark.table(f"{name}_v{_versions(spark, name)[-1]}")


def upsert_index(spark: SparkSession, name: str, folder: str, new: DataFrame, buckets: int = 64, key: str = "id") -> int:
    """Records put into an index, in place of those of the same key; the number of its new version.

    A version is a table of its own, bucketed and sorted by the key; readers of the one before keep it until the next call. Doing it
    twice changes nothing. Rows without a key are left out. ``buckets`` counts when the index is begun, later calls keep to it."""
    done = _versions(spark, name)
    if done:
        told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}_v{done[-1]}").collect()}
        buckets = int(told["Num Buckets"])
    rows = _only_once(new.repartition(buckets, key), key)
    version = done[-1] + 1 if done else 0
    _write(index_upserts(spark.table(f"{name}_v{done[-1]}"), rows, key) if done else rows, name, folder, version, buckets, key)
    for old in done[:-1]:
        spark.sql(f"DROP TABLE {name}_v{old}")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{old}")
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    return version
