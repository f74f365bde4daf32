"""Incremental ingestion: new files of points are deduplicated and merged into a table, partition by partition.

The table is ``data/version=N/commune=C/year=Y`` beside ``manifest/N``, a list of the partitions and the version that holds each.
Batch N reads the partitions that it touches, writes them anew under its own number, and takes effect when its manifest is
renamed into place. Readers take the newest manifest, so they see a batch whole or not at all; a batch that is lost
half-way leaves files that no manifest names, and its rerun overwrites them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from minuteloom.operators.merge import upsert_points

PARTITION = ("commune", "year")
#: Partitions that one batch may touch: their list goes to the driver and into the scan's filter.
TOUCHED = 10_000


class Table:
    """The files of a table and its manifests, through the file system that its path names."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.fs = self._of(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _of(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._of(path))) if self.fs.exists(self._of(path)) else []

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names(f"{self.path}/manifest") if n.isdigit())

    def manifest(self, version: int | None = None) -> dict[str, int]:
        """Partition, as its folder is called, to the version that holds it; of the newest version, if none is given."""
        done = self.versions()
        if not done:
            return {}
        stream = self.fs.open(self._of(f"{self.path}/manifest/{done[-1] if version is None else version}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, version: int, holds: dict[str, int]) -> None:
        """The manifest comes into being by a rename, whole."""
        draft, final = self._of(f"{self.path}/manifest/.{version}"), self._of(f"{self.path}/manifest/{version}")
        out = self.fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(holds, sort_keys=True).encode()))
        finally:
            out.close()
        if not self.fs.rename(draft, final):
            raise OSError(f"cannot commit version {version} of {self.path}")

    def written(self, version: int) -> list[str]:
        """The partitions that a version has files of."""
        base = f"{self.path}/data/version={version}"
        return [f"{c}/{y}" for c in self._names(base) if "=" in c for y in self._names(f"{base}/{c}")]

    def read(self, holds: dict[str, int] | None = None) -> DataFrame:
        """The rows of the newest version, or of a manifest; filters on commune and year prune its partitions."""
        holds = self.manifest() if holds is None else holds
        if not holds:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/data/version={v}/{p}" for p, v in sorted(holds.items())]
        wide = StructType([*self.schema.fields]).add("version", "long")
        return self.spark.read.schema(wide).option("basePath", f"{self.path}/data").parquet(*paths).select(*self.schema.names)

    def forget_old(self, keep: int = 2) -> None:
        """Remove what only versions before the last ``keep`` name."""
        done = self.versions()
        kept = {(p, v) for n in done[-keep:] for p, v in self.manifest(n).items()}
        for n in done[:-keep]:
            for p, v in self.manifest(n).items():
                if (p, v) not in kept:
                    self.fs.delete(self._of(f"{self.path}/data/version={v}/{p}"), True)
            self.fs.delete(self._of(f"{self.path}/manifest/{n}"), False)


def merge_batch(table: Table, batch: DataFrame, number: int, keys: list[str], order: list[str], columns: list[str]) -> list[str]:
    """Merge one batch as version ``number``; the partitions that it wrote. A number that is committed already does nothing.

    Rows go by ``keys`` within their commune and year, which a key must decide; a null in either is a partition of its own."""
    if number in table.versions():
        return []
    earlier = table.manifest()
    batch = batch.select(*table.schema.names)
    touched = batch.select(*PARTITION).distinct().limit(TOUCHED + 1).collect()
    if len(touched) > TOUCHED:
        raise ValueError(f"a batch may touch {TOUCHED} partitions, not more: give the stream fewer files at once")
    if not touched:
        return []
    hit = F.lit(False)
    for t in touched:
        hit = hit | (F.col("commune").eqNullSafe(F.lit(t.commune)) & F.col("year").eqNullSafe(F.lit(t.year)))
    merged = upsert_points(table.read(earlier).filter(hit), batch, [*PARTITION, *keys], order, columns)
    merged.write.mode("overwrite").partitionBy(*PARTITION).parquet(f"{table.path}/data/version={number}")
    done = table.written(number)
    table.commit(number, earlier | dict.fromkeys(done, number))
    table.forget_old()
    return done


def ingest_stream(spark: SparkSession, input_dir: str, table_dir: str, checkpoint_dir: str, schema: StructType, keys: list[str], order: list[str], columns: list[str]) -> None:
    """Merge all files that are new since the last call; the checkpoint is the list of done files. ``schema`` has commune and year."""
    table = Table(spark, table_dir, schema)
    stream = spark.readStream.schema(schema).parquet(input_dir)
    merge = lambda batch, number: merge_batch(table, batch, number, keys, order, columns)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, table_dir: str, schema: StructType) -> DataFrame:
    """The newest version of the table."""
    return Table(spark, table_dir, schema).read()
