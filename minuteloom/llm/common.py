"""What the operators of this folder share: tables, the shared folder, checkpoints, samples, word splitting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = "1024"
ARROW_BYTES = str(8 << 20)
#: Values of a label up to which their shares are broadcast; beyond it the rows are joined by hash.
SHARES = 10_000
#: What a text of a sample counts besides its own bytes.
ROW_BYTES = 64


def session(df_or_spark) -> SparkSession:
    """The session, with small Arrow batches: whole texts can be long, so batches are bounded by bytes too."""
    spark = df_or_spark.sparkSession if isinstance(df_or_spark, DataFrame) else df_or_spark
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    session(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where a local session names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a cut in the lineage that outlives executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` to be broadcast in a join where it has ``most`` rows or fewer; else as it is, joined by hash."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def forget(*frames: DataFrame) -> None:
    """Remove what ``stored`` wrote, once nothing reads it any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def id_remainder(column: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % mod


def unit_hash(*columns: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that the values alone decide, alike in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def byte_bounded_sample(rows: DataFrame, by: str, text: str, key: str, max_bytes: int, seed: int = 7) -> DataFrame:
    """Of each value of ``by`` a sample of whole texts with about ``max_bytes`` bytes at most.

    A row stays if the hash of its key is under max_bytes / (bytes of that value), so the sample is
    the same in every run. Rows with a null text or null ``by`` take no part."""
    rows = rows.filter(F.col(text).isNotNull() & F.col(by).isNotNull())
    share = rows.groupBy(by).agg((F.lit(float(max_bytes)) / F.greatest(F.sum(F.octet_length(text)), F.lit(1))).alias("_share"))
    few = share.limit(SHARES + 1).count() <= SHARES
    return rows.join(F.broadcast(share) if few else share, by).filter(unit_hash(key, text, seed=seed) < F.col("_share")).drop("_share")


def marked(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, y): the distinct labels 0 and 1 of ids whose crc32 mod 5 is not 0."""
    y = F.col(label_col).cast("int")
    return labels.filter(id_remainder(id_col, 5) != 0).select(F.col(id_col).alias("id"), y.alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1)).distinct()


def labelled_sample(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str, max_bytes: int, seed: int = 7) -> tuple[list[str], list[int]]:
    """Whole texts and labels of a sample of about ``max_bytes`` bytes of each label, in an order that the rows decide.

    Only ids and lengths meet the labels; each text counts ROW_BYTES more than it has, so few ids are drawn (``max_bytes`` /
    ROW_BYTES of a label, expected). Those ids go to the texts, which are never shuffled. Null texts take no part."""
    id_, text = F.col(id_col).alias("id"), F.col(text_col)
    known = docs.select(id_, (F.octet_length(text) + ROW_BYTES).alias("n")).filter("n is not null").join(marks, "id")
    total = {r.y: r.n for r in known.groupBy("y").agg(F.sum("n").alias("n")).collect()}  # two rows
    share = F.when(F.col("y") == 0, max_bytes / total.get(0, 1)).otherwise(max_bytes / total.get(1, 1))
    drawn = known.filter(unit_hash("id", seed=seed) < share).select("id", "y").distinct()
    got = docs.filter(text.isNotNull()).select(id_, text.alias("text")).join(F.broadcast(drawn), "id").select(F.xxhash64("id", "text").alias("h"), "text", "y").collect()
    got.sort()
    return [r.text for r in got], [r.y for r in got]
