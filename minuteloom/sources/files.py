"""Reading and writing of minutes, sessions, captions and tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

POINT = "struct<sp:string,page:string,urgence:string,type:string,rubrique:string,titre:string,resume:string,intervenants:array<string>,repondant:string,decision:string,vote:struct<type:string,pour:string,contre:string,abstentions:string>,montant_eur:string,thematiques:array<string>>"
MEETING = f"struct<id:string,date:string,commune:string,source_file:string,points:array<{POINT}>>"
CHAPTER = "struct<titre:string,type:string,auteur:string,start_s:int,deeplink:string,transcript:array<struct<start_s:int,text:string>>>"
SESSION = f"struct<date:string,video_id:string,video_url:string,titre_video:string,duree_s:int,points:array<{CHAPTER}>>"


def _parsed(spark: SparkSession, path: str, schema: str, fits: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """What JSON files hold under a schema, and the records that don't fit: (file, reason, text).

    A record that doesn't parse, or has a value of another type, is told with its text; so is one whose shape does not ``fit``, and a file
    without any record. A record is taken whole or not at all."""
    read = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path, multiLine=True)
    told = read.withColumn("_file", F.col("_metadata.file_path"))
    reason = F.when(F.col("_broken").isNotNull(), "malformed").when(~F.coalesce(F.expr(fits), F.lit(False)), "unexpected shape")
    told = told.withColumn("_reason", reason)
    text = F.coalesce("_broken", F.to_json(F.struct(*columns)))
    rejects = told.filter("_reason is not null").select(F.col("_file").alias("file"), F.col("_reason").alias("reason"), text.alias("text"))
    # names as the driver's listing has them: scans pass over files of no bytes
    there = spark.createDataFrame([(f,) for f in read.inputFiles()], "file string")
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/").alias("name")
    empty = there.withColumn("name", plain("file")).join(told.select(plain("_file")).distinct(), "name", "left_anti")
    return told.filter("_reason is null"), rejects.unionByName(empty.select("file", F.lit("empty").alias("reason"), F.lit("").alias("text")))


def _strict(read: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The rows; a run over them fails where a file has been put aside."""
    rows, rejects = read
    worst = rejects.groupBy().agg(F.min(F.concat("reason", F.lit(": "), "file")).alias("worst")).first().worst  # one row
    if worst is not None:
        raise ValueError(f"cannot read {worst}")
    return rows


def read_minutes(spark: SparkSession, path: str) -> DataFrame:
    """One row per meeting of nested minutes files; ValueError if one of the files is broken, with its name."""
    return _strict(read_minutes_checked(spark, path))


def read_minutes_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(one row per meeting, what is put aside: file, reason, text). A file holds {seances: [...]}; broken ones lose no other."""
    rows, rejects = _parsed(spark, path, f"seances array<{MEETING}>", "seances is not null", ["seances"])
    return rows.select(F.explode("seances").alias("m")).select("m.*"), rejects


def read_video_sessions(spark: SparkSession, path: str) -> DataFrame:
    """One row per filmed session; ValueError if one of the files is broken, with its name."""
    return _strict(read_video_sessions_checked(spark, path))


def read_video_sessions_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(one row per filmed session, what is put aside); a file holds either {seances: [...]} or a bare list of sessions. Something
    that has neither a list of sessions nor a video_id, date or points is put aside."""
    parts = [p.split(":", 1) for p in _top(SESSION[len("struct<") : -1])]
    names = [n for n, _ in parts]
    rows, rejects = _parsed(spark, path, f"seances array<{SESSION}>, " + ", ".join(f"{n} {t}" for n, t in parts), "seances is not null or coalesce(video_id, date) is not null or points is not null", ["seances", *names])
    return rows.select(F.explode(F.coalesce("seances", F.array(F.struct(*names)))).alias("s")).select("s.*"), rejects


def _top(fields: str) -> list[str]:
    """The fields of a struct's text, split at commas outside of brackets."""
    out, depth, held = [], 0, ""
    for c in fields:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(held)
            held = ""
        else:
            held += c
    return [*out, held]


def parse_reply_json(raw: Column, schema: str) -> Column:
    """The object between the first { and the last } of a model's reply; null if it doesn't parse."""
    plain = F.regexp_replace(raw, r"```(?:json)?", "")
    last = lambda s: F.length(s) - F.length(F.substring_index(s, "}", -1))
    body = F.get(F.transform(F.array(plain), lambda s: F.when(last(s) > F.instr(s, "{"), F.substr(s, F.instr(s, "{"), last(s) - F.instr(s, "{") + 1))), F.lit(0))
    return F.from_json(F.when(F.contains(raw, F.lit("{")), body), schema)


def parse_vtt(files: DataFrame, text: str = "content") -> DataFrame:
    """(video_id, ord, start_s, text) of caption files: blocks between blank lines, timing line, text without tags."""
    x = files.select("video_id", F.posexplode(F.split(F.regexp_replace(text, "\r", ""), r"\n\n+")).alias("ord", "block"))
    p = r"(?:(\d+):)?(\d{2}):(\d{2}(?:\.\d+)?)\s+-->"
    part = lambda g: F.coalesce(F.nullif(F.regexp_extract("block", p, g), F.lit("")).cast("double"), F.lit(0.0))
    after = F.regexp_replace(F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)$", 1), r"<[^>]+>", "")
    said = F.array_join(F.filter(F.transform(F.split(after, "\n"), F.trim), lambda s: s != ""), " ")
    return x.filter(F.col("block").rlike(p)).select("video_id", "ord", (part(1) * 3600 + part(2) * 60 + part(3)).alias("start_s"), said.alias("text")).filter("text != ''")


def reply_points(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """(all columns but ``raw``, date_seance, point columns): the points of models' replies; replies without the shape go."""
    others = [c for c in replies.columns if c != raw]
    # a list of one: a reply is parsed once, not again for each filter and field that looks at it
    x = replies.select(*others, F.inline(F.array(parse_reply_json(F.col(raw), f"date_seance string, points array<{POINT}>"))).alias("date_seance", "_points"))
    return x.filter("_points is not null").select(*others, "date_seance", F.explode("_points").alias("_p")).select(*others, "date_seance", "_p.*")


def flat_points(points: DataFrame) -> DataFrame:
    """The 19 columns of a spreadsheet: titles cut at 200 characters and summaries at 300, lists joined, the meeting's file
    where a point names none. points: date, meeting_file, the fields of a point and vote, a struct; nulls stay empty."""
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n).alias(c)
    return points.select(
        "date", "sp", "page", F.coalesce(F.nullif(F.col("source_file"), F.lit("")), "meeting_file").alias("source_file"), "type", "rubrique", "sous_rubrique", cut("titre", 200), cut("resume", 300), "decision",
        F.col("vote.type").alias("vote_type"), F.col("vote.pour").alias("vote_pour"), F.col("vote.contre").alias("vote_contre"), F.col("vote.abstentions").alias("vote_abstentions"), "montant_eur", "urgence",
        F.array_join(F.coalesce("intervenants", F.array().cast("array<string>")), "; ").alias("intervenants"), "repondant", F.array_join(F.coalesce("thematiques", F.array().cast("array<string>")), ", ").alias("thematiques"),
    )


def export_points_csv(points: DataFrame, path: str) -> None:
    """``flat_points`` as CSV with a header."""
    flat_points(points).write.mode("overwrite").csv(path, header=True)


def write_points(points: DataFrame, path: str) -> None:
    """A table by commune and year; only the partitions that come in are replaced."""
    _replace(points.withColumn("year", F.year("date")), path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Search records by commune and year; only the partitions that come in are replaced."""
    _replace(chunks, path)


def _replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("commune", "year").parquet(path)


def read_table(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A table by commune and year; the schema is given, so that names of municipalities that look like numbers stay texts."""
    return spark.read.schema(schema).parquet(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share; a temporary one only where a local session names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what several results need is worked out once, and outlives executors."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
