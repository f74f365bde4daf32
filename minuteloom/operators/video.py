"""Filmed sessions: chapters, captions, and what was said within each chapter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chapter_bounds(chapters: DataFrame) -> DataFrame:
    return chapters.withColumn("next_start", F.lead("start_s").over(Window.partitionBy("video_id").orderBy("start_s", "chapter")))


def align_transcript(chapters: DataFrame, segments: DataFrame, width_s: float = 1800.0) -> DataFrame:
    """Each segment with the chapter that is on at its time; those before the first chapter go, as does what has no time. At equal
    times chapters come first, and of equal starts the last chapter has the text.

    A union and one sort, no range join. A video is cut into stretches of ``width_s`` seconds, so that a long one is no single
    task; the chapter that is on where a stretch ends is carried to the next ones, one row for each stretch."""
    c = chapters.select("video_id", F.col("start_s").alias("t"), F.lit(0).alias("kind"), F.col("chapter").alias("id"), F.struct("chapter", "start_s").alias("on"))
    s = segments.select("video_id", "t", F.lit(1).alias("kind"), F.col("segment").alias("id"), F.lit(None).cast(c.schema["on"].dataType).alias("on"))
    x = c.unionByName(s).filter("t is not null")
    t = F.col("t").cast("timestamp") if dict(x.dtypes)["t"].startswith("timestamp") else F.col("t")
    x = x.withColumn("at", F.floor(t.cast("double") / width_s))
    last = F.max_by("on", F.when(F.col("kind") == 0, F.struct("t", "id")))
    before = F.last("end", ignorenulls=True).over(Window.partitionBy("video_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    carried = x.groupBy("video_id", "at").agg(last.alias("end")).select("video_id", "at", before.alias("carried"))
    on = F.last("on", ignorenulls=True).over(Window.partitionBy("video_id", "at").orderBy("t", "kind", "id").rowsBetween(Window.unboundedPreceding, 0))
    found = x.withColumn("on", on).filter("kind = 1").join(carried, ["video_id", "at"], "left").withColumn("on", F.coalesce("on", "carried"))
    return found.filter("on is not null").select("video_id", F.col("id").alias("segment"), "t", "on.chapter", F.col("on.start_s").alias("chapter_start"))


def dedup_captions(segments: DataFrame) -> DataFrame:
    """The first of equal texts of a video, in the order of the file."""
    return segments.withColumn("_p", F.row_number().over(Window.partitionBy("video_id", "text").orderBy("ord"))).filter("_p = 1").drop("_p")


def pack_segments(segments: DataFrame, max_chars: int = 1500) -> DataFrame:
    """(chapter, part, start_s, text): consecutive segments of a chapter in parts of about ``max_chars``; a segment is never
    split. Equal ``ord`` go by start and text; a null text is empty.

    Sorted partitions are read in batches, and what goes on from one batch to the next is the part that is open, so that
    a chapter of any length takes the memory of one part."""
    kind = dict(segments.dtypes)
    x = segments.select("chapter", "ord", "start_s", F.coalesce("text", F.lit("")).alias("text")).repartition("chapter").sortWithinPartitions("chapter", "ord", "start_s", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chapter, part, held, start, texts = None, -1, 0, None, []

        for b in batches:
            shape = pa.schema([b.schema.field("chapter"), ("part", pa.int32()), b.schema.field("start_s"), ("text", pa.string())])
            done = []
            for c, s, t in zip(*(b.column(n).to_pylist() for n in ("chapter", "start_s", "text"))):
                if texts and (c != chapter or held + len(t) + 1 > max_chars):
                    done.append((chapter, part, start, " ".join(texts)))
                    texts = []
                if part < 0 or c != chapter:
                    chapter, part, held, start = c, 0, 0, s
                elif not texts:
                    part, held, start = part + 1, 0, s
                texts.append(t)
                held += len(t) + 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*done), shape)], schema=shape)
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((chapter, part, start, " ".join(texts)), shape)], schema=shape)

    return x.mapInArrow(run, f"chapter {kind['chapter']}, part int, start_s {kind['start_s']}, text string")


def chapter_excerpts(aligned: DataFrame, most: int = 1200) -> DataFrame:
    """The first ``most`` characters said in a chapter, by time; only segments that begin before the cut are gathered."""
    before = F.sum(F.coalesce(F.length("text") + 1, F.lit(0))).over(Window.partitionBy("video_id", "chapter").orderBy("t", "segment").rowsBetween(Window.unboundedPreceding, -1))
    head = aligned.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") <= most)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t", "segment", "text"))), lambda s: s["text"]), " ")
    return head.groupBy("video_id", "chapter").agg(F.substring(text, 1, most).alias("excerpt"))


def title_similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds similarity, the Ratcliff-Obershelp ratio of two titles; null titles count as empty."""

    @F.pandas_udf("double")
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from difflib import SequenceMatcher

        for x, y in batches:
            yield pd.Series([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y)], dtype="float64")

    return pairs.withColumn("similarity", ratio(a, b))
