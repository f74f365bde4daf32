"""Exact filtered vector search over search records, by partitions of municipality and year."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of question vectors up to which they are sent to the tasks; more are dealt to the partitions that they ask.
QUESTION_BYTES = 64_000_000
#: Filters of questions that a scan lists one by one; more are drawn together to one period for each municipality.
FILTERS = 128
#: Records that one task of the dealt search holds; questions that are multiplied at once.
SLICE, BLOCK = 16_384, 512
PARTS = 100_000  # partitions whose list is broadcast
EVERYWHERE = ("", "toutes", "toute", "all", "tous")
FIRST, LAST = -(1 << 31), (1 << 31) - 1


def unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """Rows of length 1; vectors of another width or of length 0 become zeros."""
    flat, n = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), width))
    if (n == width).all():
        out = flat.reshape(len(n), width).astype(float)
    elif (n == width).any():
        out[n == width] = flat[np.repeat(n == width, n)].reshape(-1, width)
    return out / np.maximum(np.sqrt((out * out).sum(axis=1)), 1e-300)[:, None]


def _asked(questions: DataFrame) -> DataFrame:
    """(question, v, lo, hi, c): periods without open ends, a municipality or null for all."""
    c = F.lower(F.trim("q_commune"))
    v = F.coalesce(F.col("q_vector").cast("array<double>"), F.array().cast("array<double>"))
    return questions.select("question", v.alias("v"), F.coalesce(F.col("lo").cast("int"), F.lit(FIRST)).alias("lo"), F.coalesce(F.col("hi").cast("int"), F.lit(LAST)).alias("hi"), F.when(~c.isin(*EVERYWHERE), c).alias("c"))


def asked_partitions(questions: DataFrame) -> Column:
    """A condition on ``commune`` and ``year`` that all records asked for meet; over a partitioned table it prunes the scan."""
    kinds = _asked(questions).select("c", "lo", "hi").distinct()
    found = kinds.limit(FILTERS + 1).collect()
    if len(found) > FILTERS:
        found = kinds.groupBy("c").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).limit(FILTERS + 1).collect()
    if len(found) > FILTERS:
        return F.lit(True)
    out = F.lit(False)
    for f in found:
        of = F.lit(True) if f.c is None else F.col("commune") == f.c
        if (f.lo, f.hi) != (FIRST, LAST):
            years = F.col("year").between(f.lo, f.hi)
            of = of & (years | F.col("year").isNull() if f.lo <= 0 <= f.hi else years)
        out = out | of
    return out


def _records(chunks: DataFrame) -> DataFrame:
    return chunks.filter("id is not null and vector is not null").select("id", F.coalesce(F.col("year").cast("int"), F.lit(0)).alias("year"), "commune", F.col("vector").cast("array<double>").alias("v"))


def _sent(asked: DataFrame, rows: DataFrame, k: int, width: int) -> DataFrame:
    """The questions go to every task; a batch of records meets only those that ask its municipality and year."""
    spark = rows.sparkSession
    part = asked.toArrow()  # QUESTION_BYTES at most
    told = spark.sparkContext.broadcast((part["question"].combine_chunks(), unit_rows(part["v"].combine_chunks(), width), part["lo"].to_numpy(), part["hi"].to_numpy(), np.array(part["c"].to_pylist(), object)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions, vectors, lo, hi, commune = told.value
        best = np.full((len(vectors), k), -np.inf)  # of what this task has seen
        for batch in batches:
            where, year = batch["commune"].to_pylist(), batch["year"].to_numpy()
            for c, y in set(zip(where, year.tolist())):
                rows_of = np.flatnonzero((year == y) & np.fromiter((w == c for w in where), bool, len(where)))
                who = np.flatnonzero((lo <= y) & (y <= hi) & (np.equal(commune, None) | (commune == c)))
                x = unit_rows(batch["v"].take(pa.array(rows_of)), width) if len(who) else None
                for q in (who[i : i + BLOCK] for i in range(0, len(who), BLOCK)):
                    s = vectors[q] @ x.T
                    i, j = np.nonzero(s >= best[q, -1][:, None] - 1e-9)
                    if not len(i):
                        continue
                    rows_hit = np.unique(i)
                    best[q[rows_hit]] = -np.sort(-np.concatenate([best[q[rows_hit]], s[rows_hit]], axis=1), axis=1)[:, :k]
                    keep = s[i, j] >= best[q[i], -1] - 1e-9  # ties with the last one too
                    i, j = i[keep], j[keep]
                    yield pa.RecordBatch.from_arrays([questions.take(pa.array(q[i])), batch["id"].take(pa.array(rows_of[j])), pa.array(s[i, j])], ["question", "id", "s"])

    kinds = dict(rows.dtypes) | dict(asked.dtypes)
    return rows.mapInArrow(run, f"question {kinds['question']}, id {kinds['id']}, s double")


def _dealt(asked: DataFrame, rows: DataFrame, k: int, width: int) -> DataFrame:
    """Questions and records meet by municipality, year and slice: a task holds a slice of records and reads the questions."""
    kinds = dict(rows.dtypes) | dict(asked.dtypes)
    parts = rows.groupBy("commune", "year").agg(F.ceil(F.count("*") / SLICE).alias("slices"))
    parts = F.broadcast(parts) if parts.limit(PARTS + 1).count() <= PARTS else parts
    home = rows.join(parts.withColumnsRenamed({"commune": "_c", "year": "_y"}), F.col("commune").eqNullSafe(F.col("_c")) & (F.col("year") == F.col("_y"))).withColumn("slice", F.pmod(F.xxhash64("id"), "slices")).drop("_c", "_y", "slices")
    named = asked.filter("c is not null").join(parts, (F.col("commune") == F.col("c")) & F.col("year").between(F.col("lo"), F.col("hi")))
    # those of all municipalities: a question has a row for each year that it asks, of the years that there are
    years = F.array(*(F.lit(r.year) for r in parts.select("year").distinct().orderBy("year").collect())).cast("array<int>")  # a row for each year
    spread = asked.filter("c is null").withColumn("year", F.explode(F.filter(years, lambda y: y.between(F.col("lo"), F.col("hi")))))
    told = named.unionByName(spread.join(parts, "year")).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    place = ["commune", "year", "slice"]
    both = home.select(*place, F.lit(0).alias("step"), "v", "id", none("question")).unionByName(told.select(*place, F.lit(1).alias("step"), "v", none("id"), "question"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, names, x = None, [], [], None
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in (*place, "step"))))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                run_of = b.slice(at, end - at)
                if keys[at][:3] != now:
                    now, held, names, x = keys[at][:3], [], [], None
                if keys[at][3] == 0:
                    held.append(unit_rows(run_of["v"], width))
                    names.append(run_of["id"])
                elif held:
                    if x is None:
                        x, ids = np.concatenate(held), pa.concat_arrays(names)
                    for i in range(0, run_of.num_rows, BLOCK):
                        q = run_of.slice(i, BLOCK)
                        s = unit_rows(q["v"], width) @ x.T
                        bar = np.partition(s, -k, axis=1)[:, -k] - 1e-9 if s.shape[1] > k else np.full(len(s), -np.inf)
                        a, c = np.nonzero(s >= bar[:, None])
                        yield pa.RecordBatch.from_arrays([q["question"].take(pa.array(a)), ids.take(pa.array(c)), pa.array(s[a, c])], ["question", "id", "s"])
                at = end

    return both.repartition(*place).sortWithinPartitions(*place, "step").mapInArrow(run, f"question {kinds['question']}, id {kinds['id']}, s double")


def vector_search(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(question, id, score, rank) of the k most similar records whose year lies in the question's and whose commune is the
    question's; a null side admits all, as does a commune that is null or a word for all. Ids of both may be numbers or texts.

    questions: question, q_vector, lo, hi, q_commune. chunks: id, vector, commune, year; a null year counts as 0, records
    without id or vector take no part, vectors of another width or of zeros have a score of 0. Scores equal to 10 digits are
    ties, which go to smaller ids; scores are given with 6 digits.

    Filters come before scores: over a table written by commune and year only the partitions asked for are read, and a record is
    multiplied with no question that its partition is not asked by. Questions of up to QUESTION_BYTES are sent to the tasks
    and no record moves; more are dealt, with the records, to the partitions that they ask. The broadcast goes with the plan."""
    asked = _asked(questions)
    n, width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    rows = _records(chunks.filter(asked_partitions(questions)))
    hits = (_sent if (n or 0) * 8 * max(1, width or 1) <= QUESTION_BYTES else _dealt)(asked, rows, k, width or 1)
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc(F.round("s", 10)), "id"))
    return hits.withColumn("rank", place).filter(F.col("rank") <= k).select("question", "id", F.round("s", 6).alias("score"), "rank")
