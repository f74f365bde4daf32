"""Registered queries over what the library itself writes: partitioned tables, nested files, an ingested table; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from minuteloom.operators import index, retrieval, search, selection
from minuteloom.plans import adapters as A
from minuteloom.plans.registry import COLUMNS, ORDER, SCORE, P, points, query, view
from minuteloom.sources import files
from minuteloom.streaming.ingest import ingest_stream, latest


# --- partitioned tables
@query(f"WITH c AS ({A.CHUNKS}) SELECT id, commune, year, CASE WHEN year = 2003 THEN 'rewritten' ELSE 'first' END AS written FROM c WHERE year IN (2003, 2005)")
def io5_p5_partitioned_years(spark, sf_dir):
    """Records written by municipality and year, one year of them rewritten, two years read again."""
    x = view(spark, sf_dir, A.CHUNKS).select("id", "commune", F.col("year").cast("int").alias("year"), F.lit("first").alias("written"))
    folder = files.scratch_folder(spark, "chunks")
    files.write_chunks(x, folder)
    files.write_chunks(selection.filter_years(x, [2003]).withColumn("written", F.lit("rewritten")), folder)
    return selection.filter_years(files.read_table(spark, folder, x.schema), [2003, 2005])


RECORD = "SELECT vec_id, embedding AS vector, 2000 + label AS y, CASE WHEN label % 2 = 0 THEN 'north' ELSE 'south' END AS commune FROM embeddings"
FOUND = f"""WITH e AS ({RECORD}), c AS (SELECT *, concat('PV-', y, '-', vec_id // 40, '_SP', vec_id % 40) AS id, y AS year FROM e), q AS (SELECT c.id AS question, q.q_vector, lo, hi, q_commune FROM ({A.ASKED}) q JOIN c ON c.vec_id = q.question),
  s AS (SELECT question, id, list_cosine_similarity(vector::DOUBLE[], q_vector::DOUBLE[]) AS exact FROM c JOIN q ON coalesce(lo, 0) <= year AND coalesce(hi, 9999) >= year AND (q_commune IS NULL OR q_commune = commune))"""


@query(FOUND + " SELECT question, id, round(exact, 6) AS score, row_number() OVER (PARTITION BY question ORDER BY round(exact, 10) DESC, id)::INTEGER AS rank FROM s QUALIFY rank <= 10")
def j12_search_of_records(spark, sf_dir):
    """The library's own search records, written by municipality and year, searched by the partitions that each question asks."""
    e = view(spark, sf_dir, RECORD)
    none = {c: F.lit("") for c in ("resume", "rubrique", "sous_rubrique", "decision", "type", "vote_type", "vote", "repondant")}
    meeting = F.concat(F.lit("PV-"), F.col("y").cast("string"), F.lit("-"), F.floor(F.col("vec_id") / 40).cast("string"))
    p = e.withColumns(none | {"meeting_id": meeting, "sp": F.col("vec_id") % 40, "date": F.make_date("y", F.lit(1), F.lit(29)), "titre": F.concat(F.lit("Point "), F.col("vec_id").cast("string")), "montant": F.lit(0), "intervenants": F.array().cast("array<string>"), "tags": F.array().cast("array<string>")})
    keyed = p.select(F.concat("meeting_id", F.lit("_SP"), F.col("sp").cast("string")).alias("id"), "vector", "vec_id")
    records = retrieval.point_chunks(p).join(keyed, "id").drop("vec_id")
    folder = files.scratch_folder(spark, "records")
    files.write_chunks(records, folder)
    q = view(spark, sf_dir, A.ASKED).join(keyed.select("id", "vec_id"), F.col("question") == F.col("vec_id")).drop("question", "vec_id").withColumnRenamed("id", "question")
    return search.vector_search(q, files.read_table(spark, folder, records.schema), 10)


# --- nested files
#: Meetings of one file; so many files as the table has thousands of keys.
OF_A_FILE = 4000


@query(P + f"""SELECT 'point' AS kind, meeting // {OF_A_FILE} AS file, meeting::VARCHAR AS id, sp::VARCHAR AS sp, titre FROM points WHERE meeting // {OF_A_FILE} % 7 NOT IN (3, 5)
  UNION ALL SELECT DISTINCT CASE meeting // {OF_A_FILE} % 7 WHEN 3 THEN 'malformed' ELSE 'unexpected shape' END, meeting // {OF_A_FILE}, NULL, NULL, NULL FROM points WHERE meeting // {OF_A_FILE} % 7 IN (3, 5)""")
def io1_read_minutes(spark, sf_dir):
    """Points written as nested minutes, some files cut or of another shape, and read again with what is put aside."""
    x = points(spark, sf_dir).withColumn("file", F.floor(F.col("meeting") / OF_A_FILE))
    text = lambda c: F.col(c).cast("string").alias(c)
    m = x.groupBy("file", "meeting").agg(F.collect_list(F.struct(text("sp"), "titre", "decision", "type")).alias("points"))
    doc = m.groupBy("file").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("meeting").cast("string").alias("id"), "points")).alias("seances"))).alias("value"))
    broken = F.when(F.col("file") % 7 == 3, F.substring("value", F.lit(1), (F.length("value") / 2).cast("int"))).when(F.col("file") % 7 == 5, F.lit('{"other": 1}')).otherwise(F.col("value"))
    folder = files.scratch_folder(spark, "minutes")
    doc.withColumn("value", broken).write.partitionBy("file").text(folder)
    rows, rejects = files.read_minutes_checked(spark, folder)
    flat = rows.select("id", F.explode("points").alias("p")).select(F.lit("point").alias("kind"), F.floor(F.col("id").cast("long") / OF_A_FILE).alias("file"), "id", "p.sp", "p.titre")
    none = F.lit(None).cast("string")
    return flat.unionByName(rejects.select(F.col("reason").alias("kind"), F.regexp_extract("file", r"file=(\d+)", 1).cast("long").alias("file"), none.alias("id"), none.alias("sp"), none.alias("titre")))


@query("SELECT user_id::VARCHAR AS video_id, CAST(min(event_id) AS VARCHAR) AS first, count(*) AS chapters FROM events WHERE event_type = 'purchase' GROUP BY 1")
def io2_read_video_sessions(spark, sf_dir):
    """Filmed sessions written as files of both forms and read again."""
    x = view(spark, sf_dir, A.CHAPTERS).groupBy("video_id").agg(F.collect_list(F.struct(F.col("chapter").cast("string").alias("titre"))).alias("points"))
    one = F.struct(F.col("video_id").cast("string").alias("video_id"), "points")
    all_ = x.groupBy(F.floor(F.col("video_id") / 20).alias("file")).agg(F.collect_list(one).alias("seances"))
    folder = files.scratch_folder(spark, "films")
    all_.select("file", F.when(F.col("file") % 2 == 0, F.to_json(F.struct("seances"))).otherwise(F.to_json("seances")).alias("value")).write.partitionBy("file").text(folder)
    return files.read_video_sessions(spark, folder).select("video_id", F.array_min(F.transform("points", lambda p: p["titre"].cast("long"))).cast("string").alias("first"), F.size("points").cast("long").alias("chapters"))


# --- ingestion
@query(P + f"SELECT meeting, sp, partkey, suppkey FROM points QUALIFY row_number() OVER (PARTITION BY meeting, sp ORDER BY {SCORE} DESC, partkey % 2, partkey, suppkey, montant, titre, shipped) = 1")
def st1_ingest_stream(spark, sf_dir):
    """Points that come in as two batches of files, each merged into the partitions that it touches; a third run finds nothing new."""
    x = points(spark, sf_dir).select("meeting", "sp", "commune", F.year("date").alias("year"), *dict.fromkeys([*ORDER, *COLUMNS]))
    folder = files.scratch_folder(spark, "ingest")
    for part in (0, 1, None):
        if part is not None:
            x.filter(F.col("partkey") % 2 == part).write.mode("append").parquet(f"{folder}/in")
        ingest_stream(spark, f"{folder}/in", f"{folder}/table", f"{folder}/progress", x.schema, ["meeting", "sp"], ORDER, COLUMNS)
    return latest(spark, f"{folder}/table", x.schema).select("meeting", "sp", "partkey", "suppkey")


# --- the index
@query(f"WITH c AS ({A.CHUNKS}) SELECT id, CASE WHEN id % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM c UNION ALL SELECT -id - 1, 'new' FROM c WHERE id % 3 = 0")
def s6_upsert_index(spark, sf_dir):
    """Records put into a bucketed index in two steps, the second one twice."""
    x = view(spark, sf_dir, A.CHUNKS).select("id")
    new = x.filter("id % 3 = 0").withColumn("v", F.lit("new"))
    folder = files.scratch_folder(spark, "index")
    name = folder.rpartition("/")[2].replace("-", "_")
    index.upsert_index(spark, name, folder, x.withColumn("v", F.lit("old")), 8)
    for _ in range(2):
        index.upsert_index(spark, name, folder, new.unionByName(new.withColumn("id", -F.col("id") - 1)))
    return index.open_index(spark, name)
