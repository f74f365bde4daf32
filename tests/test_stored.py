"""Partitioned tables: search over them, files put aside, rewriting by partition, ingestion that survives a lost batch."""

import io
import json
import os
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from minuteloom.operators import search
from minuteloom.sources import files
from minuteloom.streaming import ingest

WORDS = (None, "north", "Toutes", " SOUTH ", "nowhere")


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    r = np.random.default_rng(5)
    v = r.normal(size=(400, 6)).round(3)
    v[30:40] = v[0]
    rows = [(f"PV-{2000 + i % 5}_SP{i}", x.tolist(), 2000 + i % 5, ("north", "south")[i % 2]) for i, x in enumerate(v)]
    rows += [("none", None, 2000, "north"), (None, [1.0] * 6, 2000, "north"), ("zero", [0.0] * 6, 2000, "north"), ("short", [1.0], 2001, "south"), ("undated", [0.5] * 6, None, "south"), ("placeless", [0.25] * 6, 2001, None)]
    folder = str(tmp_path_factory.mktemp("t") / "records")
    df = spark.createDataFrame(rows, "id string, vector array<double>, year int, commune string")
    files.write_chunks(df, folder)
    asked = [(f"q{i}", rows[i][1], 2001 if i % 2 else None, (2003, None)[i % 3 == 0], WORDS[i % 5]) for i in range(25)] + [("nil", None, None, None, None)]
    return files.read_table(spark, folder, df.schema), rows, spark.createDataFrame(asked, "question string, q_vector array<double>, lo int, hi int, q_commune string"), asked


def brute(rows, asked, k):
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-300) if v is not None and len(v) == 6 else np.zeros(6)
    out = set()
    for q, v, lo, hi, c in asked:
        c = (c or "").strip().lower()
        fit = [x for x in rows if x[0] and x[1] is not None and (lo is None or (x[2] or 0) >= lo) and (hi is None or (x[2] or 0) <= hi) and (c in search.EVERYWHERE or x[3] == c)]
        best = sorted((-round(float(unit(v) @ unit(x[1])), 10) + 0.0, x[0]) for x in fit)[:k]
        out |= {(q, i, rank + 1, round(-s, 6) + 0.0) for rank, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("most, filters, piece", [(64_000_000, 128, 16_384), (64_000_000, 2, 16_384), (0, 128, 16_384), (0, 0, 20)])
def test_search_over_partitions_equals_brute_force(records, monkeypatch, most, filters, piece):
    table, rows, questions, asked = records
    monkeypatch.setattr(search, "QUESTION_BYTES", most)
    monkeypatch.setattr(search, "FILTERS", filters)
    monkeypatch.setattr(search, "SLICE", piece)
    got = {(r.question, r.id, r["rank"], round(r.score, 6) + 0.0) for r in search.vector_search(questions, table, 7).collect()}
    assert got == brute(rows, asked, 7)


def test_search_reads_only_what_is_asked(spark, records):
    table, rows, _, asked = records
    one = spark.createDataFrame([("q", rows[1][1], 2002, 2003, "north")], "question string, q_vector array<double>, lo int, hi int, q_commune string")
    found = search.vector_search(one, table, 5)
    plan = plan_of(found)
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "north" in filters and "2002" in filters and "2003" in filters
    assert found.count() == 5
    assert search.vector_search(one.limit(0), table, 5).count() == 0
    assert search.vector_search(one.withColumn("lo", F.lit(2050)), table, 5).count() == 0  # no other period is taken instead


def test_one_partition_is_rewritten_others_stay(spark, tmp_path):
    df = spark.createDataFrame([(i, 2020 + i % 3, "12" if i % 2 else "b") for i in range(12)], "id int, year int, commune string")
    folder = str(tmp_path / "t")
    files.write_chunks(df, folder)
    before = {f: os.stat(f.removeprefix("file://")).st_mtime_ns for f in spark.read.parquet(folder).inputFiles()}
    files.write_chunks(df.filter("year = 2021").withColumn("id", F.col("id") + 100), folder)
    after = {f: os.stat(f.removeprefix("file://")).st_mtime_ns for f in spark.read.parquet(folder).inputFiles()}
    assert {f for f in before if "year=2021" not in f} == {f for f in after if before.get(f) == after[f]}
    x = files.read_table(spark, folder, df.schema)
    assert sorted(r.id for r in x.collect()) == sorted(i + 100 if i % 3 == 1 else i for i in range(12))
    assert {r.commune for r in x.select("commune").collect()} == {"12", "b"}
    assert "PartitionFilters: [isnotnull(year" in plan_of(x.filter("year = 2022"))


def test_broken_files_are_put_aside(spark, tmp_path):
    whole = {"seances": [{"id": "m1", "points": [{"sp": "1", "titre": "t"}]}, {"id": "m2"}]}
    bodies = {"a": json.dumps(whole), "cut": json.dumps(whole)[:30], "root": '["x"]', "object": '{"other": 1}', "type": '{"seances": "none"}', "inner": '{"seances": [{"id": "m3", "points": 7}]}', "empty": "", "blank": "\n", "none": '{"seances": []}'}
    for name, body in bodies.items():
        (tmp_path / f"{name}.json").write_text(body)
    rows, rejects = files.read_minutes_checked(spark, str(tmp_path))
    assert [r.id for r in rows.orderBy("id").collect()] == ["m1", "m2"]
    told = {os.path.basename(r.file).split(".")[0]: (r.reason, r.text) for r in rejects.collect()}
    assert told.keys() == bodies.keys() - {"a", "none"} and rejects.count() == 7
    assert told["cut"] == ("malformed", bodies["cut"]) and told["inner"][0] == "malformed" and told["object"][0] == "unexpected shape" and told["empty"][0] == told["blank"][0] == "empty"
    with pytest.raises(ValueError, match="cannot read"):
        files.read_minutes(spark, str(tmp_path))
    assert files.read_minutes(spark, str(tmp_path / "a.json")).count() == 2


def test_broken_sessions_are_put_aside(spark, tmp_path):
    bodies = {"a": '{"seances": [{"video_id": "v1"}]}', "list": '[{"video_id": "v2"}, {"date": "2024-01-02"}]', "cut": '[{"video_id": "v', "root": '{"x": 1}', "type": '[{"video_id": "v3", "points": {}}]', "mixed": '[{"video_id": "v4"}, {"odd": 1}]'}
    for name, body in bodies.items():
        (tmp_path / f"{name}.json").write_text(body)
    rows, rejects = files.read_video_sessions_checked(spark, str(tmp_path))
    assert sorted(r.video_id or "" for r in rows.collect()) == ["", "v1", "v2", "v4"]
    assert sorted(os.path.basename(r.file).split(".")[0] for r in rejects.collect()) == ["cut", "mixed", "root", "type"]
    with pytest.raises(ValueError, match="cannot read"):
        files.read_video_sessions(spark, str(tmp_path))


SCHEMA = "commune string, year int, meeting int, sp int, titre string, decision string, ord int"
ARGS = (["meeting", "sp"], ["ord"], ["titre", "decision"])


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_ingest_writes_only_touched_partitions(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    places = [str(tmp_path / x) for x in ("in", "table", "progress")]
    large = [(f"c{i % 20}", 2000 + i % 10, i, 1, f"title {i}" * 20, None, 0) for i in range(4000)]
    spark.createDataFrame(large, SCHEMA).write.mode("append").parquet(places[0])
    ingest.ingest_stream(spark, *places, schema, *ARGS)
    table = ingest.Table(spark, places[1], schema)
    first = dict(table.manifest())
    assert len(first) == 20 and table.versions() == [0]
    ingest.ingest_stream(spark, *places, schema, *ARGS)
    assert table.versions() == [0]
    new = [("c1", 2001, 1, 1, "title", "decided", 0), ("c1", 2001, 1, 2, "second", None, 1), ("c1", 2001, 21, 1, "", None, 0), (None, None, 9000, 1, "nowhere", None, 0), (None, None, 9000, None, "no number", None, 0)]
    spark.createDataFrame(new, SCHEMA).write.mode("append").parquet(places[0])
    ingest.ingest_stream(spark, *places, schema, *ARGS)
    touched = {p for p, v in table.manifest().items() if v == 1}
    assert touched == {"commune=c1/year=2001", "commune=__HIVE_DEFAULT_PARTITION__/year=__HIVE_DEFAULT_PARTITION__"} and {p: v for p, v in table.manifest().items() if v == 0} == {p: 0 for p in first if p not in touched}
    assert size_of(f"{places[1]}/data/version=1") < 0.2 * size_of(f"{places[1]}/data/version=0")
    got = {(r.meeting, r.sp): (r.titre, r.decision) for r in ingest.latest(spark, places[1], schema).collect()}
    assert len(got) == 4002 and got[1, 1] == ("title", "decided") and got[21, 1] == ("title 21" * 20, None) and got[9000, 1] == ("nowhere", None)
    assert "PartitionFilters" in plan_of(table.read().filter("commune = 'c3'"))
    spark.createDataFrame([("c1", 2001, 1, 3, "third", None, 2)], SCHEMA).write.mode("append").parquet(places[0])
    ingest.ingest_stream(spark, *places, schema, *ARGS)
    assert table.versions() == [1, 2] and os.path.exists(f"{places[1]}/data/version=1/commune=c1/year=2001") and not os.path.exists(f"{places[1]}/manifest/0")
    assert not os.path.exists(f"{places[1]}/data/version=0/commune=c1/year=2001")  # no version still named has it
    assert ingest.latest(spark, places[1], schema).count() == 4003


def test_lost_batch_is_repaired(spark, tmp_path, monkeypatch):
    schema = spark.createDataFrame([], SCHEMA).schema
    table = ingest.Table(spark, str(tmp_path / "table"), schema)
    one = spark.createDataFrame([("a", 2001, 1, 1, "x", None, 0), ("b", 2001, 2, 1, "y", None, 0)], SCHEMA)
    assert sorted(ingest.merge_batch(table, one, 0, *ARGS)) == ["commune=a/year=2001", "commune=b/year=2001"]
    two = spark.createDataFrame([("a", 2001, 1, 1, "x", "d", 0), ("a", 2002, 3, 1, "z", None, 0)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(ingest.Table, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            ingest.merge_batch(table, two, 1, *ARGS)
    assert table.versions() == [0] and {r.decision for r in table.read().collect()} == {None}  # the old version stays whole
    ingest.merge_batch(table, two, 1, *ARGS)
    want = {("a", 1, "d"), ("b", 2, None), ("a", 3, None)}
    assert {(r.commune, r.meeting, r.decision) for r in table.read().collect()} == want and table.read().count() == 3
    assert ingest.merge_batch(table, two, 1, *ARGS) == []  # run again after its end
    assert {(r.commune, r.meeting, r.decision) for r in table.read().collect()} == want
    with monkeypatch.context() as m:
        m.setattr(ingest, "TOUCHED", 1)
        with pytest.raises(ValueError, match="partitions"):
            ingest.merge_batch(table, two, 2, *ARGS)
    assert ingest.merge_batch(table, two.limit(0), 3, *ARGS) == []
