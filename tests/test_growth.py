"""What keeps the memory and shuffles of large tables down, held against plain forms of the same."""

import io
import random
from contextlib import redirect_stdout

from pyspark.sql import functions as F
from minuteloom.operators import merge, people
from minuteloom.plans import adapters as A
from minuteloom.plans import registry
from minuteloom.sources import files

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_upsert_orders_once(spark):
    r = random.Random(3)
    rows = [(r.choice([None, 1, 2, 3]), r.choice([None, 1, 2]), r.choice(["", "a", "b", None]), r.choice([0, 5, None]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "meeting int, sp int, titre string, montant int, n int")
    now, new = df.filter("n % 2 = 0"), df.filter("n % 2 = 1")
    keys, order, columns = ["meeting", "sp"], ["n"], ["titre", "montant"]
    first = merge.dedup_best_filled(new, keys, order, columns)
    both = now.withColumn("_new", F.lit(0)).unionByName(first.withColumn("_new", F.lit(1)))
    want = sorted(r.n for r in merge.dedup_best_filled(both, keys, ["_new", *order], columns).collect())
    got = merge.upsert_points(now, new, keys, order, columns)
    assert plan_of(got).count("- Window [") == 1 and "REPARTITION_BY_COL" in plan_of(got)  # dealt before any task orders its rows
    assert sorted(r.n for r in got.collect()) == want and len(want) == 8


def test_keys_are_dealt_before_they_are_counted(spark):
    x = spark.createDataFrame([(1, 1, "a", 1.0), (1, 1, "", 2e8), (1, 1, None, -1.0), (1, 2, "b", None), (None, None, "c", 0.0), (None, None, "c", 0.0)], "meeting int, sp int, titre string, montant double")
    for df in (merge.validate_points(x), merge.preview_merge(x, x.filter("sp = 2"))):
        assert "REPARTITION_BY_NUM" in plan_of(df)
    got = sorted(map(tuple, merge.validate_points(x).collect()), key=str)
    assert got == sorted([(1, 1, "duplicate")] * 2 + [(None, None, "duplicate")] + [(1, 1, "untitled")] * 2 + [(1, 1, "amount")] * 2, key=str)
    assert {tuple(r) for r in merge.preview_merge(x, x.filter("sp = 2")).collect()} == {(1, 4, False, 1), (None, 2, True, 0)}


def test_replies_are_parsed_once(spark):
    texts = ['a {"date_seance":"1","points":[{"sp":1}]} b', '```json\n{"points":[{"sp":"é}"},{"sp":2}]}\n```', "} no {", "x {", "", None, '{"points":null}', '{"points":[]}', '{"points":[{"sp":2}', 'é{"points":[{"sp":"日"}]}é']
    x = files.reply_points(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string"))
    assert plan_of(x).count("from_json") == 1
    assert [(r.i, r.date_seance, r.sp) for r in x.collect()] == [(0, "1", "1"), (1, None, "é}"), (1, None, "2"), (9, None, "日")]


def test_lines_are_shuffled_for_three_tables_only(spark):
    """Customers, nations and regions are joined to the orders: the lines wait for three shuffles, not six."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(registry.points(spark, SMALL)).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    depth = lambda s: len(s) - len(s.lstrip(" :+-"))
    at = next(i for i, s in enumerate(plan) if "FileScan parquet [l_" in s)
    above, now = 0, depth(plan[at])
    for s in reversed(plan[:at]):
        if depth(s) < now:
            now, above = depth(s), above + ("Exchange hashpartitioning" in s)
    assert above == 3
    plain = spark.sql(registry._TABLE.sub(r"\1minuteloom_\2", A.POINTS))
    assert registry.points(spark, SMALL).drop("tags").exceptAll(plain).count() == 0 == plain.exceptAll(registry.points(spark, SMALL).drop("tags")).count()


def test_a_name_is_cleaned_once_for_its_pair(spark):
    names = ["M. Jan PEETERS", "PEETERS Jan", "Jan Peeters", "JAN PEETERS", "Jan", None, "", "Mme Éva D'HONT, échevine", "Van den PEETERS Jan"]
    x = people.name_pairs(spark.createDataFrame([(n,) for n in names], "name string"))
    assert plan_of(x).count("Messieurs") == 1
    assert {tuple(r) for r in x.collect()} == {("jan", "peeters"), ("eva", "d'hont")}
