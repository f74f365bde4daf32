"""Operators whose groups may be of any size: themes by index, medians by rank, packing with carried state, facets in one scan."""

import datetime as dt
import random
import statistics

from pyspark.sql import functions as F
from test_stored import plan_of

from minuteloom.functions import text
from minuteloom.operators import index, meetings, quantiles, stats, themes, video
from minuteloom.plans import registry

SMALL = "/root/testdata/sf0.001"


def test_themes_by_index_are_those_of_the_pattern(spark):
    r = random.Random(2)
    words = "voirie écoles Voiries trottoirs pavé pavés œuvre scolaire enseignement budget sports sport sportif velo vélo_cargo déchets nettoyage l'école rue-école 12ecole piscines cpas climat".split()
    names = ["voirie", "écoles", "transports scolaires", "Propreté des rues", "budget", "piscines", "sports et culture", "oeuvre", "rue", "cpas", "zzz", "", None]
    points = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 6))) or None, [r.choice(words).replace("é", "É"), "marche_public"]) for i in range(300)] + [(300, None, None), (301, "Voirie", ["voirie"]), (301, "Voirie", ["voirie"])]
    df = spark.createDataFrame(points, "id int, titre string, tags array<string>")
    table = themes.stems_table(spark.createDataFrame([(n,) for n in names], "theme string"))
    stems = {}
    for x in table.collect():
        stems.setdefault(x.theme, []).append(x.stem)
    for n in names:
        try:
            want = text.theme_stems(n or "")
        except ValueError:
            want = []
        assert sorted(stems.get(n, [])) == want
    want = {(i, n) for n in stems for (i,) in df.filter(text.matches_theme(themes.plain_text(df), n)).select("id").collect()}
    hits = themes.matched_themes(df, table, ["id"])
    assert len(want) > 300 and sorted((x.id, x.theme) for x in hits.collect()) == sorted(want)
    assert themes.matched_themes(df, table.limit(0), ["id"]).count() == 0


def test_thousands_of_themes_take_one_scan(spark):
    many = spark.range(5000).select(F.concat(F.lit("th"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("theme"))
    points = registry.points(spark, SMALL)
    hits = themes.matched_themes(points, themes.stems_table(many), ["meeting", "sp"])
    assert plan_of(hits).count("Scan parquet") == plan_of(points).count("Scan parquet")


def test_a_beginning_meets_its_own_stem_only(spark):
    """Stems of the same first letters: rows of the join are those of beginnings that are stems, and themes of equal stems count once."""
    tail = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    stems = spark.range(3000).select(F.concat(F.lit("tha"), tail).alias("theme")).select("theme", F.col("theme").alias("stem"))
    more = spark.createDataFrame([("Thab", "thab"), ("two", "thab"), ("two", "thac"), ("none", "zzz")], "theme string, stem string")
    points = spark.createDataFrame([(1, "thabc thabc thab"), (1, "thac"), (2, "thabz"), (3, "th"), (4, None)], "id int, titre string")
    hits = themes._hits(points, stems.unionByName(more), "theme", ["id"])
    assert hits.count() <= 16 and "startswith" not in plan_of(hits).lower()  # 3 letters alone would meet 3000 stems a word
    want = {(1, "thab"), (1, "thabc"), (1, "thac"), (2, "thab"), (1, "Thab"), (1, "two"), (2, "Thab"), (2, "two")}
    assert {tuple(r) for r in themes.matched_themes(points, stems.unionByName(more), ["id"]).collect()} == want
    assert {tuple(r) for r in themes.theme_counts(points, stems.unionByName(more), ["id"]).collect()} == {("thab", 2), ("Thab", 2), ("two", 2), ("thabc", 1), ("thac", 1)}


def test_median_by_rank_is_percentile(spark):
    r = random.Random(4)
    rows = [("odd", r.random()) for _ in range(1001)] + [("even", round(r.random(), 2)) for _ in range(2000)] + [("same", 0.5)] * 300 + [("two", 1.0)] * 50 + [("two", 3.0)] * 50
    rows += [("skew", 0.0)] * 500 + [("skew", float(i)) for i in range(499)] + [("one", 7.0), ("none", None), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    for parts in (2, 16, 512):
        got = {x.k: x["median"] for x in quantiles.exact_median(df, ["k"], "v", parts).collect()}
        assert got == {k: statistics.median(v for x, v in rows if x == k) for k, v in rows if v is not None}
    assert quantiles.exact_median(df.limit(0), ["k"], "v").count() == 0
    assert "percentile(" not in plan_of(quantiles.exact_median(df, ["k"], "v"))


def packed(texts, most):
    out, held = [], 0
    for t in texts:
        if not out or held + len(t) + 1 > most:
            out.append([])
            held = 0
        out[-1].append(t)
        held += len(t) + 1
    return [" ".join(x) for x in out]


def test_a_long_chapter_is_packed_in_order(spark):
    r = random.Random(5)
    chapters = {"long": 120_000, "a": 1, "b": 30, None: 3}
    rows = [(c, i, i * 2.0, "w" * r.choice((0, 3, 40, 90, 2000 if i % 997 == 0 else 5))) for c, n in chapters.items() for i in range(n)]
    df = spark.createDataFrame(rows, "chapter string, ord int, start_s double, text string")
    got = {}
    for x in video.pack_segments(df.withColumn("text", F.when(F.col("text") != "", F.col("text"))), 1500).orderBy("part").collect():
        got.setdefault(x.chapter, []).append((x.part, x.text, x.start_s))
    for c in chapters:
        own = [t for k, _, _, t in rows if k == c]
        assert [t for _, t, _ in got[c]] == packed(own, 1500) and [p for p, _, _ in got[c]] == list(range(len(got[c]))) and got[c][0][2] == 0.0
    plan = plan_of(video.pack_segments(df))
    assert "collect_list" not in plan and plan.count("Exchange") <= 2


def test_excerpts_gather_only_what_they_keep(spark):
    rows = [("v", 1, float(i), i, "abcdefghi" if i % 5 else None) for i in range(5000)] + [("v", 2, 0.0, 9, "x" * 3000), ("w", 1, 0.0, 1, None)]
    got = {(x.video_id, x.chapter): x.excerpt for x in video.chapter_excerpts(spark.createDataFrame(rows, "video_id string, chapter int, t double, segment int, text string")).collect()}
    said = " ".join("abcdefghi" for i in range(5000) if i % 5)
    assert got == {("v", 1): said[:1200], ("v", 2): "x" * 1200, ("w", 1): ""}


def test_facets_take_one_scan(spark):
    x = registry.faceted(spark, SMALL)
    plan = plan_of(stats.facet_counts(x, "motion", "standard", None))
    assert plan.count("Scan parquet") == plan_of(x).count("Scan parquet")
    got = {(r.facet, r.value): r.n for r in stats.facet_counts(x, None, None, "nobody").collect()}
    assert got["person", "nobody"] == 0 and all(f == "person" for f, _ in got)


def test_a_long_video_is_aligned_in_stretches(spark):
    r = random.Random(7)
    chapters = [("long", i, r.choice([r.randint(0, 90_000), 100 * r.randint(0, 900)])) for i in range(300)] + [("short", 1000, 5), ("none", 1001, None), ("late", 1002, 80_000)]
    segments = [("long", i, float(r.randint(0, 90_000))) for i in range(20_000)] + [("short", 1, 4.0), ("short", 2, 5.0), ("short", 3, 70_000.5), ("none", 4, 1.0), ("late", 5, 10.0), ("other", 6, 1.0), ("long", -1, None)]
    want = {}
    for v in {v for v, *_ in segments}:
        own = sorted((s, c) for w, c, s in chapters if w == v and s is not None)
        for w, i, t in segments:
            if w == v and t is not None and (on := [c for s, c in own if s <= t]):
                want[v, i] = on[-1]
    frames = spark.createDataFrame(chapters, "video_id string, chapter int, start_s int"), spark.createDataFrame(segments, "video_id string, segment int, t double")
    for width in (60.0, 1800.0, 1e9):
        got = video.align_transcript(*frames, width).collect()
        assert len(got) == len(want) and {(x.video_id, x.segment): x.chapter for x in got} == want


def test_the_index_stays_where_it_is(spark, tmp_path):
    rows = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "id string, v string")
    ids = [f"PV-{i}_SP{i % 7}" for i in range(500)]
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert index.upsert_index(spark, "held_index", str(tmp_path), rows(ids + [None], "old"), 8) == 0
    new = rows([*ids[:20], *ids[:3], "added", None], "new")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = plan_of(index.index_upserts(index.open_index(spark, "held_index"), new.repartition(8, "id")))
        tree = plan[: plan.index("\n\n\n")] if "\n\n\n" in plan else plan
        assert tree.count("Exchange") == 2 and "Bucketed: true" in plan  # the new records' keys and the new records
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
    for version in (1, 2, 3):
        assert index.upsert_index(spark, "held_index", str(tmp_path), new) == version
        got = {(r.id, r.v) for r in index.open_index(spark, "held_index").collect()}
        assert got == {(i, "new") for i in [*ids[:20], "added"]} | {(i, "old") for i in ids[20:]} and index.open_index(spark, "held_index").count() == 501
    assert len(list(tmp_path.iterdir())) == 2  # older versions are gone


def test_targets_by_part_of_a_name(spark):
    files = [("pv-2020-01-29.pdf", "2020-01-29", "/a"), ("pv-2020-02-26.pdf", "2020-02-26", "/b"), ("notulen.pdf", None, "/c"), ("pv-2020-02-26-bis.pdf", "2020-02-26", "/0"), ("x", None, "/x")]
    want = {"notulen.pdf": "/c", "2020-02-26": "/0", "2020-01": "/a", "pdf": "/c", "bis": "/0", "x": "/x", "zz": None, "no": "/c", "2": "/a", "": None, None: None, "pv-2020-02-26.pdf ": None}
    targets = spark.createDataFrame([(t,) for t in [*want, "bis"]], "target string")
    got = meetings.resolve_targets(targets, spark.createDataFrame(files, "name string, date string, path string").withColumn("date", F.col("date").cast("date")))
    assert {r.target: r.path for r in got.collect()} == want and got.count() == len(want)


def test_meetings_are_dealt_once_before_they_are_counted(spark):
    x = spark.createDataFrame([(1, dt.date(2020, 1, 1), "point", "t", None, None, 5, ["Écoles", "ecole"]), (1, dt.date(2020, 1, 1), "point", "t", None, "vote_nominal", 7, ["ecole"]), (2, dt.date(2020, 1, 2), "motion", "t", None, None, 9, None)], "meeting int, date date, type string, titre string, decision string, vote_type string, montant int, tags array<string>")
    got = stats.meeting_summary(x)
    assert {(r.meeting, r.points, r.contested, r.engaged, r.themes) for r in got.collect()} == {(1, 2, 1, 12.0, "ecole:3:17.00"), (2, 1, 0, 0.0, "")}
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(meeting") == 1 and plan.count("Exchange hashpartitioning") == 1
