"""Registered queries over the registry of people, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from minuteloom.operators import people, registry
from minuteloom.plans import adapters as A
from minuteloom.plans.registry import P, deposits_and_answers, points, query, view

CF, CL, SF, SL, ZL = A.first("o_custkey"), A.last("o_custkey"), A.first("l_suppkey"), A.last("l_suppkey"), A.last("o_custkey + 5000000")
#: An author is named 'First LAST' in odd points and 'Last First' in even ones, who answers always the first way.
NAMED = f"CASE WHEN l_linenumber % 2 = 1 THEN concat({CF}, ' ', upper({CL})) ELSE concat({CL}, ' ', {CF}) END"
POINTS = f"""SELECT concat(CAST(l_orderkey AS VARCHAR(19)), '-', CAST(l_linenumber AS VARCHAR(9)), '-', CAST(l_partkey AS VARCHAR(19)), '-', CAST(l_suppkey AS VARCHAR(19))) AS point, l_orderkey AS meeting, l_linenumber AS sp, o_custkey, l_suppkey, CAST(o_orderdate AS DATE) AS date,
  CASE WHEN l_returnflag = 'R' THEN 'question_orale' WHEN l_linenumber = 1 AND l_returnflag = 'A' THEN 'motion' WHEN l_linenumber = 2 AND l_returnflag = 'A' THEN 'demande_habitant' ELSE 'point' END AS type,
  concat(CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 'Motion de M. ' WHEN l_returnflag = 'A' AND l_linenumber = 2 THEN 'Demande de M. ' ELSE '' END, {NAMED}, ' - point ', CAST(l_orderkey AS VARCHAR(19)), ' ', CAST(l_linenumber AS VARCHAR(9))) AS titre,
  '' AS resume, {NAMED} AS said, concat('M. ', {SF}, ' ', upper({SL})) AS repondant, CAST(NULL AS VARCHAR(9)) AS mayor, CAST(NULL AS VARCHAR(9)) AS acting FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
#: Chapters: some are a point of their author's, some an act of somebody whom no minutes name, some of a body.
FILMS = f"""SELECT point AS chapter, date, titre, CASE l_suppkey % 4 WHEN 0 THEN concat({CF}, ' ', upper({CL})) WHEN 1 THEN concat('Zed ', upper({ZL})) WHEN 2 THEN 'Le Collège' ELSE '' END AS auteur, concat('https://film.example/', point) AS deeplink FROM ({POINTS}) WHERE type <> 'point'"""
PEOPLE = f"""WITH p AS ({POINTS}), known AS (SELECT l_suppkey AS k FROM p UNION SELECT o_custkey FROM p WHERE sp % 2 = 1 OR (type <> 'point' AND l_suppkey % 4 = 0)),
  w AS (SELECT *, CASE WHEN sp % 2 = 1 OR o_custkey IN (SELECT k FROM known) THEN lower({CL}) ELSE lower({CF}) END AS author_key, lower({SL}) AS answer_key FROM p),
  d AS (SELECT author_key AS key, type, said AS name FROM w WHERE type <> 'point' UNION ALL SELECT lower({ZL}), 'video', concat('Zed ', upper({ZL})) FROM p WHERE type <> 'point' AND l_suppkey % 4 = 1),
  a AS (SELECT answer_key AS key, concat({SF}, ' ', upper({SL})) AS name FROM w),
  films AS (SELECT lower({CL}) AS key, concat({CF}, ' ', upper({CL})) AS name FROM p WHERE type <> 'point' AND l_suppkey % 4 = 0),
  v AS (SELECT key, name FROM d UNION SELECT key, name FROM a UNION SELECT key, name FROM films UNION SELECT author_key, said FROM w WHERE author_key IN (SELECT key FROM d UNION SELECT key FROM a)),
  n AS (SELECT key, array_to_string(list_transform(string_split(name, ' '), lambda t: upper(t[1]) || lower(t[2:])), ' ') AS name FROM v QUALIFY row_number() OVER (PARTITION BY key ORDER BY lower(string_split(name, ' ')[2]) = key DESC, length(name) DESC, name) = 1)"""


@query(PEOPLE + """, c AS (SELECT key, count(*) FILTER (type = 'question_orale') AS questions, count(*) FILTER (type = 'demande_habitant') AS requests, count(*) FILTER (type = 'motion') AS motions, count(*) FILTER (type = 'video') AS videos, count(*) AS deposits FROM d GROUP BY 1),
  e AS (SELECT key, count(*) AS answers FROM a GROUP BY 1), j AS (SELECT key, coalesce(questions, 0) AS questions, coalesce(requests, 0) AS requests, coalesce(motions, 0) AS motions, coalesce(videos, 0) AS videos, coalesce(deposits, 0) AS deposits, coalesce(answers, 0) AS answers FROM c FULL JOIN e USING (key))
  SELECT j.*, CASE WHEN (answers > 0 AND deposits = 0) OR (answers >= 8 AND answers > deposits) THEN 'college' ELSE 'councillor' END AS role, name FROM j LEFT JOIN n USING (key) WHERE deposits + answers >= 2""")
def a9_people_of_all_sources(spark, sf_dir):
    x = view(spark, sf_dir, POINTS).withColumn("intervenants", F.array("said"))
    return registry.people_activity(x, view(spark, sf_dir, FILMS), bodies=["le college"])


@query(f"WITH p AS ({POINTS}), k AS (SELECT o_custkey AS c FROM p WHERE sp % 2 = 1 UNION SELECT l_suppkey FROM p UNION SELECT o_custkey FROM p WHERE type <> 'point' AND l_suppkey % 4 = 0), f AS (SELECT c AS o_custkey FROM k) SELECT DISTINCT lower({CF}) AS first, lower({CL}) AS last FROM f UNION SELECT 'zed', lower({ZL}) FROM p WHERE type <> 'point' AND l_suppkey % 4 = 1")
def f27_pairs_of_all_sources(spark, sf_dir):
    x = view(spark, sf_dir, POINTS).withColumn("intervenants", F.array("said"))
    return registry.mentioned_pairs(x, view(spark, sf_dir, FILMS), ["le college"])


@query(P + "SELECT year(date)::INTEGER AS year, count(*) AS acts FROM points WHERE author = 'Customer#000000001' AND type <> 'point' GROUP BY 1")
def k5_years_covered(spark, sf_dir):
    deposits, _ = deposits_and_answers(points(spark, sf_dir))
    return people.years_covered(deposits, "Customer#000000001")
