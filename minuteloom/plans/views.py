"""Registered queries for reading order, links to films and files, wording, prompts and people, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from minuteloom.operators import meetings, people, retrieval, stats
from minuteloom.plans import adapters as A
from minuteloom.plans.registry import P, deposits_and_answers, points, query, view

RAW = "SELECT l_orderkey AS meeting, l_linenumber AS n, l_partkey, l_suppkey, CASE WHEN l_suppkey % 5 = 0 THEN concat('bis ', CAST(l_linenumber AS VARCHAR(9))) ELSE CAST(l_linenumber + 5 AS VARCHAR(9)) END AS sp_raw FROM lineitem"
CHAPTERS = """SELECT l_orderkey AS meeting, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber - l_linenumber % 4 END AS sp, l_linenumber AS ord, concat('chapter ', CAST(l_linenumber AS VARCHAR(9))) AS titre,
  CASE WHEN l_linenumber = 6 THEN '' ELSE concat('https://www.youtube.com/watch?v=', CAST(l_orderkey AS VARCHAR(19)), '&t=', CAST(l_linenumber * 60 AS VARCHAR(9)), 's') END AS deeplink FROM lineitem WHERE l_linenumber > 1"""
SESSIONS = "SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 7 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) END AS date, concat(CASE o_orderkey % 3 WHEN 0 THEN 'https://youtu.be/' WHEN 1 THEN 'https://www.youtube.com/watch?v=' ELSE '' END, lpad(CAST(o_orderkey AS VARCHAR(11)), 11, 'x')) AS video_url FROM orders"
PAGES = "SELECT conv_id AS doc, turn AS page_num, concat('SP ', CAST(turn % 3 AS VARCHAR(9)), '.- ', text, ' sp', CAST(turn AS VARCHAR(9)), ' .-') AS text FROM conversations"


@query(f"WITH r AS ({RAW}), n AS (SELECT *, try_cast(sp_raw AS INTEGER) AS k FROM r) SELECT meeting, sp_raw, l_partkey, l_suppkey, row_number() OVER (PARTITION BY meeting ORDER BY k IS NULL, k, sp_raw, l_partkey, l_suppkey)::INTEGER AS place FROM n")
def k3_sort_points(spark, sf_dir):
    return meetings.sort_points(view(spark, sf_dir, RAW).drop("n"), "l_partkey", "l_suppkey")


@query(P + "SELECT date, meeting, sp, partkey, suppkey FROM points WHERE year(date) = 1997 ORDER BY date DESC, sp")
def k6_year_view(spark, sf_dir):
    return meetings.year_view(points(spark, sf_dir).select("date", "meeting", "sp", "partkey", "suppkey"), 1997)


@query(P + "SELECT meeting, date, year(date)::INTEGER AS year, points, count(*) OVER (PARTITION BY year(date)) AS in_year FROM (SELECT meeting, date, count(*) AS points FROM points GROUP BY ALL)")
def k9_meetings_by_year(spark, sf_dir):
    return meetings.meetings_by_year(points(spark, sf_dir).groupBy("meeting", "date").agg(F.count("*").alias("points")))


@query(P + ", m AS (SELECT meeting, date, count(DISTINCT (partkey, suppkey, sp, montant)) AS points FROM t JOIN points USING (meeting, date) WHERE theme = 'promo' GROUP BY ALL) SELECT meeting, date, year(date)::INTEGER AS year, count(*) OVER (PARTITION BY year(date)) AS in_year FROM m")
def k9_meetings_of_theme(spark, sf_dir):
    x = stats.meeting_themes(points(spark, sf_dir)).select("meeting", "date", F.transform("themes", lambda t: t["theme"]).alias("themes"))
    return meetings.meetings_by_year(x, "promo").drop("themes")


SOURCES = "SELECT l_orderkey AS question, l_linenumber AS id, CASE WHEN l_returnflag = 'N' THEN 'video_conseil' ELSE 'pv' END AS source_type, l_discount AS score, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_linenumber < 6 THEN l_linenumber END AS sp FROM lineitem"


@query(f"WITH s AS ({SOURCES}) SELECT question, id, row_number() OVER (PARTITION BY question ORDER BY source_type <> 'video_conseil', CASE WHEN source_type = 'video_conseil' THEN score END DESC NULLS LAST, date DESC NULLS LAST, coalesce(sp, 0), id)::INTEGER AS place FROM s")
def k7_order_sources(spark, sf_dir):
    return meetings.order_sources(view(spark, sf_dir, SOURCES)).select("question", "id", "place")


@query(f"WITH f AS ({A.FILES}) SELECT name AS url, CASE WHEN ord % 5 > 0 THEN date END AS date FROM f ORDER BY date DESC NULLS LAST, url")
def k8_links_newest_first(spark, sf_dir):
    return meetings.links_newest_first(view(spark, sf_dir, A.FILES).select(F.col("name").alias("url"), F.when(F.col("ord") % 5 > 0, F.col("date")).alias("date")))


@query(P + f""", c AS ({CHAPTERS}), m AS (SELECT meeting, sp, arg_max(deeplink, ord) AS video_url FROM c WHERE sp IS NOT NULL AND deeplink <> '' GROUP BY ALL)
  SELECT meeting, sp, titre, type, video_url, video_url IS NOT NULL AS video_precise FROM points LEFT JOIN m USING (meeting, sp) UNION ALL SELECT meeting, sp, titre, 'video', deeplink, true FROM c WHERE sp IS NULL""")
def j5_merge_video_links(spark, sf_dir):
    return meetings.merge_video_links(points(spark, sf_dir), view(spark, sf_dir, CHAPTERS))


@query(f"""WITH f AS ({A.FILES}), p AS (SELECT ord, name, date, concat('/minutes/', ord) AS path FROM f WHERE ord % 3 > 0), n AS (SELECT name AS source_file, min(path) AS by_name FROM p GROUP BY 1),
  d AS (SELECT date, path AS by_date FROM p QUALIFY row_number() OVER (PARTITION BY date ORDER BY name, path) = 1) SELECT ord, coalesce(by_name, by_date) AS path
  FROM (SELECT ord, date, CASE WHEN ord % 2 = 0 THEN name END AS source_file FROM f) LEFT JOIN n USING (source_file) LEFT JOIN d USING (date)""")
def j6_source_file_lookup(spark, sf_dir):
    f = view(spark, sf_dir, A.FILES)
    files = f.filter("ord % 3 > 0").select("name", "date", F.concat(F.lit("/minutes/"), F.col("ord").cast("string")).alias("path"))
    return meetings.source_file_lookup(f.select("ord", "date", F.when(F.col("ord") % 2 == 0, F.col("name")).alias("source_file")), files).select("ord", "path")


@query(f"WITH f AS ({A.FILES}) SELECT ord, name FROM f WHERE name NOT IN (SELECT name FROM f WHERE ord % 6 = 0)")
def j8_skip_done(spark, sf_dir):
    f = view(spark, sf_dir, A.FILES)
    return meetings.skip_done(f.select("ord", "name"), f.filter("ord % 6 = 0"), "name")


@query(f"WITH n AS ({A.NAMES}) SELECT id, CASE WHEN id % 8 = 7 THEN 'Secrétaire Communal' WHEN id % 3 = 0 THEN concat('Known ', l) ELSE CASE id % 8 WHEN 0 THEN concat(f, ' ', l) WHEN 1 THEN concat(l, ' ', f) WHEN 2 THEN l WHEN 3 THEN concat('Van den ', l, ' ', f) WHEN 4 THEN concat('De ', l) ELSE concat('Bourgmestre ', f, ' ', l) END END AS display FROM n WHERE id % 8 NOT IN (1, 5)")
def j10_resolve_display_names(spark, sf_dir):
    x = view(spark, sf_dir, A.NAMES).filter("id % 8 not in (1, 5)").withColumn("key", people.person_key(F.col("raw")))
    known = view(spark, sf_dir, A.NAMES).filter("id % 3 = 0 and id % 8 <> 7").select(F.lower("l").alias("key"), F.concat(F.lit("Known "), "l").alias("name"))
    return people.resolve_display_names(x, known, "raw").select("id", "display")


@query(P + "SELECT meeting, sp, partkey, suppkey, unnest(CASE WHEN meeting % 4 = 0 AND sp <= 2 THEN ['first', 'second'] ELSE [author] END) AS author FROM points")
def j11_apply_author_overrides(spark, sf_dir):
    told = view(spark, sf_dir, "SELECT o_orderkey AS meeting, explode(array(1, 2)) AS sp, array('first', 'second') AS authors FROM orders WHERE o_orderkey % 4 = 0")
    return people.apply_author_overrides(points(spark, sf_dir).select("meeting", "sp", "partkey", "suppkey", "author"), told)


@query(P + "SELECT DISTINCT key, name FROM (SELECT suppkey % 40 AS key, speaker AS name, sp FROM points) WHERE sp = 1 OR (sp > 4 AND key IN (SELECT suppkey % 40 FROM points WHERE sp = 1))")
def j14_enrich_variants(spark, sf_dir):
    x = points(spark, sf_dir).select((F.col("suppkey") % 40).alias("key"), F.col("speaker").alias("name"), "sp")
    return people.enrich_variants(x.filter("sp > 4"), x.filter("sp = 1"), x.filter("sp = 1"))


@query(P + """, d AS (SELECT author AS key, count(*) AS deposits FROM points WHERE type <> 'point' GROUP BY 1), a AS (SELECT speaker AS key, count(*) AS answers FROM points GROUP BY 1),
  j AS (SELECT key, coalesce(deposits, 0) AS deposits, coalesce(answers, 0) AS answers FROM d FULL JOIN a USING (key)) SELECT key, deposits, answers, deposits + answers AS total FROM j
  WHERE deposits + answers >= 3 AND NOT ((answers > 0 AND deposits = 0) OR (answers >= 8 AND answers > deposits)) ORDER BY total DESC, deposits DESC, key""")
def k4_rank_people(spark, sf_dir):
    return people.rank_people(people.person_activity(*deposits_and_answers(points(spark, sf_dir))), 3, "councillor").select("key", "deposits", "answers", "total")


@query(P + "SELECT date, sp, meeting, titre FROM points WHERE author = 'Customer#000000001' AND year(date) >= 1992 ORDER BY date DESC, sp DESC")
def k5_person_timeline(spark, sf_dir):
    return people.person_timeline(points(spark, sf_dir).withColumnRenamed("author", "key"), "Customer#000000001").select("date", "sp", "meeting", "titre")


SUMMARY = "CASE decision WHEN 'PREND ACTE' THEN 'Pris acte' WHEN 'Reporté' THEN 'Reporté' WHEN 'approuve' THEN 'Approuvé' END"


@query(P + f"""SELECT meeting, sp, partkey, suppkey, {SUMMARY} || CASE vote_type WHEN 'unanimite' THEN ' à l''unanimité' WHEN 'vote_nominal' THEN concat(' (', sp, ' pour, ', suppkey % 3, ' contre, ',
  suppkey % 2, CASE WHEN suppkey % 2 = 1 THEN ' abstention)' ELSE ' abstentions)' END) ELSE '' END AS outcome FROM points""")
def f17_decision_summary(spark, sf_dir):
    said = meetings.decision_summary(F.col("decision"), F.col("vote_type"), F.col("sp"), F.col("suppkey") % 3, F.col("suppkey") % 2)
    return points(spark, sf_dir).select("meeting", "sp", "partkey", "suppkey", F.coalesce(said, F.lit(None)).alias("outcome"))


@query(f"WITH r AS ({RAW}) SELECT meeting, n, l_partkey, l_suppkey, CASE WHEN l_suppkey % 5 = 0 AND n BETWEEN 6 AND 9 THEN n WHEN l_suppkey % 5 > 0 AND n + 5 BETWEEN 6 AND 9 THEN n + 5 ELSE 6 END::INTEGER AS page FROM r")
def f14_fix_point_page(spark, sf_dir):
    return view(spark, sf_dir, RAW).select("meeting", "n", "l_partkey", "l_suppkey", meetings.fix_point_page(F.col("sp_raw"), F.lit(6), F.lit(9)).alias("page"))


@query(f"WITH p AS ({PAGES}), n AS (SELECT doc, page_num, unnest(regexp_extract_all(text, '(?i)SP\\s*(\\d{{1,9}})\\s*\\.-', 1))::INTEGER AS sp FROM p) SELECT doc, sp, min(page_num) AS page_num FROM n GROUP BY ALL")
def f16_sp_anchors(spark, sf_dir):
    return meetings.sp_anchors(view(spark, sf_dir, PAGES))


#: A document for every 40 conversations, so that documents have many pages; some pages are short.
BOOK = "SELECT CAST(floor(conv_id / 40) AS BIGINT) AS doc, CAST(conv_id % 40 * 100 + turn AS INTEGER) AS page_num, CASE WHEN turn = 1 THEN substring(text, 1, 90) ELSE text END AS text FROM conversations"
RUNS = f"""WITH b AS ({BOOK}), u AS (SELECT *, (row_number() OVER (PARTITION BY doc ORDER BY page_num, text) - 1) // 8 AS page_group FROM b WHERE length(text) > 100),
  r AS (SELECT doc, page_group::BIGINT AS page_group, min(page_num) OVER g AS first_page, max(page_num) OVER g AS last_page, page_num, text FROM u WINDOW g AS (PARTITION BY doc, page_group)) """


@query(RUNS + "SELECT doc, page_group, first_page, last_page, page_num, md5(text) AS text FROM r")
def w8_page_chunks(spark, sf_dir):
    return meetings.page_chunks(meetings.useful_pages(view(spark, sf_dir, BOOK))).withColumn("text", F.md5("text"))


@query(f"WITH b AS ({BOOK}) SELECT doc, count(*) AS pages FROM b WHERE length(text) > 50 GROUP BY 1")
def p14_useful_pages(spark, sf_dir):
    return meetings.useful_pages(view(spark, sf_dir, BOOK), 50).groupBy("doc").agg(F.count("*").alias("pages"))


@query(RUNS + "SELECT doc, page_group, first_page, last_page, md5(string_agg('[Page ' || page_num || ']' || chr(10) || text, chr(10) || chr(10) || '---PAGE---' || chr(10) || chr(10) ORDER BY page_num, text)) AS prompt FROM r GROUP BY ALL")
def f39_extraction_prompts(spark, sf_dir):
    return meetings.extraction_prompts(view(spark, sf_dir, BOOK)).withColumn("prompt", F.md5("prompt"))


@query(f"WITH s AS ({SESSIONS}) SELECT ord, right(video_url, 11) AS video_id FROM s")
def f31_video_id_from(spark, sf_dir):
    return view(spark, sf_dir, SESSIONS).select("ord", meetings.video_id_from(F.col("video_url")).alias("video_id"))


@query(f"WITH s AS ({SESSIONS}) SELECT count(*) AS sessions, count(*) FILTER (date = 'soon') AS bad_dates, count(*) FILTER (NOT starts_with(video_url, 'https://www')) AS bad_urls FROM s")
def q3_video_checks(spark, sf_dir):
    return meetings.video_checks(view(spark, sf_dir, SESSIONS))


#: Ways in which a person is mentioned: in order, the other way round, in capitals, by surname, with a word twice.
VARIANTS = f"""SELECT lower({A.L1}) AS key, CASE c_custkey % 5 WHEN 0 THEN concat({A.F1}, ' ', {A.L1}) WHEN 1 THEN concat({A.L1}, ' ', {A.F1}) WHEN 2 THEN {A.L1} WHEN 3 THEN concat({A.L1}, ' ', upper({A.L1})) ELSE concat('Longer ', {A.L1}, ' ', {A.L1}) END AS name, c_custkey AS k FROM customer
  UNION ALL SELECT lower({A.L1}), CASE WHEN c_custkey % 2 = 0 THEN concat({A.F1}, ' ', {A.L1}) ELSE concat({A.L1}, ' ', {A.F1}) END, c_custkey FROM customer WHERE c_custkey % 3 > 0"""


@query(f"""WITH v AS (SELECT DISTINCT key, name FROM ({VARIANTS})), t AS (SELECT *, string_split(lower(name), ' ') AS w FROM v), r AS (SELECT key, name, w[-1] = key AND len(list_distinct(w)) = len(w) AS sound, len(w) AS words FROM t)
  SELECT key, name FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY sound DESC, words DESC, length(name) DESC, name) = 1""")
def f28_best_display_name(spark, sf_dir):
    return people.best_display_name(view(spark, sf_dir, VARIANTS))


KIND = "CASE turn % 4 WHEN 0 THEN 'motion' WHEN 1 THEN 'question' WHEN 2 THEN 'taxe' ELSE 'other' END"
FILMED = f"SELECT concat('c', CAST(conv_id AS VARCHAR(19))) AS video_id, turn AS start_s, text AS titre, text AS first, CASE WHEN turn % 2 = 0 THEN role ELSE ' ' END AS last, {KIND} AS type, CASE WHEN turn % 3 > 0 THEN role END AS auteur, '2024-05-06' AS date, 'north' AS commune FROM conversations"


def filmed(spark, sf_dir):
    part = lambda after, name: F.struct((F.col("start_s") + after).alias("start_s"), F.col(name).alias("text"))
    link = F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id", F.lit("&t="), F.col("start_s").cast("string"), F.lit("s"))
    return view(spark, sf_dir, FILMED).withColumns({"transcript": F.array(part(5, "first"), part(9, "last")), "deeplink": link})


CHUNKED = f"""WITH c AS ({FILMED}), k AS (SELECT *, 'video-' || video_id || '-' || start_s AS id, trim(titre) AS t, CASE type WHEN 'motion' THEN 'Motion' WHEN 'question' THEN 'Question' WHEN 'taxe' THEN 'Taxe' ELSE 'Point à l''ordre du jour' END AS label,
    CASE WHEN auteur IS NOT NULL AND type IN ('motion', 'question') THEN ' à la demande de ' || auteur ELSE '' END AS par FROM c),
  r AS (SELECT id, concat('Conseil communal de North du 2024-05-06 — point débattu en séance (vidéo).', chr(10), 'Titre : ', t, chr(10), 'Type : ', label, par, '.') AS chunk_text, start_s, k.* EXCLUDE (id, start_s) FROM k
  UNION ALL SELECT id || '-t' || (start_s + d), concat('Conseil communal de North du 2024-05-06 — extrait du débat filmé.', chr(10), 'Point : ', t, ' (', label, par, ').', chr(10), 'Extrait : ', trim(said)), start_s + d, k.* EXCLUDE (id, start_s)
    FROM k, LATERAL (SELECT unnest([5, 9]) AS d, unnest([first, last]) AS said) WHERE trim(said) <> '') """


@query(CHUNKED + "SELECT id, md5(chunk_text) AS chunk_text, start_s, label || coalesce(' · ' || auteur, '') AS decision, concat('https://www.youtube.com/watch?v=', video_id, '&t=', start_s, 's') AS url FROM r")
def f20_video_chunks(spark, sf_dir):
    return retrieval.video_chunks(filmed(spark, sf_dir)).select("id", F.md5("chunk_text").alias("chunk_text"), "start_s", "decision", "url")
