"""Registered queries for selection, links by date, chapters, attribution, normalisation, collection and records, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from minuteloom.functions import dates, text
from minuteloom.operators import chapters, collect, meetings, merge, normalize, people, retrieval, selection, stats, themes
from minuteloom.plans import adapters as A
from minuteloom.plans.registry import CANON, FACETS, LINKS, NAME_DATE, P, RECORDS, TREND, faceted, points, query, search_points, view
from minuteloom.plans.views import CHUNKED, filmed
from minuteloom.sources import files

IDS = ("meeting", "sp", "partkey", "suppkey")
ALL_IDS = ", ".join(IDS)


def _either(*words: str) -> str:
    return "|".join(words).replace("'", "''")


# --- selection
@query(P + f"SELECT {ALL_IDS} FROM points WHERE year(date) IN (1996, 1999)")
def p5_filter_years(spark, sf_dir):
    return selection.filter_years(points(spark, sf_dir).withColumn("year", F.year("date")), [1996, 1999]).select(*IDS)


@query(f"WITH f AS ({A.FILES}) SELECT ord, name FROM f WHERE year({NAME_DATE}) = 2097")
def p6_filename_year(spark, sf_dir):
    return selection.filter_by_filename_year(view(spark, sf_dir, A.FILES), 2097).select("ord", "name")


@query(f"WITH f AS ({A.FILES}) SELECT count(*) AS files, count(*) FILTER ({NAME_DATE} IS NULL) AS undated FROM f")
def p6_undated_files(spark, sf_dir):
    return selection.undated_files(view(spark, sf_dir, A.FILES))


@query(f"WITH x AS ({FACETS}) SELECT {ALL_IDS} FROM x WHERE debate AND list_contains([{CANON.format('tag1')}, {CANON.format('tag2')}], 'standard') AND (author = 'Customer#000000002' OR speaker = 'Customer#000000002')")
def p8_point_facet_filter(spark, sf_dir):
    x = faceted(spark, sf_dir)
    return selection.point_facet_filter(x, selection.DEBATE, "standard", "Customer#000000002").select(*IDS)


@query(f"WITH x AS ({FACETS}) SELECT {ALL_IDS} FROM x WHERE postponed")
def p8_postponed_points(spark, sf_dir):
    return selection.point_facet_filter(faceted(spark, sf_dir), selection.POSTPONED).select(*IDS)


OPTIONS = """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'many' WHEN 1 THEN NULL ELSE CAST(o_custkey % 90 - 10 AS VARCHAR(9)) END AS top_k, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(o_custkey % 45 AS VARCHAR(9)) END AS max_sources,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey % 13 AS DOUBLE) / 8 - 0.25 END AS score_min FROM orders"""


@query(f"""WITH o AS ({OPTIONS}), n AS (SELECT o_orderkey, try_cast(top_k AS INTEGER) AS k, try_cast(max_sources AS INTEGER) AS m, score_min FROM o) SELECT o_orderkey, CASE WHEN k IS NULL THEN 20 WHEN k < 5 THEN 5 WHEN k > 50 THEN 50 ELSE k END AS top_k,
  CASE WHEN m IS NULL THEN 8 WHEN m < 1 THEN 1 WHEN m > 30 THEN 30 ELSE m END AS max_sources, CASE WHEN score_min IS NULL THEN 0.25 WHEN score_min < 0 THEN 0.0 WHEN score_min > 0.95 THEN 0.95 ELSE score_min END::DOUBLE AS score_min FROM n""")
def p13_clamp_options(spark, sf_dir):
    return selection.clamp_options(view(spark, sf_dir, OPTIONS), 20, 8, 0.25)


@query(P + "SELECT string_agg(DISTINCT date::VARCHAR, ',' ORDER BY date::VARCHAR) AS dates, count(*) AS points FROM points")
def a17_corpus_meta(spark, sf_dir):
    return selection.corpus_meta(points(spark, sf_dir)).withColumn("dates", F.array_join("dates", ","))


@query("SELECT vec_id FROM embeddings WHERE coalesce(CASE WHEN vec_id % 4 > 0 THEN vec_id % 4 END, 0) < 2")
def s8_stale_chunks(spark, sf_dir):
    return selection.stale_chunks(view(spark, sf_dir, "SELECT vec_id, CASE WHEN vec_id % 4 > 0 THEN vec_id % 4 END AS schema_version FROM embeddings"), 2).select("vec_id")


@query("SELECT DISTINCT date FROM (SELECT o_orderdate::DATE AS date FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderdate::DATE + 1 FROM orders WHERE o_orderkey % 3 = 0)")
def s2_expected_dates(spark, sf_dir):
    made = view(spark, sf_dir, "SELECT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderkey % 2 = 0")
    return selection.expected_dates(made, view(spark, sf_dir, "SELECT date_add(CAST(o_orderdate AS DATE), 1) AS date FROM orders WHERE o_orderkey % 3 = 0"))


@query("SELECT url FROM pages UNION SELECT concat('https://town.example/', page_id) FROM pages UNION SELECT concat('https://town.example/', page_id // 2) FROM pages")
def s3_collected_links(spark, sf_dir):
    of = lambda c: view(spark, sf_dir, f"SELECT {c} AS url FROM pages")
    return selection.collected_links(of("url"), of("concat('https://town.example/', page_id)"), of("concat('https://town.example/', page_id div 2)"))


PATHS = "SELECT c_custkey, concat('/data/', CASE WHEN c_custkey % 5 = 0 THEN 'old' ELSE n_name END, '/', CASE WHEN c_custkey % 7 = 0 THEN 'Nation_3/' ELSE '' END, 'pv.pdf') AS path, CASE c_custkey % 3 WHEN 0 THEN concat('nation_1-', c_custkey) WHEN 1 THEN concat('PV-', c_custkey) END AS id FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query(f"""WITH p AS ({PATHS}), c AS (SELECT *, coalesce(list_filter(string_split(lower(path), '/'), lambda x: x IN ('nation_1', 'nation_2', 'nation_3'))[1], 'home') AS commune FROM p)
  SELECT c_custkey, commune, CASE WHEN starts_with(coalesce(id, 'PV'), commune) THEN id ELSE concat(commune, '-', coalesce(id, 'PV')) END AS id FROM c""")
def f32_commune_from_path(spark, sf_dir):
    x = view(spark, sf_dir, PATHS)
    x = x.withColumn("commune", selection.commune_from_path(F.col("path"), ["nation_1", "nation_2", "nation_3"], "home"))
    return x.select("c_custkey", "commune", selection.prefixed_id(F.col("id"), F.col("commune")).alias("id"))


@query("SELECT doc_id, sha256(coalesce(text, ''))[:20] AS key FROM documents")
def f38_content_key(spark, sf_dir):
    return view(spark, sf_dir, "SELECT * FROM documents").select("doc_id", selection.content_key(F.col("text")).alias("key"))


# --- statistics
@query(P + ", " + TREND.replace("AND NOT excluded", "") + "SELECT count(*) FILTER (NOT excluded) AS points, count(*) FILTER (NOT excluded AND montant > 0) AS with_amount, coalesce(sum(montant) FILTER (NOT excluded AND montant > 0), 0)::DOUBLE AS total, count(*) FILTER (excluded) AS left_out FROM y")
def a7_trend_totals(spark, sf_dir):
    return stats.trend_totals(points(spark, sf_dir), "voirie")


@query(P + """, g AS (SELECT year(date)::INTEGER AS year, month(date)::INTEGER AS month, date, theme, count(*) AS n, grouping(year(date), month(date), date)::INTEGER AS level FROM t GROUP BY GROUPING SETS ((theme), (year(date), theme), (year(date), month(date), theme), (year(date), month(date), date, theme)))
  SELECT level, year, month, date, theme, n, row_number() OVER (PARTITION BY level, year, month, date ORDER BY n DESC, theme)::INTEGER AS place FROM g QUALIFY place <= 12""")
def a8_scope_themes(spark, sf_dir):
    return stats.scope_themes(points(spark, sf_dir))


@query(f"WITH f AS ({A.FILES}) SELECT year(date)::INTEGER AS year, count(*) AS files FROM f GROUP BY 1")
def a16_files_by_year(spark, sf_dir):
    return collect.files_by_year(view(spark, sf_dir, A.FILES))


BLOB = "strip_accents(lower(titre || ' ' || rubrique || ' ' || tag1 || ' ' || tag2))"


@query(P + f", b AS (SELECT {ALL_IDS}, {BLOB} AS s FROM x) SELECT {ALL_IDS}, 'voirie' AS theme FROM b WHERE regexp_matches(s, '\\b(?:{'|'.join(text.theme_stems('voirie'))})') UNION ALL SELECT {ALL_IDS}, 'ecole' FROM b WHERE regexp_matches(s, '\\b(?:{'|'.join(text.theme_stems('ecole'))})') UNION ALL SELECT {ALL_IDS}, 'mobilite' FROM b WHERE regexp_matches(s, '\\b(?:{'|'.join(text.theme_stems('mobilite'))})')")
def f4_j13_themes_matched(spark, sf_dir):
    return stats.themes_matched(points(spark, sf_dir), ["voirie", "ecole", "mobilite"]).select(*IDS, "theme")


#: Texts as points, and as many themes as conversations have first words.
SAID = "SELECT doc_id AS meeting, doc_id % 7 AS sp, text AS titre FROM documents"
THEMES = "SELECT DISTINCT regexp_extract(text, '([A-Za-zÀ-ÿ]{5,})', 1) AS theme FROM conversations UNION SELECT 'transports scolaires' UNION SELECT 'Propreté des rues'"


@query(f"""WITH f AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{k}', {v.split()})" for i, (k, v) in enumerate(text.FAMILIES.items()))}) t(i, key, stems)), w AS (SELECT theme, unnest(regexp_extract_all(strip_accents(lower(theme)), '[a-z]{{3,}}')) AS w FROM ({THEMES})),
  s AS (SELECT theme, CASE WHEN length(w) > 4 AND w LIKE '%s' THEN w[:length(w) - 1] ELSE w END AS s FROM w WHERE w NOT IN ({", ".join(f"'{w}'" for w in sorted(text.STOPWORDS))})),
  m AS (SELECT theme, s, arg_min(stems, i) AS stems FROM s LEFT JOIN f ON starts_with(s, key) OR starts_with(key, s) GROUP BY ALL), k AS (SELECT DISTINCT theme, unnest(coalesce(stems, [s])) AS stem FROM m),
  p AS (SELECT DISTINCT meeting, sp, unnest(regexp_extract_all(strip_accents(lower(titre)), '[\p{{L}}\p{{Nd}}_]+')) AS w FROM ({SAID})), h AS (SELECT DISTINCT meeting, sp, theme FROM p JOIN k ON w[:3] = stem[:3] AND starts_with(w, stem))
  SELECT theme, count(*) AS points FROM h GROUP BY 1""")
def j13_theme_table(spark, sf_dir):
    return themes.theme_counts(view(spark, sf_dir, SAID), themes.stems_table(view(spark, sf_dir, THEMES)), ["meeting", "sp"])


# --- links by date
MEETINGS = "SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 13 > 0 THEN CAST(o_orderdate AS DATE) END AS date, o_custkey AS n_points, CASE WHEN o_orderkey % 3 > 0 THEN concat('/pv/', o_orderkey) END AS url FROM orders WHERE o_orderkey % 2 = 0"
FILMS = "SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 11 > 0 THEN CAST(o_orderdate AS DATE) END AS date, o_custkey AS n_points, CASE WHEN o_orderkey % 4 > 0 THEN concat('https://film.example/', o_orderkey) END AS video_url FROM orders WHERE o_orderkey % 5 < 2"
MAPS = f"""m AS ({MEETINGS}), f AS ({FILMS}), u AS (SELECT date, arg_max(url, ord) AS url FROM m WHERE date IS NOT NULL AND url IS NOT NULL GROUP BY 1), v AS (SELECT date, arg_max(video_url, ord) AS video_url FROM f WHERE date IS NOT NULL AND video_url IS NOT NULL GROUP BY 1) """


@query(P + f", {MAPS} SELECT {ALL_IDS}, url, video_url FROM points LEFT JOIN u USING (date) LEFT JOIN v USING (date)")
def j1_attach_links(spark, sf_dir):
    return selection.attach_links(points(spark, sf_dir).select("date", *IDS), view(spark, sf_dir, MEETINGS), view(spark, sf_dir, FILMS)).drop("date")


@query(f"WITH {MAPS} SELECT date, n_points, url, video_url FROM m LEFT JOIN v USING (date) WHERE date IS NOT NULL UNION ALL SELECT date, n_points, NULL, coalesce(f.video_url, v.video_url) FROM f LEFT JOIN v USING (date) WHERE date NOT IN (SELECT date FROM m WHERE date IS NOT NULL) ORDER BY date DESC")
def j2_all_meetings(spark, sf_dir):
    return selection.all_meetings(view(spark, sf_dir, MEETINGS), view(spark, sf_dir, FILMS))


@query(f"WITH f AS ({FILMS}) SELECT date, arg_max(video_url, ord) AS video_url FROM f WHERE date IS NOT NULL AND video_url <> '' GROUP BY 1")
def a19_session_video_map(spark, sf_dir):
    return chapters.session_video_map(view(spark, sf_dir, FILMS))


OF_MEETINGS = "SELECT o_orderkey AS meeting, concat('PV-', o_orderkey, '.pdf') AS source_file, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('/own/', o_orderkey) END AS url, concat('/source/', o_orderkey) AS source_url FROM orders"


@query(P + f""", {MAPS}, k AS (SELECT meeting, count(*) AS points FROM points GROUP BY 1) SELECT meeting, date, points, source_file AS file, coalesce(nullif(o.url, ''), source_url) AS url, video_url
  FROM (SELECT DISTINCT meeting, date FROM points) JOIN k USING (meeting) JOIN ({OF_MEETINGS}) o USING (meeting) LEFT JOIN v USING (date)""")
def a5_meetings_with_links(spark, sf_dir):
    x = stats.meeting_summary(points(spark, sf_dir), view(spark, sf_dir, OF_MEETINGS), view(spark, sf_dir, FILMS))
    return x.select("meeting", "date", "points", "file", "url", "video_url")


@query(P + "SELECT sum(montant) FILTER (montant <> 0)::DOUBLE AS total, max(montant) FILTER (montant <> 0)::DOUBLE AS most, count(*) FILTER (montant <> 0) AS mentions FROM points")
def a11_corpus_amounts(spark, sf_dir):
    return stats.corpus_amounts(points(spark, sf_dir))


@query(P + "SELECT t AS value, count(*) AS n FROM (SELECT unnest([tag1, tag2]) AS t FROM points) GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def a6_top_raw_themes(spark, sf_dir):
    return stats.value_counts(points(spark, sf_dir).select(F.explode("tags").alias("tag")), F.col("tag"), 10)


#: Files as targets are told: by name, by date, by a part of the name, or by something that no file has.
TOLD = f"SELECT ord, name, date, concat('/minutes/', CAST(ord AS VARCHAR(19))) AS path, CASE ord % 5 WHEN 0 THEN name WHEN 1 THEN CAST(date AS VARCHAR(10)) WHEN 2 THEN substring(name, 4, 6) WHEN 3 THEN substring(name, length(name) - 1, 2) ELSE concat(name, '?') END AS target FROM ({A.FILES})"


@query(f"""WITH f AS ({TOLD}), t AS (SELECT DISTINCT target FROM f), n AS (SELECT name, min(path) AS p FROM f WHERE ord % 3 > 0 GROUP BY 1), d AS (SELECT date::VARCHAR AS day, arg_min(path, (name, path)) AS p FROM f WHERE ord % 3 > 0 GROUP BY 1),
  h AS (SELECT target, arg_min(p, (name, p)) AS p FROM t JOIN n ON contains(name, target) GROUP BY 1) SELECT target, coalesce(n.p, d.p, h.p) AS path FROM t LEFT JOIN n ON n.name = target LEFT JOIN d ON day = target LEFT JOIN h USING (target)""")
def j6_resolve_targets(spark, sf_dir):
    x = view(spark, sf_dir, TOLD)
    return meetings.resolve_targets(x, x.filter("ord % 3 > 0").select("name", "date", "path"))


# --- merging
STATED = "SELECT CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE n_name END AS commune, CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_orderdate AS DATE) END AS date, CASE WHEN o_orderkey % 4 > 1 THEN concat('p', c_custkey) ELSE '' END AS president, CASE WHEN o_orderkey % 5 > 1 THEN o_orderpriority END AS secretaire, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


@query(f"""WITH s AS (SELECT lower(coalesce(nullif(trim(commune), ''), 'home')) AS commune, date, president, secretaire, o_orderkey FROM ({STATED})), d AS (SELECT * FROM s WHERE date IS NOT NULL),
  c AS (SELECT * FROM d WHERE o_orderkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY commune, date ORDER BY o_orderkey) = 1),
  n AS (SELECT commune, date, arg_min(president, o_orderkey) FILTER (president <> '') AS np, arg_min(secretaire, o_orderkey) FILTER (secretaire <> '') AS ns FROM d WHERE o_orderkey % 2 = 1 GROUP BY ALL)
  SELECT commune, date, coalesce(nullif(president, ''), np, president) AS president, coalesce(secretaire, ns) AS secretaire FROM c FULL JOIN n USING (commune, date) UNION ALL SELECT commune, date, president, secretaire FROM s WHERE date IS NULL AND o_orderkey % 2 = 0""")
def w2_upsert_meetings(spark, sf_dir):
    x = view(spark, sf_dir, STATED)
    now, fields = x.filter("o_orderkey % 2 = 0"), ["president", "secretaire"]
    # the current table has one row per key
    key = F.lower(F.coalesce(F.nullif(F.trim("commune"), F.lit("")), F.lit("home")))
    dated = now.filter("date is not null").withColumn("commune", key).groupBy("commune", "date").agg(F.min_by(F.struct(*fields), "o_orderkey").alias("r")).select("commune", "date", "r.*")
    return merge.upsert_meetings(dated.unionByName(now.filter("date is null").select("commune", "date", *fields)), x.filter("o_orderkey % 2 = 1"), fields, "home", ["o_orderkey"])


@query("SELECT video_id, date, v FROM (SELECT o_orderkey AS video_id, o_orderdate::DATE AS date, CASE WHEN o_orderkey % 4 = 1 THEN 'new' ELSE 'old' END AS v FROM orders) ORDER BY date DESC, video_id")
def s5_replace_sessions(spark, sf_dir):
    x = view(spark, sf_dir, "SELECT o_orderkey AS video_id, CAST(o_orderdate AS DATE) AS date FROM orders")
    return merge.replace_sessions(x.withColumn("v", F.lit("old")), x.filter("video_id % 4 = 1").withColumn("v", F.lit("new")))


@query("SELECT conv_id AS video_id FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'assistant' AND turn > 2) = 0")
def j8_sessions_to_transcribe(spark, sf_dir):
    x = view(spark, sf_dir, "SELECT conv_id AS video_id, turn, CASE WHEN role = 'assistant' AND turn > 2 THEN array(text) ELSE CAST(array() AS array<string>) END AS transcript FROM conversations")
    s = x.groupBy("video_id").agg(F.collect_list(F.struct("turn", "transcript")).alias("points"))
    return meetings.skip_done(s, meetings.transcribed_sessions(s), "video_id").select("video_id")


# --- chapters
DAY = "lpad(CAST(day(o_orderdate) AS VARCHAR(4)), 2, '0'), '/', lpad(CAST(month(o_orderdate) AS VARCHAR(4)), 2, '0'), '/'"
LISTED = f"""SELECT o_orderkey AS ord, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS tab, concat('v', o_custkey) AS id, CASE o_orderkey % 5 WHEN 0 THEN concat('Conseil communal du ', {DAY}, CAST(year(o_orderdate) AS VARCHAR(4)))
  WHEN 1 THEN concat('GEMEENTERAAD van ', {DAY}, CAST(year(o_orderdate) % 100 AS VARCHAR(4)), ' (live)') WHEN 2 THEN concat('Fête du ', {DAY}, CAST(year(o_orderdate) AS VARCHAR(4))) WHEN 3 THEN 'Conseil communal' END AS title FROM orders"""
TITLED = [f"regexp_extract(title, '(\\d{{2}})/(\\d{{2}})/(\\d{{2,4}})', {g})" for g in (1, 2, 3)]
ISO = f"concat(CASE WHEN length({TITLED[2]}) = 2 THEN '20' ELSE '' END, {TITLED[2]}, '-', {TITLED[1]}, '-', {TITLED[0]})"


@query(f"""WITH l AS ({LISTED}), c AS (SELECT *, {ISO} AS date FROM l WHERE regexp_matches(lower(title), 'conseil communal|gemeenteraad') AND regexp_matches(title, '\\d{{2}}/\\d{{2}}/\\d{{2,4}}') QUALIFY row_number() OVER (PARTITION BY id ORDER BY tab, ord) = 1)
  SELECT id, title, date FROM c ORDER BY date DESC, id""")
def p11_s4_council_videos(spark, sf_dir):
    return chapters.list_council_videos(view(spark, sf_dir, LISTED))


CUES = "SELECT conv_id, turn, CASE turn % 8 WHEN 0 THEN 'Début de séance' WHEN 1 THEN 'VOTE du budget' WHEN 2 THEN concat('Comité  secret ', role) WHEN 3 THEN ' <Untitled chapter 3>' WHEN 4 THEN ' ' WHEN 5 THEN 'Finances de la zone' ELSE text END AS title FROM conversations"


@query(f"WITH c AS ({CUES}) SELECT conv_id, turn FROM c WHERE trim(title) <> '' AND NOT contains(lower(title), 'untitled') AND NOT regexp_matches(lower(trim(title)), '^(?:{_either(*chapters.PROCEDURE)})')")
def p12_drop_procedural(spark, sf_dir):
    return chapters.drop_procedural(view(spark, sf_dir, CUES)).select("conv_id", "turn")


CHAPTERED = f"""SELECT c_custkey AS id, concat('vid', c_custkey) AS video_id, c_custkey % 4000 AS start, CASE c_custkey % 8 WHEN 0 THEN concat('La voirie - Demande de Monsieur ', {A.F1}, ' ', {A.L1}, ' - Verzoek van de heer ', {A.L1}) WHEN 1 THEN concat('Le climat (Motion ', {A.F1}, ' ', {A.L1}, ')')
  WHEN 2 THEN concat('Motie over het klimaat – ', {A.F1}, ' ', {A.L1}) WHEN 3 THEN 'Taxe sur les immeubles - Belasting op gebouwen' WHEN 4 THEN 'Approbation du procès-verbal – Goedkeuring van de notulen' WHEN 5 THEN concat('Question de Mme ', {A.L1})
  WHEN 6 THEN concat('Interpellation (', {A.L1}, ')') ELSE concat('Rue ', c_name) END AS title FROM customer"""
PARTS = "regexp_split_to_array(title, '\\s[–-]\\s')"
DUTCH_AT = f"list_position(list_transform({PARTS}, lambda p: regexp_matches(lower(trim(p)), '^(?:{_either(*chapters.DUTCH)})')), true)"
KIND = "CASE WHEN regexp_matches(lower(title), '\\bmoti(?:on|e)\\b') THEN 'motion' " + " ".join("WHEN " + " OR ".join(f"contains(lower(title), '{c}')" for c in cues) + f" THEN '{name}'" for name, cues in chapters.KINDS) + " ELSE 'point' END"
AUTHOR = "coalesce(" + ", ".join("nullif(trim(regexp_extract(title, '" + p.replace("'", "''") + "', 1)), '')" for p in (chapters.BY_ADDRESS, chapters.IN_BRACKETS, chapters.AT_THE_END)) + ")"


@query(f"""WITH c AS ({CHAPTERED}), d AS (SELECT *, {DUTCH_AT} AS nth, {PARTS} AS parts FROM c) SELECT id, title AS titre, coalesce(nullif(trim(array_to_string(CASE WHEN nth IS NULL OR nth = 0 THEN parts ELSE parts[:nth - 1] END, ' - ')), ''), title) AS titre_fr,
  {KIND} AS type, {AUTHOR} AS auteur, start::INTEGER AS start_s, concat('https://www.youtube.com/watch?v=', video_id, '&t=', start, 's') AS deeplink FROM d""")
def f29_chapter_point(spark, sf_dir):
    return view(spark, sf_dir, CHAPTERED).select("id", chapters.chapter_point(F.col("title"), F.col("start"), F.col("video_id")).alias("p")).select("id", "p.*")


DESCRIBED = f"SELECT id, concat('v', id) AS video_id, id % 3 = 0 AS official, title, start, concat('Bienvenue', chr(10), '0:00 Début', chr(10), '1:02:03 ', title, chr(10), ' 59:07  Rue ', CAST(id AS VARCHAR(9)), ' ', chr(10), 'fin') AS description FROM ({CHAPTERED})"


@query(f"WITH d AS ({DESCRIBED}) SELECT video_id, title AS titre, start::INTEGER AS start_s FROM d WHERE official UNION ALL SELECT video_id, unnest([title, concat('Rue ', id)]), unnest([3723, 3547]) FROM d WHERE NOT official")
def f30_chapters_or_description(spark, sf_dir):
    x = view(spark, sf_dir, DESCRIBED)
    told = F.when(F.col("official"), F.array(F.struct(F.lit("Vote").alias("title"), F.lit(1.0).alias("start_time")), F.struct("title", F.col("start").cast("double").alias("start_time"))))
    return chapters.chapters_or_description(x.withColumn("chapters", told)).select("video_id", "titre", "start_s")


@query("SELECT concat('video-', conv_id, '-', min(turn) * 10) AS key, (1 + count(*))::INTEGER AS extracts FROM conversations GROUP BY conv_id")
def a13_chunk_counts(spark, sf_dir):
    x = view(spark, sf_dir, "SELECT * FROM conversations").groupBy(F.col("conv_id").alias("video_id")).agg((F.min("turn") * 10).alias("start_s"), F.collect_list("text").alias("transcript"))
    return chapters.chunk_counts(x)


@query("SELECT count(*) AS sessions, count(*) FILTER (n > 0) AS with_agenda, sum(n)::BIGINT AS chapters FROM (SELECT o_orderkey, count(l_linenumber) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber > 5 GROUP BY 1)")
def a21_chapter_coverage(spark, sf_dir):
    x = view(spark, sf_dir, "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber > 5")
    return chapters.chapter_coverage(x.groupBy("o_orderkey").agg(F.collect_list("l_linenumber").alias("points")))


LINKED_CHAPTERS = f"SELECT id, {AUTHOR} AS auteur, CASE WHEN id % 5 = 0 THEN '' ELSE concat('https://www.youtube.com/watch?v=', video_id, '&t=', start, 's') END AS deeplink FROM ({CHAPTERED})"


@query(f"WITH c AS ({LINKED_CHAPTERS}) SELECT count(*) AS chapters, count(auteur) AS with_author, count(*) FILTER (deeplink = '') AS bad_links FROM c")
def q3_chapter_checks(spark, sf_dir):
    x = view(spark, sf_dir, CHAPTERED).select("id", chapters.chapter_author(F.col("title")).alias("auteur"), chapters.chapter_point(F.col("title"), F.col("start"), F.col("video_id"))["deeplink"].alias("d"))
    return meetings.chapter_checks(x.withColumn("deeplink", F.when(F.col("id") % 5 == 0, "").otherwise(F.col("d"))))


CHAPTERS = "SELECT date, concat(CAST(meeting AS VARCHAR(19)), '-', CAST(sp AS VARCHAR(9)), '-', CAST(partkey AS VARCHAR(19)), '-', CAST(suppkey AS VARCHAR(19))) AS chapter, CASE WHEN suppkey % 3 = 0 THEN titre ELSE concat(titre, ' - Demande de M. ', author) END AS titre, CASE WHEN suppkey % 4 > 0 THEN author END AS author_key FROM ({0}) WHERE type <> 'point'"


@query()
def j4_match_chapters_to_points(spark, sf_dir):
    x = points(spark, sf_dir)
    order = F.struct("meeting", "sp", "partkey", "suppkey")
    p = x.select("date", order.alias("sp"), "titre", F.col("author").alias("author_key"), order.alias("ord"))
    return chapters.match_chapters_to_points(view(spark, sf_dir, CHAPTERS.format(A.POINTS)), p).select("date", "chapter", "sp.*")


# --- people
@query(f"""WITH n AS ({A.NAMES}) SELECT id, CASE id % 8 WHEN 0 THEN concat(f, ' ', upper(l)) WHEN 1 THEN concat(l, ' ', f) WHEN 2 THEN l WHEN 3 THEN concat('Van den ', l, ' ', f) WHEN 4 THEN concat('de ', l) WHEN 5 THEN concat(l, ' et ', f, ' ', l2) WHEN 6 THEN concat('Bourgmestre ', f, ' ', l) ELSE 'Secrétaire communal' END AS name,
  lower(CASE id % 8 WHEN 1 THEN f WHEN 5 THEN l2 WHEN 7 THEN 'communal' ELSE l END) AS key, CASE id % 8 WHEN 0 THEN concat(f, ' ', upper(l)) WHEN 1 THEN concat(l, ' ', f) WHEN 2 THEN l WHEN 3 THEN concat('Van den ', l, ' ', f) WHEN 4 THEN concat('de ', l) WHEN 5 THEN concat(l, '|', f, ' ', l2) WHEN 6 THEN concat(f, ' ', l) ELSE '' END AS people,
  CASE id % 8 WHEN 0 THEN concat(f, ' ', l) WHEN 1 THEN concat(l, ' ', f) WHEN 2 THEN l WHEN 3 THEN concat('Van den ', l, ' ', f) WHEN 4 THEN concat('De ', l) WHEN 5 THEN concat(l, ' Et ', f, ' ', l2) WHEN 6 THEN concat('Bourgmestre ', f, ' ', l) ELSE 'Secrétaire Communal' END AS shown, id % 8 <> 3 OR true AS plausible FROM n""")
def f23_f24_person_names(spark, sf_dir):
    x, raw = view(spark, sf_dir, A.NAMES), F.col("raw")
    name = people.clean_name(raw)
    return x.select("id", name.alias("name"), people.person_key(raw).alias("key"), F.array_join(people.split_person_names(raw), "|").alias("people"), people.title_case_name(name).alias("shown"), people.looks_like_name(name).alias("plausible"))


@query(f"SELECT lower({A.F1}) AS first, lower({A.L1}) AS last FROM customer WHERE c_custkey % 2 = 0")
def f27_name_pairs(spark, sf_dir):
    told = view(spark, sf_dir, f"SELECT CASE c_custkey % 4 WHEN 0 THEN concat('M. ', {A.F1}, ' ', upper({A.L1})) WHEN 2 THEN concat(upper({A.L1}), ' ', {A.F1}) WHEN 1 THEN concat({A.F1}, ' ', {A.L1}) ELSE upper(concat({A.F1}, ' ', {A.L1})) END AS name FROM customer")
    return people.name_pairs(told)


@query(f"SELECT c_custkey, lower(CASE WHEN c_custkey % 2 = 0 THEN {A.L1} ELSE {A.F1} END) AS key FROM customer")
def f24_person_keys(spark, sf_dir):
    pairs = people.name_pairs(view(spark, sf_dir, f"SELECT concat({A.F1}, ' ', upper({A.L1})) AS name FROM customer WHERE c_custkey % 2 = 0"))
    return people.person_keys(view(spark, sf_dir, f"SELECT c_custkey, concat('Mme. ', {A.L1}, ' ', {A.F1}) AS name FROM customer"), pairs).select("c_custkey", "key")


PF, PL, PM = A.first("suppkey"), A.last("suppkey"), A.last("partkey")
ASKED = f"""SELECT {ALL_IDS}, type, {PF} AS f, {PL} AS l, {PM} AS m, CASE sp % 3 WHEN 0 THEN concat('Travaux (Demande de M. ', {PF}, ' ', {PL}, ')') WHEN 1 THEN concat('Motion Mme ', upper({PL}), ' sur la ville') ELSE 'Aménagement. Demande également un plan' END AS titre,
  CASE partkey % 2 WHEN 0 THEN concat('Demande de Monsieur ', {PF}, ' de ', {PM}, ' concernant la voirie') ELSE 'Le conseil débat.' END AS resume, CASE WHEN suppkey % 2 = 0 THEN 'Secrétaire communal' ELSE concat('MM. ', {PL}, ' et ', {PM}) END AS s1, concat({PF}, ' de ', {PM}) AS s2 FROM ({A.POINTS})"""


@query(f"""WITH a AS ({ASKED}), t AS (SELECT *, CASE sp % 3 WHEN 0 THEN concat(f, ' ', l) WHEN 1 THEN upper(l) ELSE CASE WHEN partkey % 2 = 0 THEN concat(f, ' de ', m) END END AS said FROM a)
  SELECT {ALL_IDS}, CASE type WHEN 'question_orale' THEN concat(f, ' de ', m) WHEN 'demande_habitant' THEN coalesce(said, concat(f, ' de ', m)) WHEN 'motion' THEN said END AS author FROM t""")
def f25_point_author(spark, sf_dir):
    return view(spark, sf_dir, ASKED).select(*IDS, people.point_author(F.col("type"), F.col("titre"), F.col("resume"), F.array("s1", "s2")).alias("author"))


ANSWERED = f"""SELECT {ALL_IDS}, {PF} AS f, {PL} AS l, CASE suppkey % 7 WHEN 0 THEN concat({PL}, ' et M. le Bourgmestre') WHEN 1 THEN 'la Bourgmestre ff' WHEN 2 THEN 'Madame la Bourgmestre' WHEN 3 THEN concat('Echevin ', {PF}, ' ', {PL}) WHEN 4 THEN concat('M. ', {PF}, '; Mme. ', {PL}) WHEN 5 THEN 'Secrétaire communal' END AS repondant,
  CASE partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN concat('Mayor ', {PM}) ELSE 'a whole sentence is no name' END AS mayor, CASE WHEN partkey % 2 = 0 THEN concat('Acting ', {PM}) END AS acting FROM ({A.POINTS})"""


@query(f"""WITH a AS ({ANSWERED}), r AS (SELECT *, CASE WHEN coalesce(mayor, acting) LIKE 'a whole%' THEN NULL ELSE coalesce(mayor, acting) END AS chair FROM a)
  SELECT {ALL_IDS}, CASE suppkey % 7 WHEN 0 THEN concat_ws('|', l, chair) WHEN 1 THEN coalesce(acting, '') WHEN 2 THEN coalesce(chair, '') WHEN 3 THEN concat(f, ' ', l) WHEN 4 THEN concat(f, '|', l) ELSE '' END AS people FROM r""")
def f26_respondents(spark, sf_dir):
    return view(spark, sf_dir, ANSWERED).select(*IDS, F.array_join(people.respondents(F.col("repondant"), F.col("mayor"), F.col("acting")), "|").alias("people"))


# --- raw records
MESSY = """SELECT l_orderkey AS a, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN concat(l_linenumber, ' bis') WHEN 2 THEN 'bis' ELSE CAST(l_linenumber AS VARCHAR(9)) END AS sp, CASE l_suppkey % 3 WHEN 0 THEN ' OUI ' WHEN 1 THEN 'non' END AS urgence,
  CASE l_suppkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'motion ' END AS type, concat('  Titre ', chr(10), '  du   point ', l_partkey, ' ') AS titre, CASE l_partkey % 2 WHEN 0 THEN ' ' ELSE concat(' X  ', l_suppkey) END AS repondant, CASE l_suppkey % 5 WHEN 0 THEN '12,7' WHEN 1 THEN 'tous' WHEN 2 THEN ' 9 ' END AS pour,
  CASE WHEN l_suppkey % 2 = 0 THEN '3' END AS contre, concat(l_partkey, '.000,50 € TVAC') AS montant, concat(' A  ', l_suppkey) AS i1, concat('a ', l_suppkey, ' ') AS i2 FROM lineitem"""


@query(f"""WITH m AS ({MESSY}) SELECT a, n, p, s, nullif(regexp_extract(sp, '^\\s*(\\d+)', 1), '')::INTEGER AS sp_num, sp AS sp_raw, coalesce(lower(trim(urgence)) = 'oui', false) AS urgence, CASE WHEN s % 4 = 1 THEN 'motion' ELSE 'point_normal' END AS type, 'Titre du point ' || p AS titre,
  CASE WHEN p % 2 = 1 THEN 'X ' || s END AS repondant, CASE s % 5 WHEN 0 THEN 12 WHEN 2 THEN 9 END AS pour, CASE WHEN s % 2 = 0 THEN 3 ELSE 0 END AS contre, 0 AS abstentions, p * 1000 + 0.5::DOUBLE AS montant_eur, 'A ' || s AS intervenants FROM m WHERE sp IS NOT NULL""")
def f13_normalize_points(spark, sf_dir):
    x, none = view(spark, sf_dir, MESSY), F.lit(None).cast("string")
    raw = x.withColumns({"vote": F.struct(none.alias("type"), "pour", "contre", none.alias("abstentions")), "montant_eur": F.col("montant"), "intervenants": F.array("i1", "i2", F.lit(" ")), "thematiques": F.lit(None).cast("array<string>"), **{c: none for c in ("rubrique", "sous_rubrique", "resume", "decision")}})
    y = normalize.normalize_points(raw)
    return y.select("a", "n", "p", "s", "sp_num", "sp_raw", "urgence", "type", "titre", "repondant", "vote.pour", "vote.contre", "vote.abstentions", "montant_eur", F.array_join("intervenants", "|").alias("intervenants"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_suppkey % 4 WHEN 0 THEN 12 WHEN 1 THEN 7 END AS n, 'b ' || l_partkey AS said, 'b ' || l_partkey || '|c' AS items FROM lineitem")
def f11_clean_values(spark, sf_dir):
    x = view(spark, sf_dir, "SELECT *, CASE l_suppkey % 4 WHEN 0 THEN '12,9' WHEN 1 THEN ' 7' WHEN 2 THEN 'x' END AS v, concat(' b  ', l_partkey, chr(10)) AS t FROM lineitem")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.coerce_int(F.col("v")).alias("n"), text.clean_str(F.col("t")).alias("said"), F.array_join(text.clean_str_list(F.array("t", F.upper("t"), F.lit("c"), F.lit(" "))), "|").alias("items"))


OPENING = f"""SELECT id AS doc, 1 AS page_num, concat('Le Président ouvre en séance publique à ', id % 24, 'h', CASE WHEN id % 2 = 0 THEN '05' ELSE '' END, '. ', f, ' ', l, ', Président du Conseil; ', CASE id % 3 WHEN 0 THEN concat(f, ' ', l2, ', Bourgmestre ff; ') WHEN 1 THEN concat(f, ' ', l2, ' Bourgmestre; ') ELSE '' END,
    'PRÉSENTS-AANWEZIG : M.-h. A, Mme-mevr. B, ', CASE WHEN id % 2 = 0 THEN 'Mmes-mevr. C' ELSE '' END, ' EXCUSÉS : M.-h. D') AS text FROM ({A.NAMES})
  UNION ALL SELECT id, 2, CASE WHEN id % 5 > 0 THEN concat('; ', l, ' ', l2, ' Secrétaire communal. La séance est levée à ', id % 12, 'h30') ELSE 'rien' END FROM ({A.NAMES}) UNION ALL SELECT id, 3, 'La séance publique est levée à 23h59' FROM ({A.NAMES})"""


@query(f"""WITH n AS ({A.NAMES}) SELECT id AS doc, concat(id % 24, ':', CASE WHEN id % 2 = 0 THEN '05' ELSE '00' END) AS heure_ouverture, CASE WHEN id % 5 > 0 THEN concat(id % 12, ':30') END AS heure_cloture, f || ' ' || l AS president, CASE WHEN id % 3 = 0 THEN f || ' ' || l2 END AS bourgmestre_ff,
  CASE WHEN id % 3 = 1 THEN f || ' ' || l2 END AS bourgmestre, CASE WHEN id % 5 > 0 THEN l || ' ' || l2 END AS secretaire_communal, CASE WHEN id % 2 = 0 THEN 3 ELSE 2 END AS presents_count FROM n""")
def f15_meeting_meta(spark, sf_dir):
    return normalize.meeting_meta_from_text(view(spark, sf_dir, OPENING))


REPLIES = f"""SELECT {ALL_IDS}, titre, concat('Voici : ```json', chr(10), '{{"date_seance": "', CAST(date AS VARCHAR(10)), '", "points": [{{"sp": "', CAST(sp AS VARCHAR(9)), '", "titre": "', titre, '"}}, {{"sp": ', CAST(sp + 1 AS VARCHAR(9)), ', "vote": {{"type": "unanimite", "pour": 3}}}}]}}', chr(10), '``` fin') AS raw, date FROM ({A.POINTS})"""


@query(f"WITH r AS ({REPLIES}) SELECT meeting, partkey, suppkey, date::VARCHAR AS date_seance, (sp + d)::VARCHAR AS sp, CASE WHEN d = 0 THEN titre END AS titre, CASE WHEN d = 1 THEN '3' END AS pour FROM r, (SELECT unnest([0, 1]) AS d) WHERE partkey % 5 > 0")
def io6_reply_points(spark, sf_dir):
    x = view(spark, sf_dir, REPLIES).select("meeting", "partkey", "suppkey", F.when(F.col("partkey") % 5 > 0, F.col("raw")).otherwise("no answer").alias("raw"))
    return files.reply_points(x).select("meeting", "partkey", "suppkey", "date_seance", "sp", "titre", "vote.pour")


FLAT = f"SELECT {ALL_IDS}, date, sp AS page, CASE WHEN suppkey % 2 = 0 THEN concat('f', suppkey) ELSE '' END AS source_file, concat('m', meeting) AS meeting_file, type, rubrique, decision, concat(titre, ' ', repeat('x', 190)) AS titre, repeat('y', 299 + suppkey % 3) AS resume, vote_type, montant, author, speaker, tag1, tag2 FROM ({A.POINTS})"


@query(f"""WITH f AS ({FLAT}) SELECT date, sp, page, CASE WHEN source_file <> '' THEN source_file ELSE meeting_file END AS source_file, type, rubrique, NULL::VARCHAR AS sous_rubrique, titre[:200] AS titre, resume[:300] AS resume, decision, vote_type, sp AS vote_pour, NULL::INTEGER AS vote_contre, NULL::INTEGER AS vote_abstentions,
  montant::DOUBLE AS montant_eur, false AS urgence, concat(author, '; ', speaker) AS intervenants, speaker AS repondant, concat(tag1, ', ', tag2) AS thematiques FROM f""")
def io4_flat_points(spark, sf_dir):
    none = F.lit(None).cast("int")
    x = view(spark, sf_dir, FLAT).withColumns({
        "sous_rubrique": F.lit(None).cast("string"), "vote": F.struct(F.col("vote_type").alias("type"), F.col("sp").alias("pour"), none.alias("contre"), none.alias("abstentions")), "montant_eur": F.col("montant").cast("double"), "urgence": F.lit(False),
        "intervenants": F.array("author", "speaker"), "repondant": F.col("speaker"), "thematiques": F.array("tag1", "tag2"),
    })
    return files.flat_points(x)


@query("SELECT conv_id AS video_id, turn * 61.5::DOUBLE AS start_s, trim(role || ' said') AS text FROM conversations")
def io7_parse_vtt(spark, sf_dir):
    x = view(spark, sf_dir, "SELECT conv_id, turn, role FROM conversations")
    at = lambda s: F.format_string("%02d:%02d:%06.3f", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), (s % 60).cast("double"))
    s = F.col("turn") * 61.5
    block = F.concat(at(s), F.lit(" --> "), at(s + 1), F.lit(" align:start\n<c>"), "role", F.lit("</c>\nsaid\n"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", block.alias("b")))), lambda t: t["b"]), "\n")
    return files.parse_vtt(x.groupBy(F.col("conv_id").alias("video_id")).agg(F.concat(F.lit("WEBVTT\n\n"), body).alias("content"))).drop("ord")


@query(CHUNKED + f"SELECT id, 'video_conseil' AS source_type, 'home' AS commune, 0::DOUBLE AS montant_eur FROM r UNION ALL SELECT meeting_id || '_SP' || sp, 'pv', CASE WHEN suppkey % 3 = 0 THEN 'home' ELSE commune END, montant::DOUBLE FROM ({RECORDS})")
def io3_load_chunks_source(spark, sf_dir):
    p = search_points(spark, sf_dir).withColumn("commune", F.when(F.col("suppkey") % 3 == 0, " ").otherwise(F.concat(F.lit(" "), F.upper("commune"))))
    records = p.withColumn("date", F.col("date").cast("string")).unionByName(filmed(spark, sf_dir).withColumn("commune", F.lit("Elsewhere")), allowMissingColumns=True)
    return retrieval.load_chunks_source(records, " Home ").select("id", "source_type", "commune", "montant_eur")


# --- collection
PORTAL = """SELECT page_id, replace(html, '<a href="/', concat('<a class="x click-show-content" data-bk="', CASE page_id % 3 WHEN 0 THEN 'C1' WHEN 1 THEN 'D1' ELSE '' END, '" href="/', CASE page_id % 3 WHEN 2 THEN 'Download?pubKey=P12-ab&x=' ELSE '' END)) AS html FROM pages"""
# a year, a word of navigation and a page's own titles, so that every kind of entry occurs
ENTRIES = f"""SELECT page_id, concat(html, '<A data-bk="C', page_id, '" class=''click-show-content'' href="#"><b>20', lpad(CAST(page_id % 100 AS VARCHAR(9)), 2, '0'), '</b></A><a class="click-show-content" data-bk="C9" href="#"> Annexes </a>') AS html FROM ({PORTAL})"""


@query(f"""WITH p AS ({ENTRIES}), a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)(<a\\s[^>]*>.*?)</a>', 1)) AS a FROM p), t AS (SELECT page_id, regexp_extract(a, '(?is)^(<a\\s[^>]*>)', 1) AS tag, trim(regexp_replace(regexp_replace(regexp_replace(a, '(?is)^<a\\s[^>]*>', ''), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS label FROM a),
  x AS (SELECT page_id, label, regexp_extract(tag, '(?i)\\sdata-bk\\s*=\\s*["'']([^"'']*)["'']', 1) AS bk, regexp_extract(tag, '(?i)\\sclass\\s*=\\s*["'']([^"'']*)["'']', 1) AS c, regexp_extract(tag, '(?i)\\shref\\s*=\\s*["'']([^"'']*)["'']', 1) AS url FROM t),
  e AS (SELECT *, list_contains(regexp_split_to_array(c, '\\s+'), 'click-show-content') AND starts_with(bk, 'C') AS entry FROM x),
  k AS (SELECT *, CASE WHEN entry AND regexp_full_match(label, '20\\d{{2}}') THEN 'year' WHEN entry AND label NOT IN ('Transparence', 'Conseil communal', 'Retour à la liste', 'Annexes') THEN 'meeting' WHEN NOT entry AND contains(lower(url), 'download') AND regexp_matches(url, 'pubKey=(P[0-9a-f-]+)') THEN 'file' END AS kind FROM e)
  SELECT page_id, kind, CASE WHEN kind = 'file' THEN regexp_extract(url, 'pubKey=(P[0-9a-f-]+)', 1) ELSE bk END AS key, label, url FROM k WHERE kind IS NOT NULL""")
def f34_extract_anchors(spark, sf_dir):
    return collect.extract_anchors(view(spark, sf_dir, ENTRIES))


@query(f"""WITH f AS (SELECT pub_key AS meeting, ord, CASE WHEN ord % 5 > 0 THEN date END AS date, concat('Séance ', status) AS titre, concat('P', sha256(ord::VARCHAR)) AS pub_key FROM ({A.FILES})), n AS (SELECT *, row_number() OVER (PARTITION BY meeting ORDER BY ord) - 1 AS i FROM f)
  SELECT meeting, ord, CASE WHEN date IS NOT NULL THEN concat('pv-', date, CASE WHEN i > 0 THEN concat('_', i) ELSE '' END, '.pdf') ELSE concat('pv-', trim(regexp_replace(lower(titre), '[^a-z0-9]+', '-', 'g'), '-')[:40], '-', pub_key[:9], '.pdf') END AS filename FROM n""")
def f35_name_files(spark, sf_dir):
    x = view(spark, sf_dir, A.FILES).select(F.col("pub_key").alias("meeting"), "ord", F.when(F.col("ord") % 5 > 0, F.col("date")).alias("date"), F.concat(F.lit("Séance "), "status").alias("titre"), F.concat(F.lit("P"), F.sha2(F.col("ord").cast("string"), 256)).alias("pub_key"))
    return collect.name_files(x, "pv-").select("meeting", "ord", "filename")


@query(LINKS + """SELECT page_id, url, CASE WHEN contains(split_part(url, '/', -1), '.') THEN replace(regexp_replace(split_part(url, '/', -1), '\\.[^.]*$', ''), '.', '_') || '.' || regexp_extract(split_part(url, '/', -1), '\\.([^.]*)$', 1) ELSE split_part(url, '/', -1) END AS file FROM d
  WHERE x LIKE '%.pdf' AND contains(x, 'town.example') AND (contains(x, 'pv-conseil') OR contains(x, 'pv_conseil') OR contains(x, 'pv conseil') OR contains(x, 'notulen') OR contains(x, 'proces-verbal') OR regexp_matches(x, 'pv[-_. ]*20\\d{2}[-_. ]+\\d{1,2}[-_. ]+\\d{1,2}(?:[-_. ]*sp)?'))""")
def f35_filename_from_url(spark, sf_dir):
    return collect.extract_links(view(spark, sf_dir, A.LINKED), "https://town.example", "town.example").withColumn("file", collect.filename_from_url(F.col("url")))


ANY_TITLE = """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN concat('Séance ', year(o_orderdate) + 20, '.', month(o_orderdate), '.', day(o_orderdate)) WHEN 1 THEN concat(year(o_orderdate) + 20, '-', day(o_orderdate), '-', month(o_orderdate)) WHEN 2 THEN concat(day(o_orderdate), '/', month(o_orderdate), '/', year(o_orderdate) + 20)
  WHEN 3 THEN concat('PV ', month(o_orderdate), '-', day(o_orderdate), '-', year(o_orderdate) + 20) ELSE 'Annexes' END AS title, day(o_orderdate) AS d, month(o_orderdate) AS m, year(o_orderdate) + 20 AS y FROM orders"""


@query(f"""WITH t AS ({ANY_TITLE}) SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 5 IN (0, 2) OR d > 12 THEN concat(y, '-', lpad(m::VARCHAR, 2, '0'), '-', lpad(d::VARCHAR, 2, '0')) ELSE concat(y, '-', lpad(d::VARCHAR, 2, '0'), '-', lpad(m::VARCHAR, 2, '0')) END AS found FROM t""")
def f9_date_from_any_title(spark, sf_dir):
    return view(spark, sf_dir, ANY_TITLE).select("o_orderkey", dates.date_from_any_title(F.col("title")).alias("found"))
