"""Every registered query with its SQL. A query reads the given tables through the views of ``adapters``."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minuteloom.functions import dates, text
from minuteloom.operators import collect, merge, people, retrieval, search, selection, stats, video
from minuteloom.plans import adapters as A

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages conversations labels".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_TABLE = re.compile(r"\b(FROM |JOIN |JOIN \()(" + "|".join(TABLES) + r")\b")
#: The joins of the points' SQL, and the same ones in an order that shuffles the lines once less: customers go to the orders first.
_JOINS = A.POINTS[A.POINTS.index("FROM lineitem l") :]
_FEWER = """FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey
JOIN (orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey) ON l.l_orderkey = o.o_orderkey"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL over the tables of a folder, under names that no caller's view bears."""
    sql = sql.replace(_JOINS, _FEWER)
    for _, t in set(_TABLE.findall(sql)):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"minuteloom_{t}")
    return spark.sql(_TABLE.sub(r"\1minuteloom_\2", sql))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, A.POINTS).withColumn("tags", F.array("tag1", "tag2"))


# --- SQL that several oracles share
CANON = """(CASE WHEN array_to_string(list_transform(string_split(replace(strip_accents(lower({0})), '_', ' '), ' '), lambda w: CASE WHEN length(w) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:length(w)-1] ELSE w END), ' ') = 'enseignement' THEN 'education'
  ELSE array_to_string(list_transform(string_split(replace(strip_accents(lower({0})), '_', ' '), ' '), lambda w: CASE WHEN length(w) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:length(w)-1] ELSE w END), ' ') END)"""
EXCLUDED = f"""(type IN ('motion', 'question_orale', 'demande_habitant') OR regexp_matches(replace(strip_accents(lower(titre)), '.', ''), '({"|".join(stats.EXCLUDED_TITLES)})')
  OR regexp_matches(replace(strip_accents(lower(coalesce(decision, ''))), '.', ''), '{stats.NOTED_DECISIONS}'))"""
P = f"WITH points AS ({A.POINTS}), x AS (SELECT *, {EXCLUDED} AS excluded, CASE WHEN {EXCLUDED} THEN 0 ELSE montant END AS engaged FROM points), t AS (SELECT meeting, date, type, engaged, {CANON.format('tag1')} AS theme FROM x UNION ALL SELECT meeting, date, type, engaged, {CANON.format('tag2')} FROM x) "
VOIRIE = "voirie|chaussee|trottoir|egout|asphalt|pave|refection"
TREND = f"y AS (SELECT * FROM x WHERE regexp_matches(strip_accents(lower(titre || ' ' || rubrique || ' ' || tag1 || ' ' || tag2)), '\\b(?:asphalt|chaussee|egout|pave|refection|trottoir|voirie)') AND NOT excluded) "


@query(P + "SELECT meeting, sp, partkey, suppkey, date, type, titre FROM points")
def p1_flatten_points(spark, sf_dir):
    return points(spark, sf_dir).select("meeting", "sp", "partkey", "suppkey", "date", "type", "titre")


@query(P + "SELECT meeting, sp, partkey, suppkey, excluded, engaged::DOUBLE AS engaged FROM x")
def p2_p3_engaged_amount(spark, sf_dir):
    return stats.with_amounts(points(spark, sf_dir)).select("meeting", "sp", "partkey", "suppkey", "excluded", F.col("engaged").cast("double").alias("engaged"))


@query(P + "SELECT meeting, sp, partkey, suppkey, vote_type IS NOT NULL AND vote_type = 'vote_nominal' AS contested, coalesce(starts_with(lower(trim(decision)), 'report'), false) AS postponed FROM points")
def p4_p9_votes(spark, sf_dir):
    return points(spark, sf_dir).select("meeting", "sp", "partkey", "suppkey", selection.contested_vote(F.col("vote_type")).alias("contested"), selection.is_postponed(F.col("decision")).alias("postponed"))


@query(P + "SELECT meeting, sp, partkey, suppkey FROM x WHERE year(date) = 1998 AND month(date) = 3 AND list_contains([" + CANON.format("tag1") + ", " + CANON.format("tag2") + "], 'promo')")
def p7_scope_filter(spark, sf_dir):
    return selection.scope_filter(points(spark, sf_dir), 1998, 3, theme="promo").select("meeting", "sp", "partkey", "suppkey")


@query(P + "SELECT count(DISTINCT meeting) AS meetings, count(*) AS points, sum(engaged)::DOUBLE AS engaged, count(*) FILTER (vote_type = 'vote_nominal') AS contested FROM x")
def a1_global_stats(spark, sf_dir):
    return stats.global_stats(points(spark, sf_dir))


@query(P + "SELECT year(date)::INTEGER AS year, count(DISTINCT meeting) AS meetings, count(*) AS points FROM x GROUP BY 1")
def a2_activity_by_year(spark, sf_dir):
    return stats.activity_by_year(points(spark, sf_dir))


@query(P + ", g AS (SELECT year(date)::INTEGER AS year, theme, count(*) AS n FROM t GROUP BY GROUPING SETS ((year(date), theme), (theme))), r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, theme)::INTEGER AS place FROM g) SELECT year, theme, n, place FROM r WHERE place <= 12")
def a3_themes_by_year(spark, sf_dir):
    return stats.themes_by_year(points(spark, sf_dir))


@query(P + "SELECT year(date)::INTEGER AS year, string_agg(DISTINCT date::VARCHAR, ',' ORDER BY date::VARCHAR) AS dates FROM x GROUP BY 1")
def a4_dates_by_year(spark, sf_dir):
    return selection.dates_by_year(points(spark, sf_dir)).withColumn("dates", F.array_join("dates", ","))


@query(P + """, b AS (SELECT meeting, date, count(*) AS points, count(*) FILTER (vote_type = 'vote_nominal') AS contested, sum(engaged) AS engaged FROM x GROUP BY ALL),
  c AS (SELECT meeting, theme, count(*) AS n, sum(engaged) AS amount FROM t GROUP BY ALL), d AS (SELECT meeting, string_agg(theme || ':' || n || ':' || amount, '|' ORDER BY n DESC, theme) AS themes FROM c GROUP BY 1)
  SELECT b.meeting, date, points, contested, engaged::DOUBLE AS engaged, themes FROM b LEFT JOIN d USING (meeting)""")
def a5_meeting_summary(spark, sf_dir):
    return stats.meeting_summary(points(spark, sf_dir))


@query(P + "SELECT coalesce(rubrique, '?') AS value, count(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def a6_top_rubrics(spark, sf_dir):
    return stats.value_counts(points(spark, sf_dir), F.col("rubrique"), 10)


@query(P + "SELECT coalesce(decision, '?') AS value, count(*) AS n FROM x GROUP BY 1")
def a6_decisions(spark, sf_dir):
    return stats.value_counts(points(spark, sf_dir), F.col("decision"))


@query(P + ", " + TREND + "SELECT year(date)::VARCHAR AS year, count(*) AS points, count(*) FILTER (montant > 0) AS with_amount, coalesce(sum(montant) FILTER (montant > 0), 0)::DOUBLE AS total FROM y GROUP BY 1")
def a7_theme_trend(spark, sf_dir):
    return stats.theme_trend(points(spark, sf_dir), "voirie")


@query(P + ", " + TREND + "SELECT meeting, sp, partkey, titre, montant::DOUBLE AS montant FROM (SELECT * FROM y WHERE montant > 0 ORDER BY montant DESC, meeting, sp, partkey, suppkey LIMIT 8)")
def k2_top_spend(spark, sf_dir):
    return stats.top_spend(points(spark, sf_dir), "voirie")


@query(P + "SELECT year(date)::INTEGER AS year, month(date)::INTEGER AS month, date, count(*) AS points, count(*) FILTER (vote_type = 'vote_nominal') AS contested, sum(engaged)::DOUBLE AS engaged, grouping(year(date), month(date), date)::INTEGER AS level FROM x GROUP BY ROLLUP (year(date), month(date), date)")
def a8_kpi_rollup(spark, sf_dir):
    return stats.kpi_rollup(points(spark, sf_dir))


@query(P + "SELECT type, count(*) AS n, sum(montant) FILTER (montant > 0)::DOUBLE AS total, max(montant)::DOUBLE AS most, count(*) FILTER (montant > 0) AS mentions FROM x GROUP BY 1")
def a11_corpus_summary(spark, sf_dir):
    return stats.corpus_summary(points(spark, sf_dir))


#: Points with what the pseudo-types ask for: postponed, and a film of the debate.
FACETS = f"""SELECT *, coalesce(lower(trim(decision)) LIKE 'report%', false) AS postponed, partkey % 3 = 0 AND suppkey % 2 = 0 AND NOT coalesce(lower(trim(decision)) LIKE 'report%', false) AS debate FROM ({A.POINTS})"""


def faceted(spark, sf_dir):
    x = points(spark, sf_dir).withColumn("postponed", selection.is_postponed(F.col("decision")))
    url = F.when(F.col("partkey") % 3 == 0, F.concat(F.lit("https://film.example/"), F.col("meeting").cast("string")))
    return x.withColumn("debate", selection.has_debate_link(F.col("type"), F.lit(None).cast("string"), url, F.col("suppkey") % 2 == 0, F.col("postponed")))


@query(f"""WITH x AS ({FACETS}), h AS (SELECT * FROM x WHERE list_contains([{CANON.format("tag1")}, {CANON.format("tag2")}], 'standard')),
  f AS (SELECT 'type' AS facet, unnest(list_filter([type, CASE WHEN postponed THEN 'reporte' END, CASE WHEN debate THEN 'debat_filme' END], lambda v: v IS NOT NULL)) AS value FROM h WHERE author = 'Customer#000000002' OR speaker = 'Customer#000000002'
    UNION ALL SELECT 'theme', unnest(list_distinct([{CANON.format("tag1")}, {CANON.format("tag2")}])) FROM x WHERE type = 'motion' AND (author = 'Customer#000000002' OR speaker = 'Customer#000000002')
    UNION ALL SELECT 'person', unnest([author, speaker]) FROM h WHERE type = 'motion'), n AS (SELECT facet, value, count(*) AS n FROM f GROUP BY ALL
    UNION ALL SELECT 'type', 'motion', 0 UNION ALL SELECT 'theme', 'standard', 0 UNION ALL SELECT 'person', 'Customer#000000002', 0) SELECT facet, value, sum(n)::BIGINT AS n FROM n GROUP BY ALL""")
def a10_facet_counts(spark, sf_dir):
    return stats.facet_counts(faceted(spark, sf_dir), "motion", "standard", "Customer#000000002")


@query(P + "SELECT count(*) FILTER (date IS NULL) AS undated, count(*) FILTER (date IS NULL) AS not_iso, count(*) FILTER (coalesce(trim(titre), '') = '') AS untitled, count(*) FILTER (NOT isfinite(montant::DOUBLE)) AS not_finite, sum(engaged) < 2000000000 AS plausible, min(year(date))::INTEGER AS first_year, max(year(date))::INTEGER AS last_year FROM x")
def q2_corpus_checks(spark, sf_dir):
    return stats.corpus_checks(points(spark, sf_dir))


#: Points some of which lack a title or have an amount out of bounds, or both.
FAULTY = f"SELECT meeting, sp, CASE WHEN partkey % 9 = 0 THEN ' ' ELSE titre END AS titre, CASE WHEN suppkey % 6 = 0 THEN -montant WHEN suppkey % 6 = 1 THEN montant * 100000 ELSE montant END AS montant FROM ({A.POINTS})"


@query(f"""WITH x AS ({FAULTY}) SELECT meeting, sp, 'duplicate' AS issue FROM x QUALIFY row_number() OVER (PARTITION BY meeting, sp) > 1
  UNION ALL SELECT meeting, sp, 'untitled' FROM x WHERE trim(titre) = '' UNION ALL SELECT meeting, sp, 'amount' FROM x WHERE montant < 0 OR montant > 100000000""")
def q1_validate_points(spark, sf_dir):
    return merge.validate_points(view(spark, sf_dir, FAULTY))


COLUMNS = ["titre", "decision", "vote_type", "montant", "type"]
ORDER = ["partkey", "suppkey", "montant", "titre", "shipped"]
SCORE = "(CASE WHEN titre <> '' THEN 1 ELSE 0 END + CASE WHEN decision <> '' THEN 1 ELSE 0 END + CASE WHEN vote_type <> '' THEN 1 ELSE 0 END + CASE WHEN montant <> 0 THEN 1 ELSE 0 END + CASE WHEN type <> '' THEN 1 ELSE 0 END)"


@query(P + f"SELECT meeting, sp, partkey, suppkey, titre FROM points QUALIFY row_number() OVER (PARTITION BY meeting, sp ORDER BY {SCORE} DESC, partkey, suppkey, montant, titre, shipped) = 1")
def w1_dedup_best_filled(spark, sf_dir):
    return merge.dedup_best_filled(points(spark, sf_dir), ["meeting", "sp"], ORDER, COLUMNS).select("meeting", "sp", "partkey", "suppkey", "titre")


@query(P + f"""SELECT meeting, sp, partkey, suppkey FROM points QUALIFY row_number() OVER (PARTITION BY meeting, sp ORDER BY {SCORE} DESC, partkey % 2, partkey, suppkey, montant, titre, shipped) = 1""")
def w2_upsert_points(spark, sf_dir):
    x = points(spark, sf_dir)
    return merge.upsert_points(x.filter("partkey % 2 = 0"), x.filter("partkey % 2 = 1"), ["meeting", "sp"], ORDER, COLUMNS).select("meeting", "sp", "partkey", "suppkey")


AUDIT = P + """, h AS (SELECT DISTINCT meeting, sp FROM points WHERE sp <> 3), e AS (SELECT o_orderkey AS meeting, unnest(range(1, 5))::INTEGER AS sp FROM orders WHERE o_orderkey % 7 > 0),
  j AS (SELECT coalesce(h.meeting, e.meeting) AS meeting, coalesce(h.sp, e.sp) AS sp, (e.sp + 1) // 2 AS page, h.sp IS NOT NULL AS have, e.sp IS NOT NULL AS want FROM h FULL JOIN e ON h.meeting = e.meeting AND h.sp = e.sp),
  audit AS (SELECT meeting, count(*) FILTER (want) AS expected, count(*) FILTER (have) AS extracted, coalesce(string_agg(sp::VARCHAR, ',' ORDER BY sp) FILTER (NOT have), '') AS missing, coalesce(string_agg(sp::VARCHAR, ',' ORDER BY sp) FILTER (NOT want), '') AS extra,
    coalesce(array_to_string(list_sort(list_distinct(list(page) FILTER (NOT have))), ','), '') AS missing_pages, count(*) FILTER (NOT have) = 0 AS ok, count(*) FILTER (NOT have) AS lacks,
    CASE WHEN count(*) FILTER (want) = 0 THEN 'file_not_found' WHEN count(*) FILTER (NOT have) > 0 THEN 'incomplete' ELSE 'ok' END AS status FROM j GROUP BY 1) """


def audited(spark, sf_dir):
    expected = view(spark, sf_dir, "SELECT o_orderkey AS meeting, explode(sequence(1, 4)) AS sp FROM orders WHERE o_orderkey % 7 > 0").withColumn("page", F.expr("(sp + 1) div 2"))
    return merge.audit_completeness(points(spark, sf_dir).filter("sp <> 3"), expected)


def as_texts(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


@query(AUDIT + "SELECT * EXCLUDE (lacks) FROM audit")
def s1_audit_completeness(spark, sf_dir):
    return as_texts(audited(spark, sf_dir), "missing", "extra", "missing_pages")


@query(AUDIT + "SELECT sum(expected)::BIGINT AS expected, sum(extracted)::BIGINT AS extracted, count(*) FILTER (NOT ok) AS incomplete FROM audit")
def a12_completeness_report(spark, sf_dir):
    return merge.completeness_report(audited(spark, sf_dir))


@query(AUDIT + "SELECT meeting, expected, extracted, missing FROM audit WHERE NOT ok ORDER BY lacks DESC, meeting")
def a12_incomplete_meetings(spark, sf_dir):
    return as_texts(merge.incomplete_meetings(audited(spark, sf_dir)), "missing")


@query(AUDIT + "SELECT meeting, missing FROM audit WHERE lacks >= 2")
def s7_reextract_targets(spark, sf_dir):
    return as_texts(selection.reextract_targets(audited(spark, sf_dir), 2), "missing").select("meeting", "missing")


@query(P + """, n AS (SELECT meeting, count(*) AS n_points FROM points WHERE sp > 2 GROUP BY 1), c AS (SELECT meeting, count(*) AS have FROM points WHERE sp <= 2 AND meeting % 3 > 0 GROUP BY 1)
  SELECT n.meeting, n_points, have IS NULL AS is_new, coalesce(have, 0) AS existing_points FROM n LEFT JOIN c USING (meeting)""")
def j9_preview_merge(spark, sf_dir):
    x = points(spark, sf_dir)
    return merge.preview_merge(x.filter("sp > 2"), x.filter("sp <= 2 and meeting % 3 > 0"))


@query("SELECT * FROM (SELECT o_orderkey, o_custkey, 'new' AS v FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_custkey, 'old' FROM orders WHERE o_orderkey % 3 <> 0)")
def s6_upsert_chunks(spark, sf_dir):
    x = view(spark, sf_dir, "SELECT o_orderkey, o_custkey FROM orders")
    return merge.replace_by_key(x.withColumn("v", F.lit("old")), x.filter("o_orderkey % 3 = 0").withColumn("v", F.lit("new")), "o_orderkey").select("o_orderkey", "o_custkey", "v")


CALENDAR = """c AS (SELECT DISTINCT (last_day(m) - ((dayofweek(last_day(m)) + 4) % 7)::INTEGER)::DATE AS date FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 MONTH))::DATE AS m) WHERE month(m) NOT IN (7, 8))"""


@query(f"WITH {CALENDAR} SELECT date, count(o_orderkey) AS files FROM c LEFT JOIN orders ON o_orderdate::DATE = date GROUP BY 1")
def f36_meeting_calendar(spark, sf_dir):
    c = dates.meeting_calendar(spark, "1995-01-01", "2001-12-31")
    o = view(spark, sf_dir, "SELECT CAST(o_orderdate AS DATE) AS d, o_orderkey FROM orders")
    return c.join(o, F.col("date") == F.col("d"), "left").groupBy("date").agg(F.count("o_orderkey").alias("files"))


@query(f"WITH {CALENDAR} SELECT date FROM c WHERE date NOT IN (SELECT o_orderdate::DATE FROM orders WHERE o_orderkey % 2 = 0)")
def j7_missing_meetings(spark, sf_dir):
    return merge.missing_meetings(dates.meeting_calendar(spark, "1995-01-01", "2001-12-31"), view(spark, sf_dir, "SELECT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderkey % 2 = 0"))


@query("SELECT doc_id, md5(strip_accents(text)) AS plain FROM documents")
def f1_strip_accents(spark, sf_dir):
    return view(spark, sf_dir, "SELECT * FROM documents").select("doc_id", F.md5(text.strip_accents(F.col("text"))).alias("plain"))


@query(P + "SELECT tag1 AS tag, theme, upper(theme[1]) || theme[2:] AS label FROM (SELECT DISTINCT tag1, " + CANON.format("tag1") + " AS theme FROM points)")
def f2_f3_canon_theme(spark, sf_dir):
    return points(spark, sf_dir).select(F.col("tag1").alias("tag")).distinct().select("tag", text.canon_theme(F.col("tag")).alias("theme"), text.theme_label(F.col("tag")).alias("label"))


YEARS = f"""WITH q AS ({A.QUESTIONS}), a AS (SELECT question, strip_accents(lower(text)) AS s, list_filter(list_transform(regexp_extract_all(text, '\\b(20[0-3]\\d)\\b', 1), lambda y: y::INTEGER), lambda y: y <= 2035) AS ys FROM q),
  b AS (SELECT *, nullif(regexp_extract(s, '{dates.BETWEEN.replace("'", "''")}', 1), '')::INTEGER AS x, nullif(regexp_extract(s, '{dates.BETWEEN.replace("'", "''")}', 2), '')::INTEGER AS y,
    nullif(regexp_extract(s, '{dates.FROM.replace("'", "''")}', 1), '')::INTEGER AS f, nullif(regexp_extract(s, '{dates.UNTIL.replace("'", "''")}', 1), '')::INTEGER AS u, regexp_matches(s, '{dates.FINANCE}')::INTEGER AS w FROM a),
  r AS (SELECT question, CASE WHEN len(ys) = 0 THEN NULL WHEN x IS NOT NULL THEN least(x, y) WHEN len(list_distinct(ys)) > 1 THEN list_min(ys) WHEN f IS NOT NULL THEN f WHEN u IS NOT NULL THEN NULL ELSE ys[1] - w END AS lo,
    CASE WHEN len(ys) = 0 THEN NULL WHEN x IS NOT NULL THEN greatest(x, y) WHEN len(list_distinct(ys)) > 1 THEN list_max(ys) WHEN f IS NOT NULL THEN NULL WHEN u IS NOT NULL THEN u ELSE ys[1] + w END AS hi FROM b)
  SELECT question, lo, hi, CASE WHEN lo = hi THEN 'en ' || lo WHEN lo IS NOT NULL AND hi IS NOT NULL THEN 'entre ' || lo || ' et ' || hi WHEN lo IS NOT NULL THEN 'depuis ' || lo WHEN hi IS NOT NULL THEN 'avant ' || hi ELSE 'pour la période demandée' END AS label FROM r"""


@query(YEARS)
def f5_f6_year_filter(spark, sf_dir):
    x = view(spark, sf_dir, A.QUESTIONS).select("question", dates.year_filter(F.col("text")).alias("y")).select("question", "y.lo", "y.hi")
    return x.withColumn("label", dates.describe_years(F.col("lo"), F.col("hi")))


def _try_date(p: str, y: int, m: int, d: int) -> str:
    part = lambda g: f"regexp_extract(name, '{p}', {g})"
    return f"try_cast({part(y)} || '-' || lpad({part(m)}, 2, '0') || '-' || lpad({part(d)}, 2, '0') AS DATE)"


NAME_DATE = f"coalesce({_try_date(r'(20\d{2})[._\-](\d{1,2})[._\-](\d{1,2})', 1, 2, 3)}, {_try_date(r'(20\d{2})(\d{2})(\d{2})', 1, 2, 3)}, {_try_date(r'(\d{2})(\d{2})(20\d{2})', 3, 2, 1)})"


@query(f"WITH f AS ({A.FILES}) SELECT ord, {NAME_DATE} AS found, 'PV-' || coalesce({NAME_DATE}::VARCHAR, name) AS id FROM f")
def f7_date_from_filename(spark, sf_dir):
    return view(spark, sf_dir, A.FILES).select("ord", dates.date_from_filename(F.col("name")).alias("found"), dates.meeting_id(F.col("name")).alias("id"))


@query("SELECT o_orderkey, o_orderdate::DATE + 7300 AS found FROM orders")
def f8_date_from_text(spark, sf_dir):
    x = view(spark, sf_dir, "SELECT o_orderkey, date_add(CAST(o_orderdate AS DATE), 7300) AS d FROM orders")
    names = lambda m: F.element_at(F.array(*map(F.lit, m)), F.month("d"))
    fr = F.concat(F.lit("Extrait\nSÉANCE  DU"), F.day("d").cast("string"), F.lit(" "), F.upper(names(dates.MONTHS_FR)), F.lit(" "), F.year("d").cast("string"))
    nl = F.concat(F.lit("Vergadering van "), F.day("d").cast("string"), F.lit(" "), names(dates.MONTHS_NL), F.lit(" "), F.year("d").cast("string"))
    digits = F.concat(F.lit("séance publique du "), F.date_format("d", "d/M/yyyy"))
    said = F.when(F.col("o_orderkey") % 3 == 0, fr).when(F.col("o_orderkey") % 3 == 1, nl).otherwise(digits)
    return x.select("o_orderkey", dates.date_from_text(said).alias("found"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS of_title, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS of_url FROM orders")
def f9_f10_dates_of_names(spark, sf_dir):
    x = view(spark, sf_dir, "SELECT o_orderkey, o_orderdate AS d FROM orders")
    title = F.concat(F.lit("Conseil communal "), F.date_format("d", "dd/MM/yyyy"))
    url = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/x/pv-conseil-"), F.date_format("d", "yyyy.MM.dd"), F.lit(".pdf"))).otherwise("/x/pv.pdf")
    return x.select("o_orderkey", dates.date_from_title(title).alias("of_title"), dates.date_from_url(url).alias("of_url"))


@query(f"""WITH a AS ({A.AMOUNTS}) SELECT a, b, try_cast(replace(regexp_replace(regexp_extract(raw, '\\d[\\d.\\s]*(?:,\\d+)?'), '[\\s.]', '', 'g'), ',', '.') AS DOUBLE) AS amount,
  coalesce(lower(trim(flag)) IN ('1', 'true', 'vrai', 'oui', 'yes'), false) AS flag, regexp_extract(sp, '^\\s*(\\d+)', 1)::INTEGER AS sp FROM a""")
def f11_f12_coercions(spark, sf_dir):
    x = view(spark, sf_dir, A.AMOUNTS)
    return x.select("a", "b", text.coerce_amount(F.col("raw")).alias("amount"), text.coerce_bool(F.col("flag")).alias("flag"), text.coerce_sp(F.col("sp")).alias("sp"))


@query(P + """SELECT meeting, sp, partkey, suppkey, CASE vote_type WHEN 'unanimite' THEN 'approuvé à l''unanimité' WHEN 'vote_nominal' THEN concat(sp, ' pour, ', suppkey % 3, ' contre, 0 abstentions') WHEN 'reporte' THEN 'point reporté' ELSE 'vote non précisé' END AS vote FROM points""")
def f18_format_vote(spark, sf_dir):
    x = points(spark, sf_dir)
    return x.select("meeting", "sp", "partkey", "suppkey", retrieval.format_vote(F.col("vote_type"), F.col("sp"), F.col("suppkey") % 3, F.lit(None).cast("int")).alias("vote"))


#: Points as search records want them, with files, summaries and speakers.
RECORDS = f"""SELECT concat('PV-', CAST(date AS VARCHAR(10)), '-', CAST(meeting AS VARCHAR(19))) AS meeting_id, commune, date, sp, titre, concat('résumé de ', titre) AS resume, rubrique, CASE WHEN sp > 3 THEN tag2 END AS sous_rubrique, decision, type, vote_type,
  CASE vote_type WHEN 'unanimite' THEN 'approuvé à l''unanimité' WHEN 'reporte' THEN 'point reporté' ELSE 'vote non précisé' END AS vote, montant, CASE WHEN suppkey % 2 = 0 THEN speaker END AS s1, CASE WHEN suppkey % 4 = 0 THEN author END AS s2,
  CASE WHEN partkey % 3 = 0 THEN author END AS repondant, tag1, tag2, partkey, suppkey FROM ({A.POINTS})"""


def search_points(spark, sf_dir):
    x = view(spark, sf_dir, RECORDS)
    kept = F.filter(F.array("s1", "s2"), lambda s: s.isNotNull())
    return x.withColumns({"intervenants": kept, "tags": F.array("tag1", "tag2")})


CAPITAL = "(CASE commune WHEN 'middle east' THEN 'Middle East' ELSE upper(commune[1]) || commune[2:] END)"
POINT_TEXT = f"""concat(titre, chr(10) || chr(10) || 'Séance du Conseil communal de ', {CAPITAL}, ' du ', date, ' — Point SP ', sp, '.' || chr(10) || 'Résumé : ', resume, chr(10) || 'Rubrique : ', rubrique, ' / ', coalesce(sous_rubrique, ''),
  chr(10) || 'Décision : ', coalesce(decision, ''), chr(10) || 'Vote : ', vote, CASE WHEN montant <> 0 THEN concat(chr(10) || 'Montant : ', replace(format('{{:,}}', round_even(montant, 0)::BIGINT), ',', ' '), ' €') ELSE '' END,
  CASE WHEN s1 IS NOT NULL OR s2 IS NOT NULL THEN chr(10) || 'Intervenants : ' || concat_ws(', ', s1, s2) ELSE '' END, CASE WHEN repondant IS NOT NULL THEN chr(10) || 'Répondant : ' || repondant ELSE '' END, chr(10) || 'Thématiques : ', tag1, ', ', tag2)"""


@query(f"""WITH r AS ({RECORDS}) SELECT meeting_id || '_SP' || sp AS id, md5({POINT_TEXT}) AS chunk_text, year(date)::INTEGER AS year, sp, titre, coalesce(decision, '') AS decision, type, montant::DOUBLE AS montant_eur, coalesce(vote_type, '') AS vote_type, commune FROM r""")
def f19_point_chunks(spark, sf_dir):
    x = retrieval.point_chunks(search_points(spark, sf_dir)).withColumn("chunk_text", F.md5("chunk_text"))
    return x.select("id", "chunk_text", "year", "sp", "titre", "decision", "type", "montant_eur", "vote_type", "commune")


@query("SELECT conv_id, turn, greatest(1, length(text) // 3)::INTEGER AS tokens, 'video-' || conv_id || '-' || turn AS key, 'https://www.youtube.com/watch?v=' || conv_id || '&t=' || turn || 's' AS url FROM conversations")
def f21_f22_keys(spark, sf_dir):
    x = view(spark, sf_dir, "SELECT conv_id, turn, text, concat('video-', conv_id, '-', turn, CASE WHEN turn > 0 THEN '-t7' ELSE '' END) AS id FROM conversations")
    x = x.select("conv_id", "turn", retrieval.estimate_tokens(F.col("text")).alias("tokens"), retrieval.point_key(F.col("id")).alias("key"))
    return x.withColumn("url", retrieval.point_video_url(F.col("key")))


@query(f"WITH s AS ({A.CHAPTERS}) SELECT video_id, chapter, start_s, lead(start_s) OVER (PARTITION BY video_id ORDER BY start_s, chapter) AS next_start FROM s")
def w7_chapter_bounds(spark, sf_dir):
    return video.chapter_bounds(view(spark, sf_dir, A.CHAPTERS))


ALIGNED = f"""WITH c AS (SELECT *, lead(start_s) OVER (PARTITION BY video_id ORDER BY start_s, chapter) AS hi FROM ({A.CHAPTERS})), s AS ({A.SEGMENTS}),
  j AS (SELECT s.video_id, segment, t, text, chapter, start_s AS chapter_start FROM s JOIN c ON s.video_id = c.video_id AND t >= start_s AND (hi IS NULL OR t < hi)) """


@query(ALIGNED + "SELECT video_id, segment, t, chapter, chapter_start FROM j")
def j3_align_transcript(spark, sf_dir):
    return video.align_transcript(view(spark, sf_dir, A.CHAPTERS), view(spark, sf_dir, A.SEGMENTS))


@query(ALIGNED + "SELECT video_id, chapter, string_agg(text, ' ' ORDER BY t, segment)[:1200] AS excerpt FROM j GROUP BY ALL")
def a20_chapter_excerpts(spark, sf_dir):
    s = view(spark, sf_dir, A.SEGMENTS)
    return video.chapter_excerpts(video.align_transcript(view(spark, sf_dir, A.CHAPTERS), s).join(s.select("segment", "text"), "segment"))


@query(f"SELECT video_id, ord, text FROM ({A.CAPTIONS}) QUALIFY row_number() OVER (PARTITION BY video_id, text ORDER BY ord) = 1")
def w4_dedup_captions(spark, sf_dir):
    return video.dedup_captions(view(spark, sf_dir, A.CAPTIONS).select("video_id", "ord", "text"))


@query(f"""WITH RECURSIVE s AS (SELECT chapter, ord, start_s, text, length(text) + 1 AS n, row_number() OVER (PARTITION BY chapter ORDER BY ord) AS k FROM ({A.CAPTIONS})),
  r AS (SELECT chapter, k, n AS held, 0 AS part FROM s WHERE k = 1 UNION ALL SELECT s.chapter, s.k, CASE WHEN held + n > 1500 THEN n ELSE held + n END, CASE WHEN held + n > 1500 THEN part + 1 ELSE part END FROM r JOIN s ON s.chapter = r.chapter AND s.k = r.k + 1)
  SELECT chapter, part, min(start_s) AS start_s, string_agg(text, ' ' ORDER BY s.ord) AS text FROM r JOIN s USING (chapter, k) GROUP BY ALL""")
def w10_pack_segments(spark, sf_dir):
    return video.pack_segments(view(spark, sf_dir, A.CAPTIONS).select("chapter", "ord", "start_s", "text"))


@query(f"WITH f AS ({A.FILES}) SELECT pub_key, ord FROM f QUALIFY row_number() OVER (PARTITION BY pub_key ORDER BY is_fr DESC, CASE WHEN is_fr THEN -ord ELSE ord END) = 1")
def w5_dedup_files(spark, sf_dir):
    return collect.dedup_files(view(spark, sf_dir, A.FILES)).select("pub_key", "ord")


@query(f"WITH f AS ({A.FILES}) SELECT status, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM f GROUP BY 1")
def a16_manifest_summary(spark, sf_dir):
    return collect.manifest_summary(view(spark, sf_dir, A.FILES))


LINKS = f"""WITH h AS ({A.LINKED}), u AS (SELECT page_id, unnest(list_concat(list_concat(regexp_extract_all(html, '(?i)href=["'']([^"'']*\\.pdf)["'']', 1), regexp_extract_all(html, '(?i)src=["'']([^"'']*\\.pdf)["'']', 1)),
    list_concat(list_concat(regexp_extract_all(html, '(?i)"url"\\s*:\\s*"([^"]*\\.pdf)"', 1), regexp_extract_all(html, '(?i)''url''\\s*:\\s*''([^'']*\\.pdf)''', 1)), regexp_extract_all(html, '(?i)data-[a-z-]+=["'']([^"'']*\\.pdf)["'']', 1)))) AS u FROM h),
  l AS (SELECT DISTINCT page_id, CASE WHEN u LIKE 'http%' THEN u WHEN u LIKE '//%' THEN 'https:' || u WHEN u LIKE '/%' THEN 'https://town.example' || u END AS url FROM u), d AS (SELECT *, lower(url_decode(url)) AS x FROM l) """


@query(LINKS + """SELECT page_id, url FROM d WHERE x LIKE '%.pdf' AND contains(x, 'town.example') AND (contains(x, 'pv-conseil') OR contains(x, 'pv_conseil') OR contains(x, 'pv conseil') OR contains(x, 'notulen')
  OR contains(x, 'proces-verbal') OR regexp_matches(x, 'pv[-_. ]*20\\d{2}[-_. ]+\\d{1,2}[-_. ]+\\d{1,2}(?:[-_. ]*sp)?'))""")
def f33_extract_links(spark, sf_dir):
    return collect.extract_links(view(spark, sf_dir, A.LINKED), "https://town.example", "town.example")


@query("SELECT o_orderkey, o_orderkey % 4 < 3 AS minutes, CASE o_orderkey % 4 WHEN 0 THEN 'pv-conseil-2020_01_02.pdf' WHEN 1 THEN 'Notulen%202020.PDF' WHEN 2 THEN 'pv-2010-1-5-sp.pdf' ELSE 'agenda' END AS file FROM orders")
def p10_f35_minutes_links(spark, sf_dir):
    u = F.element_at(F.array(*map(F.lit, ("https://town.example/a/pv-conseil-2020.01.02.pdf", "https://town.example/a/Notulen%202020.PDF", "https://town.example/pv-2010-1-5-sp.pdf", "https://town.example/agenda"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    x = view(spark, sf_dir, "SELECT o_orderkey FROM orders").withColumn("u", u)
    return x.select("o_orderkey", collect.is_minutes_pdf(F.col("u"), "town.example").alias("minutes"), collect.filename_from_url(F.col("u")).alias("file"))


@query("SELECT DISTINCT replace(replace(t, '{date}', d), '{n}', n::VARCHAR) AS url FROM (SELECT DISTINCT o_orderdate::DATE::VARCHAR AS d FROM orders), (SELECT unnest(['/pv-{date}_{n}.pdf', '/pv-{date}.pdf']) AS t), (SELECT unnest(range(0, 4)) AS n)")
def f37_candidate_urls(spark, sf_dir):
    return collect.candidate_urls(view(spark, sf_dir, "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders"), ["/pv-{date}_{n}.pdf", "/pv-{date}.pdf"])


SEARCH = f"""WITH c AS ({A.CHUNKS}), q AS ({A.ASKED}), s AS (SELECT question, in_scope, id, list_cosine_similarity(vector::DOUBLE[], q_vector::DOUBLE[]) AS exact, round(exact, 6) AS score, round(exact, 10) AS whole
  FROM c JOIN q ON coalesce(lo, 0) <= year AND coalesce(hi, 9999) >= year AND (q_commune IS NULL OR q_commune = commune)), r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY whole DESC, id)::INTEGER AS rank FROM s) """


def searched(spark, sf_dir, k):
    q = view(spark, sf_dir, A.ASKED)
    return search.vector_search(q, view(spark, sf_dir, A.CHUNKS), k), q.select("question", "in_scope")


@query(SEARCH + "SELECT question, id, score, rank FROM r WHERE rank <= 10")
def j12_k1_vector_search(spark, sf_dir):
    return searched(spark, sf_dir, 10)[0]


@query(SEARCH + ", h AS (SELECT *, id // 3 AS point FROM r WHERE rank <= 30 AND score >= 0.05), b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY question, point ORDER BY score DESC, id) = 1) SELECT question, id, score, row_number() OVER (PARTITION BY question ORDER BY score DESC, id)::INTEGER AS place FROM b QUALIFY place <= 8")
def w3_dedup_sources(spark, sf_dir):
    hits = searched(spark, sf_dir, 30)[0].withColumn("point", F.floor(F.col("id") / 3).cast("string"))
    return retrieval.dedup_sources(hits, 8, 0.05).select("question", "id", "score", "place")


@query(SEARCH + ", e AS (SELECT question, in_scope, max(score) AS top1, avg(score) AS top5 FROM r WHERE rank <= 5 GROUP BY ALL) SELECT in_scope, count(*) AS n, min(top1) AS least, median(top1) AS median, max(top1) AS most, round(avg(top5), 6) AS mean_top5 FROM e GROUP BY 1")
def a14_score_bands(spark, sf_dir):
    hits, scope = searched(spark, sf_dir, 20)
    return retrieval.score_bands(hits.join(scope, "question"))


@query(SEARCH + """, h AS (SELECT * FROM r WHERE rank <= 20), g AS (SELECT round(min(score), 3) AS lo, max(score) AS hi, greatest(0.01, round((max(score) - min(score)) / 12, 3)) AS step FROM h),
  t AS (SELECT round(lo + i * step, 3) AS threshold FROM g, (SELECT unnest(range(0, 300)) AS i) WHERE round(lo + i * step, 3) <= hi),
  k AS (SELECT threshold, question, in_scope, count(*) FILTER (score >= threshold) AS kept FROM h, t GROUP BY ALL) SELECT threshold, round(avg(kept) FILTER (in_scope), 6) AS mean_kept, count(*) FILTER (NOT in_scope AND kept > 0) AS off_topic FROM k GROUP BY 1""")
def a15_retention_by_threshold(spark, sf_dir):
    hits, scope = searched(spark, sf_dir, 20)
    return retrieval.retention_by_threshold(hits.join(scope, "question"), retrieval.threshold_grid(hits))


@query(SEARCH + "SELECT question, string_agg(id::VARCHAR, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM r WHERE rank <= 5 GROUP BY 1")
def f40_build_context(spark, sf_dir):
    return retrieval.build_context(searched(spark, sf_dir, 5)[0].withColumn("chunk_text", F.col("id").cast("string")), 5)


@query(SEARCH + ", t AS (SELECT question, in_scope, max(score) AS top FROM r WHERE rank <= 20 GROUP BY ALL), g AS (SELECT max(top) FILTER (NOT in_scope) AS off_topic, min(top) FILTER (in_scope) AS lo FROM t) SELECT off_topic, lo AS in_scope, coalesce(lo > off_topic, false) AS gap, CASE WHEN lo > off_topic THEN round((off_topic + lo) / 2, 6) END AS threshold FROM g")
def a14_score_gap(spark, sf_dir):
    hits, scope = searched(spark, sf_dir, 20)
    return retrieval.score_gap(hits.join(scope, "question"))


@query("""SELECT batch, count(*) AS records, sum(tokens)::BIGINT AS tokens, round(sum(tokens) * 60 / 130000, 3) AS pause_s FROM (SELECT floor((row_number() OVER (ORDER BY doc_id) - 1) / 60)::BIGINT AS batch, greatest(1, length(text) // 3) AS tokens FROM documents) GROUP BY 1""")
def w9_batch_plan(spark, sf_dir):
    return retrieval.batch_plan(view(spark, sf_dir, "SELECT doc_id AS id, text AS chunk_text FROM documents"))


def deposits_and_answers(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What an author puts forward, and every point that a speaker answers; both with the person as key."""
    return x.filter("type <> 'point'").withColumnRenamed("author", "key"), x.withColumnRenamed("speaker", "key")


@query(P + """, d AS (SELECT author AS key, count(*) FILTER (type = 'question_orale') AS questions, count(*) FILTER (type = 'demande_habitant') AS requests, count(*) FILTER (type = 'motion') AS motions, count(*) FILTER (type = 'video') AS videos, count(*) AS deposits FROM points WHERE type <> 'point' GROUP BY 1),
  a AS (SELECT speaker AS key, count(*) AS answers FROM points GROUP BY 1), j AS (SELECT key, coalesce(questions, 0) AS questions, coalesce(requests, 0) AS requests, coalesce(motions, 0) AS motions, coalesce(videos, 0) AS videos, coalesce(deposits, 0) AS deposits, coalesce(answers, 0) AS answers FROM d FULL JOIN a USING (key))
  SELECT *, CASE WHEN (answers > 0 AND deposits = 0) OR (answers >= 8 AND answers > deposits) THEN 'college' ELSE 'councillor' END AS role FROM j WHERE deposits + answers >= 2""")
def a9_a18_person_activity(spark, sf_dir):
    return people.person_activity(*deposits_and_answers(points(spark, sf_dir)))
