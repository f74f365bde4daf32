"""Search records, what is done with the hits of a search, and what is measured about its scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minuteloom.operators.quantiles import exact_median

SCHEMA_VERSION = 2
VIDEO = "video_conseil"
# fixed values: names of the kinds of chapters
KIND_LABELS = {
    "demande": "Demande", "motion": "Motion", "question": "Question", "interpellation": "Interpellation", "prise_acte": "Prise d'acte", "approbation": "Approbation", "taxe": "Taxe", "reglement": "Règlement",
}
ANY_KIND = "Point à l'ordre du jour"
ASKED = ("demande", "question", "motion", "interpellation")


def format_vote(kind: Column, pour: Column, contre: Column, abst: Column) -> Column:
    # fixed values: wording of votes
    return (
        F.when(kind == "unanimite", "approuvé à l'unanimité")
        .when(kind == "vote_nominal", F.format_string("%s pour, %d contre, %d abstentions", F.coalesce(pour.cast("string"), F.lit("?")), F.coalesce(contre, F.lit(0)), F.coalesce(abst, F.lit(0))))
        .when(kind == "reporte", "point reporté").otherwise("vote non précisé")
    )


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 3)).cast("int")


def point_key(chunk_id: Column) -> Column:
    return F.regexp_replace(chunk_id, r"-t\d+$", "")


def point_video_url(key: Column, base: str = "https://www.youtube.com/watch?v=") -> Column:
    p = r"^video-(.+)-(\d+)$"
    return F.when(key.rlike(p), F.concat(F.lit(base), F.regexp_extract(key, p, 1), F.lit("&t="), F.regexp_extract(key, p, 2), F.lit("s")))


def _or(column: str, text: str = "") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(text))


def point_chunks(points: DataFrame) -> DataFrame:
    """Search records of points: id, the text that is searched (title first), and what filters and shows them.

    points: meeting_id, commune, date, sp, titre, resume, rubrique, sous_rubrique, decision, type, vote_type, vote (in words),
    montant, intervenants, repondant, tags. Nulls are empty, year and sp 0 where there is none; amounts of 0, no speakers and
    no respondent leave their line out."""
    paid = F.coalesce("montant", F.lit(0)) != 0
    line = lambda there, *c: F.when(there, F.concat(*c)).otherwise("")
    speakers = F.coalesce("intervenants", F.array().cast("array<string>"))
    number = F.when(F.col("sp").cast("string").rlike(r"^\d{1,9}$"), F.col("sp").cast("int")).otherwise(0)
    text = F.concat(
        _or("titre"), F.lit("\n\nSéance du Conseil communal de "), F.initcap("commune"), F.lit(" du "), _or("date", "date inconnue"), F.lit(" — Point SP "), _or("sp", "?"), F.lit(".\nRésumé : "), _or("resume"),
        F.lit("\nRubrique : "), _or("rubrique"), F.lit(" / "), _or("sous_rubrique"), F.lit("\nDécision : "), _or("decision"), F.lit("\nVote : "), _or("vote", "vote non précisé"),
        line(paid, F.lit("\nMontant : "), F.translate(F.format_number(F.bround("montant", 0), 0), ",", " "), F.lit(" €")),
        line(F.size(speakers) > 0, F.lit("\nIntervenants : "), F.array_join(speakers, ", ")), line(_or("repondant") != "", F.lit("\nRépondant : "), _or("repondant")),
        F.lit("\nThématiques : "), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", "),
    )
    return points.select(
        F.concat(_or("meeting_id", "PV"), F.lit("_SP"), _or("sp", "?")).alias("id"), text.alias("chunk_text"), "commune", _or("date", "date inconnue").alias("date"), F.coalesce(F.year("date"), F.lit(0)).alias("year"), number.alias("sp"),
        _or("rubrique").alias("rubrique"), F.substring(_or("titre"), 1, 500).alias("titre"), _or("decision").alias("decision"), _or("type").alias("type"), F.coalesce(F.col("montant").cast("double"), F.lit(0.0)).alias("montant_eur"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("thematiques"), _or("vote_type").alias("vote_type"), F.lit("pv").alias("source_type"), F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit("").alias("auteur"), F.lit("").alias("video_id"), F.lit("").alias("url"), F.lit(None).cast("int").alias("start_s"),
    )


def video_chunks(chapters: DataFrame) -> DataFrame:
    """A title record for each chapter and one for each part of its transcript that isn't blank, with links to their seconds.

    chapters: commune, date, video_id, titre, type, auteur, start_s, deeplink, transcript. Nulls are empty, a missing start 0."""
    start, kind = F.coalesce("start_s", F.lit(0)).cast("int"), _or("type", "point")
    label = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in KIND_LABELS.items() for x in kv)), kind), F.lit(ANY_KIND))
    by = F.when((F.trim(_or("auteur")) != "") & kind.isin(*ASKED), F.concat(F.lit(" à la demande de "), F.trim(_or("auteur")))).otherwise("")
    x = chapters.select(
        F.concat(F.lit("video-"), F.coalesce(F.nullif(F.col("video_id"), F.lit("")), F.lit("x")), F.lit("-"), start.cast("string")).alias("key"), "commune", _or("date", "date inconnue").alias("date"),
        F.coalesce(F.year(F.col("date").cast("string").try_cast("date")), F.lit(0)).alias("year"), F.trim(_or("titre")).alias("t"), kind.alias("type"), label.alias("label"), by.alias("by"), F.trim(_or("auteur")).alias("auteur"),
        _or("video_id").alias("video_id"), _or("deeplink").alias("deeplink"), start.alias("start_s"), "transcript",
    )
    decision = F.concat("label", F.when(F.col("auteur") != "", F.concat(F.lit(" · "), "auteur")).otherwise(""))
    place = F.concat(F.lit("Conseil communal de "), F.initcap("commune"), F.lit(" du "), "date")

    def records(df: DataFrame, rid: Column, text: Column, url: Column, at: Column) -> DataFrame:
        return df.select(
            rid.alias("id"), text.alias("chunk_text"), "commune", "date", "year", F.lit(0).alias("sp"), F.lit("").alias("rubrique"), F.substring("t", 1, 500).alias("titre"), decision.alias("decision"), "type", F.lit(0.0).alias("montant_eur"),
            F.array().cast("array<string>").alias("thematiques"), F.lit("").alias("vote_type"), F.lit(VIDEO).alias("source_type"), F.lit(SCHEMA_VERSION).alias("schema_version"), "auteur", "video_id", url.alias("url"), at.alias("start_s"),
        )

    title = F.concat(place, F.lit(" — point débattu en séance (vidéo).\nTitre : "), "t", F.lit("\nType : "), "label", "by", F.lit("."))
    parts = x.withColumn("p", F.explode("transcript")).withColumn("said", F.trim("p.text")).filter("said <> ''").withColumn("at", F.coalesce("p.start_s", F.lit(0)).cast("int"))
    extract = F.concat(place, F.lit(" — extrait du débat filmé.\nPoint : "), "t", F.lit(" ("), "label", "by", F.lit(").\nExtrait : "), "said")
    link = F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id", F.lit("&t="), F.col("at").cast("string"), F.lit("s"))
    return records(x, F.col("key"), title, F.col("deeplink"), F.col("start_s")).unionByName(records(parts, F.concat("key", F.lit("-t"), F.col("at").cast("string")), extract, link, F.col("at")))


def load_chunks_source(records: DataFrame, default_commune: str) -> DataFrame:
    """Search records of a table that mixes minutes and films; a film's record bears a video_id. Minutes keep their own
    municipality, films take the default; both trimmed and in lower case."""
    film = F.coalesce(F.col("video_id") != "", F.lit(False))
    default = F.lower(F.trim(F.lit(default_commune)))
    own = F.coalesce(F.nullif(F.lower(F.trim("commune")), F.lit("")), default)
    return point_chunks(records.filter(~film).withColumn("commune", own)).unionByName(video_chunks(records.filter(film).withColumn("commune", default)))


def dedup_sources(hits: DataFrame, most: int, least: float = 0.0) -> DataFrame:
    """Per question the best passage of each point, of those with a score of ``least`` or more, the first ``most``; an empty
    point is never merged. Where the answer found nothing (a column not_found), only films stay."""
    x = hits.filter(F.col("score") >= least)
    if "not_found" in hits.columns:
        x = x.filter(~F.coalesce("not_found", F.lit(False)) | (F.col("source_type") == VIDEO))
    key = F.when(F.col("point") != "", F.concat(F.lit("p"), "point")).otherwise(F.concat(F.lit("i"), F.col("id").cast("string")))
    best = F.row_number().over(Window.partitionBy("question", key).orderBy(F.desc("score"), "id"))
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "id"))
    return x.withColumn("_b", best).filter("_b = 1").drop("_b").withColumn("place", place).filter(F.col("place") <= most)


def build_context(hits: DataFrame, k: int) -> DataFrame:
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_text"))), lambda h: h["chunk_text"]), "\n---\n")
    return hits.filter(F.col("rank") <= k).groupBy("question").agg(text.alias("context"))


def score_bands(scores: DataFrame) -> DataFrame:
    """Per class: number of questions, and least, median and most of their best scores and of their means of the best five."""
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "id"))
    each = scores.withColumn("p", place).filter("p <= 5").groupBy("question", "in_scope").agg(F.max("score").alias("top1"), F.avg("score").alias("top5"))
    bands = each.groupBy("in_scope").agg(F.count("*").alias("n"), F.min("top1").alias("least"), F.max("top1").alias("most"), F.round(F.avg("top5"), 6).alias("mean_top5"))
    middle = exact_median(each, ["in_scope"], "top1").withColumnRenamed("in_scope", "_scope")
    return bands.join(middle, F.col("in_scope").eqNullSafe(F.col("_scope")), "left").select("in_scope", "n", "least", "median", "most", "mean_top5")


def retention_by_threshold(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each threshold: passages kept for each question in scope, and questions out of scope that still keep one."""
    kept = scores.groupBy("question", "in_scope").agg(*(F.count_if(F.col("score") >= t).alias(f"k{i}") for i, t in enumerate(thresholds)))
    sums = kept.agg(*(F.round(F.avg(F.when(F.col("in_scope"), F.col(f"k{i}"))), 6).alias(f"m{i}") for i in range(len(thresholds))), *(F.count_if(~F.col("in_scope") & (F.col(f"k{i}") > 0)).alias(f"o{i}") for i in range(len(thresholds))))
    rows = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"m{i}").alias("mean_kept"), F.col(f"o{i}").alias("off_topic")) for i, t in enumerate(thresholds)))
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def score_gap(scores: DataFrame) -> DataFrame:
    """One row: the highest best score out of scope, the lowest in scope, whether they leave a gap, and its middle as threshold."""
    top = scores.groupBy("question", "in_scope").agg(F.max("score").alias("top"))
    x = top.agg(F.max(F.when(~F.col("in_scope"), F.col("top"))).alias("off_topic"), F.min(F.when(F.col("in_scope"), F.col("top"))).alias("in_scope"))
    gap = F.coalesce(F.col("in_scope") > F.col("off_topic"), F.lit(False))
    return x.select("off_topic", "in_scope", gap.alias("gap"), F.when(gap, F.round((F.col("off_topic") + F.col("in_scope")) / 2, 6)).alias("threshold"))


def threshold_grid(scores: DataFrame) -> list[float]:
    """Steps of a twelfth of the scores' range (0.01 at least) from the lowest to the highest, three digits each."""
    lo, hi = scores.agg(F.min("score"), F.max("score")).first()
    if lo is None:
        return []
    step, at, out = max(0.01, round((hi - lo) / 12, 3)), round(lo, 3), []
    while at <= hi:
        out.append(at)
        at = round(at + step, 3)
    return out


def batch_plan(chunks: DataFrame, size: int = 60, tokens_a_minute: int = 130_000) -> DataFrame:
    """Batches of ``size`` records by order of id, with their estimated tokens and the least pause that keeps to the rate.

    Records are counted between fixed boundaries of the id, so no task sees all of them, and neither a rerun nor a
    merge of partitions changes a number. Records of one id and text are in the order of their texts."""
    x = chunks.select("id", estimate_tokens(F.col("chunk_text")).alias("tokens"), F.xxhash64("chunk_text").alias("h"))
    bounds = x.agg(F.percentile_approx("id", [i / 64 for i in range(1, 64)], 10_000)).first()[0] or []
    bounds = F.array(*map(F.lit, sorted(set(bounds)))) if bounds else F.array().cast("array<long>")
    x = x.withColumn("part", F.size(F.filter(bounds, lambda b: b < F.col("id"))))
    x = x.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("id", "h")))
    counts = x.groupBy("part").agg(F.count("*").alias("c"))  # 64 rows
    base = counts.withColumn("base", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")
    out = x.join(F.broadcast(base), "part").groupBy(F.floor((F.col("base") + F.col("n") - 1) / size).alias("batch")).agg(F.count("*").alias("records"), F.sum("tokens").alias("tokens"))
    return out.withColumn("pause_s", F.round(F.col("tokens") * 60 / F.lit(tokens_a_minute), 3))
