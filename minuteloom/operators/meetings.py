"""Views of meetings, points and sources: reading order, links to films and files, wording of decisions, anchors, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minuteloom.functions.text import strip_accents

# fixed values: wording of decisions
DECISIONS = {
    "approuve": "Approuvé", "decide": "Décidé", "debat": "Débat", "reporte": "Reporté", "prend acte": "Pris acte", "prendre acte": "Pris acte",
    "prend pour information": "Pris pour information", "prendre pour information": "Pris pour information", "prends pour information": "Pris pour information",
    "prises pour information": "Pris pour information", "arrete": "Arrêté", "nomme": "Nommé", "admet": "Admis", "beslist": "Décidé", "minute de silence": "Minute de silence",
}
VIDEO = "video_conseil"


def decision_summary(decision: Column, vote: Column, pour: Column, contre: Column, abst: Column) -> Column:
    """The decision in words with its vote; null where the decision is null or blank."""
    d = F.trim(decision)
    known = F.element_at(F.create_map(*(F.lit(x) for kv in DECISIONS.items() for x in kv)), strip_accents(F.lower(d)))
    label = F.coalesce(known, F.concat(F.upper(d.substr(1, 1)), F.lower(F.substr(d, F.lit(2)))))
    no, away = F.coalesce(contre, F.lit(0)), F.coalesce(abst, F.lit(0))
    count = F.concat_ws(", ", F.concat(pour.cast("string"), F.lit(" pour")), F.concat(no.cast("string"), F.lit(" contre")), F.concat(away.cast("string"), F.when(away == 1, " abstention").otherwise(" abstentions")))
    said = F.when(vote == "unanimite", F.concat(label, F.lit(" à l'unanimité"))).when(vote == "vote_nominal", F.concat(label, F.lit(" ("), count, F.lit(")"))).otherwise(label)
    return F.when(d != "", said)


def sort_points(points: DataFrame, *ties: str) -> DataFrame:
    """``place`` within each meeting: whole numbers first in order, then numbers that are text; null last; ``ties`` decide the rest."""
    num = F.when(F.trim("sp_raw").rlike(r"^\d{1,9}$"), F.trim("sp_raw").cast("int"))
    by = Window.partitionBy("meeting").orderBy(num.isNull(), num, F.col("sp_raw").asc_nulls_last(), *ties)
    return points.withColumn("place", F.row_number().over(by))


def year_view(points: DataFrame, year: int) -> DataFrame:
    """All points of a year, the newest meeting first, then by number. The range of dates reaches the scan."""
    return points.filter((F.col("date") >= f"{year}-01-01") & (F.col("date") < f"{year + 1}-01-01")).orderBy(F.desc("date"), "sp")


def meetings_by_year(summary: DataFrame, theme: str | None = None) -> DataFrame:
    """Meetings (with a theme among their ``themes``, if one is given), newest year and date first, with the number of
    meetings of their year; undated ones last."""
    x = (summary if theme is None else summary.filter(F.array_contains("themes", theme))).withColumn("year", F.year("date"))
    n = x.groupBy("year").agg(F.count("*").alias("in_year")).withColumnRenamed("year", "_y")
    return x.join(n, F.col("year").eqNullSafe(F.col("_y"))).drop("_y").orderBy(F.desc_nulls_last("year"), F.desc_nulls_last("date"))


def order_sources(sources: DataFrame) -> DataFrame:
    """``place`` within each question: films by score, then minutes by date, newest first, and number."""
    film = F.col("source_type") == VIDEO
    by = Window.partitionBy("question").orderBy(F.when(film, 0).otherwise(1), F.desc(F.when(film, F.col("score"))), F.desc_nulls_last("date"), F.coalesce("sp", F.lit(0)), "id")
    return sources.withColumn("place", F.row_number().over(by))


def links_newest_first(links: DataFrame) -> DataFrame:
    """Links by date, newest first; undated last."""
    return links.orderBy(F.desc_nulls_last("date"), "url")


def merge_video_links(points: DataFrame, chapters: DataFrame) -> DataFrame:
    """Points with the deep link of the last chapter that matched them, and chapters that matched none as rows of type ``video``.

    ``chapters``: ord, deeplink, titre, meeting, sp (null: matched none). Empty links don't count."""
    mine = chapters.filter("sp is not null and deeplink <> ''").groupBy("meeting", "sp").agg(F.max_by("deeplink", "ord").alias("video_url"))
    linked = points.select("meeting", "sp", "titre", "type").join(mine, ["meeting", "sp"], "left").withColumn("video_precise", F.col("video_url").isNotNull())
    rest = chapters.filter("sp is null").select("meeting", "sp", "titre", F.lit("video").alias("type"), F.col("deeplink").alias("video_url"), F.lit(True).alias("video_precise"))
    return linked.unionByName(rest)


def source_file_lookup(meetings: DataFrame, files: DataFrame) -> DataFrame:
    """Each meeting's file: that of its name, else the first in name order of its date, else null. A meeting may know its file
    by name without ``.pdf``."""
    stem = lambda c: F.regexp_replace(c, r"(?i)\.pdf$", "")
    named = files.groupBy(stem(F.col("name")).alias("_stem")).agg(F.min_by("path", F.struct("name", "path")).alias("by_name"))
    dated = files.filter("date is not null").groupBy("date").agg(F.min_by("path", F.struct("name", "path")).alias("by_date"))
    x = meetings.withColumn("_stem", stem(F.col("source_file"))).join(named, "_stem", "left").join(dated, "date", "left")
    return x.withColumn("path", F.coalesce("by_name", "by_date")).drop("by_name", "by_date", "_stem")


def _grams(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))))


def resolve_targets(targets: DataFrame, files: DataFrame) -> DataFrame:
    """(target, path): the file that a target names; else the first by name of the date that it is (as ISO text); else the first
    whose name holds it; else null. Equal targets have one row; a null or empty one names nothing.

    A part of a name is looked up by its rarest three letters (or all, of a shorter one), so that no target meets every file."""
    t = targets.select("target").distinct()
    named = files.groupBy("name").agg(F.min("path").alias("by_name"))
    dated = files.filter("date is not null").groupBy(F.col("date").cast("string").alias("day")).agg(F.min_by("path", F.struct("name", "path")).alias("by_date"))
    x = t.join(named, F.col("target") == F.col("name"), "left").join(dated, F.col("target") == F.col("day"), "left").select("target", F.coalesce("by_name", "by_date").alias("found"))
    open_ = x.filter("found is null and target <> ''").select("target", F.least(F.length("target"), F.lit(3)).alias("n"))
    pick = lambda c: F.when(F.col("n") == 3, _grams(c, 3)).when(F.col("n") == 2, _grams(c, 2)).otherwise(_grams(c, 1))
    names = files.select("name", "path", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n")).join(F.broadcast(open_.select("n").distinct()), "n")  # three rows at most
    held = names.select("name", "path", F.explode(pick(F.col("name"))).alias("gram"))
    asked = open_.select("target", F.explode(pick(F.col("target"))).alias("gram")).join(held.groupBy("gram").agg(F.count("*").alias("files")), "gram")
    rarest = asked.groupBy("target").agg(F.min_by("gram", F.struct("files", "gram")).alias("gram"))
    part = rarest.join(held, "gram").filter(F.contains("name", "target")).groupBy("target").agg(F.min_by("path", F.struct("name", "path")).alias("by_part"))
    return x.join(part, "target", "left").select("target", F.coalesce("found", "by_part").alias("path"))


def skip_done(files: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Files not processed yet; a null key was never processed."""
    return files.join(done.select(key), key, "left_anti")


def transcribed_sessions(sessions: DataFrame) -> DataFrame:
    """(video_id): sessions of which a chapter has a transcript that isn't empty; ``skip_done`` leaves the others."""
    said = F.exists("points", lambda p: F.coalesce(F.size(p["transcript"]) > 0, F.lit(False)))
    return sessions.filter(F.coalesce(said, F.lit(False))).select("video_id").distinct()


def sp_anchors(pages: DataFrame) -> DataFrame:
    """(doc, sp, page_num): every point number that the text of a page announces, with its first page."""
    n = pages.select("doc", "page_num", F.explode(F.expr(r"regexp_extract_all(text, '(?i)SP\\s*(\\d{1,9})\\s*\\.-', 1)")).alias("sp"))
    return n.groupBy("doc", F.col("sp").cast("int").alias("sp")).agg(F.min("page_num").alias("page_num"))


def fix_point_page(page: Column, lo: Column, hi: Column) -> Column:
    """The page named in ``page`` where it lies in the group lo to hi, else the group's first."""
    p = F.regexp_extract(F.coalesce(page.cast("string"), F.lit("")), r"\d{1,9}", 0).try_cast("int")
    return F.when(p.between(lo, hi), p).otherwise(lo)


def useful_pages(pages: DataFrame, least: int = 100) -> DataFrame:
    """Pages of more than ``least`` characters; null texts go."""
    return pages.filter(F.length("text") > least)


def page_chunks(pages: DataFrame, size: int = 8) -> DataFrame:
    """(doc, page_group, first_page, last_page, page_num, text): runs of ``size`` pages that follow each other in a document."""
    run = Window.partitionBy("doc").orderBy("page_num", "text")
    x = pages.select("doc", "page_num", "text", F.floor((F.row_number().over(run) - 1) / size).alias("page_group"))
    each = Window.partitionBy("doc", "page_group")
    return x.select("doc", "page_group", F.min("page_num").over(each).alias("first_page"), F.max("page_num").over(each).alias("last_page"), "page_num", "text")


def extraction_prompts(pages: DataFrame, size: int = 8, useful: int = 100, least: int = 50) -> DataFrame:
    """(doc, page_group, first_page, last_page, prompt): the useful pages of a document in runs of ``size``, each as one text."""
    mark = F.concat(F.lit("[Page "), F.col("page_num").cast("string"), F.lit("]\n"), F.col("text"))
    x = page_chunks(useful_pages(pages, useful), size).filter(F.length("text") > least)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_num", mark.alias("said")))), lambda p: p["said"]), "\n\n---PAGE---\n\n")
    return x.groupBy("doc", "page_group", "first_page", "last_page").agg(text.alias("prompt"))


def video_id_from(url: Column) -> Column:
    """The id of a film from its address in any usual form, or the trimmed text where it is none."""
    found = F.regexp_extract(url, r"(?:v=|youtu\.be/|/live/|/shorts/)([A-Za-z0-9_-]{11})", 1)
    return F.when(found != "", found).otherwise(F.trim(url))


def video_checks(sessions: DataFrame) -> DataFrame:
    """Sessions whose date or address is malformed; null counts as malformed."""
    bad = lambda c, p: F.count_if(~F.coalesce(F.col(c).rlike(p), F.lit(False)))
    return sessions.agg(F.count("*").alias("sessions"), bad("date", r"^\d{4}-\d{2}-\d{2}$").alias("bad_dates"), bad("video_url", r"^https://www\.youtube\.com/watch\?v=[\w-]{11}$").alias("bad_urls"))


def chapter_checks(chapters: DataFrame) -> DataFrame:
    """Chapters, those with an author, and those whose deep link is no film's."""
    link = F.coalesce(F.col("deeplink").rlike(r"^https://www\.youtube\.com/watch\?v=.+&t=\d+s$"), F.lit(False))
    return chapters.agg(F.count("*").alias("chapters"), F.count_if(F.coalesce(F.col("auteur") != "", F.lit(False))).alias("with_author"), F.count_if(~link).alias("bad_links"))
