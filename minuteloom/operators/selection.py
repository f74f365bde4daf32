"""Choosing points, meetings, files and records: predicates, scopes, facets, unions and links by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minuteloom.functions.dates import date_from_filename
from minuteloom.functions.text import canon_theme

POSTPONED, DEBATE = "reporte", "debat_filme"


def contested_vote(vote_type: Column) -> Column:
    return F.coalesce(vote_type == "vote_nominal", F.lit(False))


def is_postponed(decision: Column) -> Column:
    return F.coalesce(F.lower(F.trim(decision)).startswith("report"), F.lit(False))


def has_debate_link(kind: Column, url: Column, video_url: Column, precise: Column, postponed: Column) -> Column:
    """A film's own row with an address, or a point with a precise link that was not postponed."""
    there = lambda c: F.coalesce(c != "", F.lit(False))
    return (F.coalesce(kind == "video", F.lit(False)) & there(url)) | (there(video_url) & F.coalesce(precise, F.lit(False)) & ~postponed)


def filter_years(chunks: DataFrame, years: list[int], column: str = "year") -> DataFrame:
    """The records of some years; on a table partitioned by year the others are not read."""
    return chunks.filter(F.col(column).isin([int(y) for y in years]))


def filter_by_filename_year(files: DataFrame, year: int, name: str = "name") -> DataFrame:
    """Files whose name bears a date of the year; undated ones go (``undated_files`` counts them)."""
    return files.filter(F.year(date_from_filename(F.col(name))) == year)


def undated_files(files: DataFrame, name: str = "name") -> DataFrame:
    """One row: files, and those whose name bears no date."""
    return files.agg(F.count("*").alias("files"), F.count_if(date_from_filename(F.col(name)).isNull()).alias("undated"))


def scope_filter(points: DataFrame, year: int | None = None, month: int | None = None, date: str | None = None, theme: str | None = None) -> DataFrame:
    """The points of a year, of a month of it, of one date, and with a theme in canonical form. Dates are compared as ranges,
    which reach the scan; a month needs its year."""
    x = points
    if date is not None:
        x = x.filter(F.col("date") == F.lit(date).cast("date"))
    elif year is not None:
        first = f"{year}-{month or 1:02d}-01"
        end = f"{year + 1}-01-01" if month in (None, 12) else f"{year}-{month + 1:02d}-01"
        x = x.filter((F.col("date") >= F.lit(first).cast("date")) & (F.col("date") < F.lit(end).cast("date")))
    return x if theme is None else x.filter(F.exists("tags", lambda t: canon_theme(t) == F.lit(theme)))


def matches_type(kind: str | None) -> Column:
    """kind: a type, a pseudo-type (``reporte``, ``debat_filme``; the columns postponed and debate) or None for all."""
    return F.lit(True) if kind is None else F.col("postponed") if kind == POSTPONED else F.col("debate") if kind == DEBATE else F.coalesce(F.col("type") == kind, F.lit(False))


def matches_theme_tag(theme: str | None) -> Column:
    return F.lit(True) if theme is None else F.coalesce(F.exists("tags", lambda t: canon_theme(t) == F.lit(theme)), F.lit(False))


def matches_person(person: str | None) -> Column:
    """Author or respondent."""
    return F.lit(True) if person is None else F.coalesce(F.col("author") == person, F.lit(False)) | F.coalesce(F.col("speaker") == person, F.lit(False))


def point_facet_filter(points: DataFrame, kind: str | None = None, theme: str | None = None, person: str | None = None) -> DataFrame:
    return points.filter(matches_type(kind) & matches_theme_tag(theme) & matches_person(person))


def clamp(value: Column, default: float, lo: float, hi: float, kind: str) -> Column:
    """``value`` within lo to hi; null and what is no number: the default."""
    x = value.cast("string").try_cast("double")
    x = F.when(~F.isnan(x), x)
    held = F.greatest(F.lit(lo), F.least(F.lit(hi), F.floor(x) if kind == "int" else x))
    return F.when(x.isNull(), default).otherwise(held).cast(kind)


def clamp_options(requests: DataFrame, top_k: int, max_sources: int, score_min: float) -> DataFrame:
    """Requests with their options held in bounds; the arguments are the defaults."""
    o = (("top_k", top_k, 5, 50, "int"), ("max_sources", max_sources, 1, 30, "int"), ("score_min", score_min, 0.0, 0.95, "double"))
    return requests.withColumns({n: clamp(F.col(n), d, lo, hi, t) for n, d, lo, hi, t in o})


def dates_by_year(points: DataFrame) -> DataFrame:
    """(year, dates): the distinct dates of each year in order; undated points have no year and an empty list."""
    return points.groupBy(F.year("date").alias("year")).agg(F.sort_array(F.collect_set("date")).alias("dates"))


def corpus_meta(points: DataFrame) -> DataFrame:
    """One row: the dates covered, in order, and the number of points."""
    return points.agg(F.sort_array(F.collect_set("date")).alias("dates"), F.count("*").alias("points"))


def by_date(rows: DataFrame, url: str, last: bool = True) -> DataFrame:
    """(date, url): the address of the last (or first) row of each date by ord; null dates and addresses take no part."""
    pick = F.max_by if last else F.min_by
    return rows.filter(F.col("date").isNotNull() & F.col(url).isNotNull()).groupBy("date").agg(pick(url, "ord").alias(url))


def attach_links(rows: DataFrame, meetings: DataFrame, sessions: DataFrame) -> DataFrame:
    """``rows`` with url, the minutes of their date (the last meeting's), and video_url, its film. meetings: date, url, ord;
    sessions: date, video_url, ord. Both sides have a row per date, so a date's rows are never multiplied."""
    return rows.join(by_date(meetings, "url"), "date", "left").join(by_date(sessions, "video_url"), "date", "left")


def all_meetings(meetings: DataFrame, sessions: DataFrame) -> DataFrame:
    """(date, n_points, url, video_url): the minutes, and films of dates without minutes; newest first. Undated ones go."""
    films = by_date(sessions, "video_url")
    told = meetings.filter("date is not null").select("date", "n_points", "url").join(films, "date", "left")
    rest = sessions.filter("date is not null").join(meetings.select("date").distinct(), "date", "left_anti").withColumnRenamed("video_url", "_own").join(films, "date", "left")
    rest = rest.select("date", "n_points", F.lit(None).cast("string").alias("url"), F.coalesce(F.nullif("_own", F.lit("")), "video_url").alias("video_url"))
    return told.unionByName(rest).orderBy(F.desc("date"))


def expected_dates(generated: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Distinct dates of both, in order."""
    return generated.select("date").union(confirmed.select("date")).filter("date is not null").distinct().orderBy("date")


def collected_links(*sources: DataFrame) -> DataFrame:
    """Distinct addresses of all ways in which links are found."""
    out = sources[0].select("url")
    for s in sources[1:]:
        out = out.union(s.select("url"))
    return out.filter("url is not null").distinct()


def reextract_targets(audit: DataFrame, least: int = 1) -> DataFrame:
    """Meetings that lack ``least`` numbers or more; missing: an array."""
    return audit.filter(F.size("missing") >= least)


def stale_chunks(index: DataFrame, version: int) -> DataFrame:
    """Records written under an older shape, or none."""
    return index.filter(F.coalesce(F.col("schema_version"), F.lit(0)) < version)


def commune_from_path(path: Column, known: list[str], default: str) -> Column:
    """The first folder of a path that is a known municipality."""
    return F.coalesce(F.get(F.filter(F.split(F.lower(path), "/"), lambda p: p.isin(known)), F.lit(0)), F.lit(default))


def prefixed_id(meeting_id: Column, commune: Column) -> Column:
    own = F.coalesce(F.nullif(meeting_id, F.lit("")), F.lit("PV"))
    return F.when(F.startswith(own, commune), own).otherwise(F.concat(commune, F.lit("-"), own))


def content_key(text: Column) -> Column:
    """The first 20 hexadecimal digits of the SHA-256 of a text; null counts as empty."""
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 20)
