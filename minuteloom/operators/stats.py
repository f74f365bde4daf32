"""Statistics over agenda points: amounts, years, themes, meetings, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minuteloom.functions.text import canon_theme, matches_theme, strip_accents
from minuteloom.operators.selection import DEBATE, POSTPONED, by_date, matches_person, matches_theme_tag, matches_type

# fixed values: kinds of points, titles and decisions whose amount is no spending of the municipality
SKIPPED_TYPES = ("motion", "question_orale", "demande_habitant")
EXCLUDED_TITLES = (
    r"modification budgetaire|douzieme[s]? provisoire|comptes? (annuels|communaux)",
    r"compte.{0,25}exercice|comptes \d{4}|comptes de l",
    r"budget.{0,25}(exercice|ordinaire|extraordinaire|\d{4}|general|initial|participatif)",
    r"dotation.{0,25}(police|cpas|zone)",
    r"garantie communale|avance.{0,15}tresorerie|provision.{0,15}(pour|risque)",
    r"eandis|sibelga|interfin|intercommunale|modification.{0,15}statuts",
    r"(affaire|aff)\s*c/|recours|contentieux|affaires juridiques",
)
NOTED_DECISIONS = r"prend (pour information|acte|connaissance)|pour information|prend note|constate"


#: Parts that meetings are dealt in, so that one holds few of them at any size.
PARTS = 200


def is_excluded_amount(kind: Column, title: Column, decision: Column) -> Column:
    plain = lambda c: F.regexp_replace(strip_accents(F.lower(F.coalesce(c, F.lit("")))), r"\.", "")
    return F.coalesce(kind.isin(*SKIPPED_TYPES), F.lit(False)) | plain(title).rlike("(" + "|".join(EXCLUDED_TITLES) + ")") | plain(decision).rlike(NOTED_DECISIONS)


def with_amounts(points: DataFrame) -> DataFrame:
    """Adds excluded and engaged: the amount, or 0 where it is null, 0 or excluded."""
    x = points.withColumn("excluded", is_excluded_amount(F.col("type"), F.col("titre"), F.col("decision")))
    return x.withColumn("engaged", F.when(~F.col("excluded"), F.coalesce("montant", F.lit(0))).otherwise(F.lit(0)).cast("decimal(18,2)"))


def global_stats(points: DataFrame) -> DataFrame:
    return with_amounts(points).agg(
        F.countDistinct("meeting").alias("meetings"), F.count("*").alias("points"), F.sum("engaged").cast("double").alias("engaged"), F.count_if(F.col("vote_type") == "vote_nominal").alias("contested")
    )


def activity_by_year(points: DataFrame) -> DataFrame:
    return points.filter("date is not null").groupBy(F.year("date").alias("year")).agg(F.countDistinct("meeting").alias("meetings"), F.count("*").alias("points"))


def themes_by_year(points: DataFrame, n: int = 12) -> DataFrame:
    """The n commonest themes of each year and of all (year null); ties by name."""
    each = points.select(F.year("date").alias("year"), F.explode("tags").alias("tag")).groupBy("year", "tag").agg(F.count("*").alias("n"))
    each = each.select("year", canon_theme(F.col("tag")).alias("theme"), "n")  # a few tags of each year
    counts = each.groupingSets([[F.col("year"), F.col("theme")], [F.col("theme")]], "year", "theme").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("year").orderBy(F.desc("n"), "theme"))
    return counts.withColumn("place", place).filter(F.col("place") <= n)


def meeting_themes(points: DataFrame) -> DataFrame:
    """One row per meeting: its measures and themes, an array of (n, theme, amount), most points first. The points are read and
    rated once: a point without tags stands under a null theme, and only the first row of a point bears its measures. They are dealt by
    meeting once, before they are counted: few have a tag of another of their meeting, so that counts before would hold as many rows."""
    x = with_amounts(points).select("meeting", "date", "engaged", "vote_type", "tags").repartition(PARTS, "meeting")
    x = x.select("meeting", "date", "engaged", "vote_type", F.posexplode_outer("tags").alias("k", "tag")).withColumn("theme", canon_theme(F.col("tag")))
    first = F.coalesce(F.col("k"), F.lit(0)) == 0
    by_theme = x.groupBy("meeting", "theme").agg(
        F.first("date").alias("date"), F.count("tag").alias("n"), F.sum("engaged").alias("amount"), F.count_if(first).alias("points"), F.count_if(first & (F.col("vote_type") == "vote_nominal")).alias("contested"), F.sum(F.when(first, F.col("engaged"))).alias("own")
    )
    listed = F.filter(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "theme", "amount"))), lambda t: t["theme"].isNotNull())
    out = by_theme.groupBy("meeting").agg(F.first("date").alias("date"), F.sum("points").alias("points"), F.sum("contested").alias("contested"), F.sum("own").alias("engaged"), listed.alias("themes"))
    return out.withColumn("themes", F.transform("themes", lambda t: F.struct((-t["n"]).alias("n"), t["theme"].alias("theme"), t["amount"].alias("amount"))))


def meeting_summary(points: DataFrame, meetings: DataFrame | None = None, films: DataFrame | None = None) -> DataFrame:
    """Per dated meeting: points, contested votes, engaged amount, and its themes with points and amount, as one text.

    ``meetings`` (meeting, source_file, url, source_url) add its file and the address of its minutes, ``films`` (date, video_url, ord) the
    film of its date, the last one's."""
    text = F.array_join(F.transform("themes", lambda t: F.concat_ws(":", t["theme"], t["n"], t["amount"])), "|")
    out = meeting_themes(points.filter("date is not null")).select("meeting", "date", "points", "contested", F.col("engaged").cast("double").alias("engaged"), text.alias("themes"))
    if meetings is not None:
        out = out.join(meetings.select("meeting", F.col("source_file").alias("file"), F.coalesce(F.nullif("url", F.lit("")), "source_url").alias("url")), "meeting", "left")
    return out if films is None else out.join(by_date(films, "video_url"), "date", "left")


def value_counts(points: DataFrame, column: Column, n: int | None = None) -> DataFrame:
    got = points.groupBy(F.coalesce(column, F.lit("?")).alias("value")).agg(F.count("*").alias("n"))
    return got.orderBy(F.desc("n"), "value").limit(n) if n else got


def theme_points(points: DataFrame, theme: str) -> DataFrame:
    """The points with a stem of the theme in title, summary, rubrics or tags; columns that the points lack hold nothing."""
    said = [F.coalesce(c, F.lit("")) for c in ("titre", "resume", "rubrique", "sous_rubrique") if c in points.columns]
    return with_amounts(points.filter(matches_theme(F.concat_ws(" ", *said, F.array_join("tags", " ")), theme)))


def themes_matched(points: DataFrame, themes: list[str]) -> DataFrame:
    """``points`` with theme, a row for each of ``themes`` that they match; each text is made plain once."""
    said = [F.coalesce(c, F.lit("")) for c in ("titre", "resume", "rubrique", "sous_rubrique") if c in points.columns]
    x = points.withColumn("_blob", F.concat_ws(" ", *said, F.array_join("tags", " ")))
    hits = F.filter(F.array(*(F.when(matches_theme(F.col("_blob"), t), F.lit(t)) for t in themes)), lambda t: t.isNotNull())
    return x.withColumn("theme", F.explode(hits)).drop("_blob")


def theme_trend(points: DataFrame, theme: str) -> DataFrame:
    """Per year: points of the theme, those with an amount over 0, and their total; year ``?`` without a date."""
    x = theme_points(points, theme).filter(~F.col("excluded"))
    paid = F.col("montant") > 0
    return x.groupBy(F.coalesce(F.year("date").cast("string"), F.lit("?")).alias("year")).agg(F.count("*").alias("points"), F.count_if(paid).alias("with_amount"), F.coalesce(F.sum(F.when(paid, F.col("montant"))), F.lit(0)).cast("double").alias("total"))


def trend_totals(points: DataFrame, theme: str) -> DataFrame:
    """One row: points of the theme that count, those with an amount over 0, their total, and the documents left out."""
    paid = ~F.col("excluded") & (F.col("montant") > 0)
    return theme_points(points, theme).agg(F.count_if(~F.col("excluded")).alias("points"), F.count_if(paid).alias("with_amount"), F.coalesce(F.sum(F.when(paid, F.col("montant"))), F.lit(0)).cast("double").alias("total"), F.count_if("excluded").alias("left_out"))


def top_spend(points: DataFrame, theme: str, n: int = 8) -> DataFrame:
    x = theme_points(points, theme).filter(~F.col("excluded") & (F.col("montant") > 0))
    return x.orderBy(F.desc("montant"), "meeting", "sp", "partkey", "suppkey").limit(n).select("meeting", "sp", "partkey", "titre", F.col("montant").cast("double").alias("montant"))


def kpi_rollup(points: DataFrame) -> DataFrame:
    """Points, contested votes and engaged amount for all, each year, month and meeting date; dates are added up first."""
    each = with_amounts(points).groupBy("date").agg(F.count("*").alias("points"), F.count_if(F.col("vote_type") == "vote_nominal").alias("contested"), F.sum("engaged").alias("engaged"))
    x = each.withColumns({"year": F.year("date"), "month": F.month("date")})
    return x.rollup("year", "month", "date").agg(F.sum("points").alias("points"), F.sum("contested").alias("contested"), F.sum("engaged").cast("double").alias("engaged"), F.grouping_id().cast("int").alias("level"))


def scope_themes(points: DataFrame, n: int = 12) -> DataFrame:
    """(level, year, month, date, theme, n, place): the n commonest themes of all, each year, month and date; ties by name."""
    each = points.select("date", F.explode("tags").alias("tag")).groupBy("date", "tag").agg(F.count("*").alias("n"))
    each = each.groupBy("date", canon_theme(F.col("tag")).alias("theme")).agg(F.sum("n").alias("n")).withColumns({"year": F.year("date"), "month": F.month("date")})
    sets = [[], ["year"], ["year", "month"], ["year", "month", "date"]]
    x = each.groupingSets([[F.col(c) for c in [*k, "theme"]] for k in sets], "year", "month", "date", "theme").agg(F.sum("n").alias("n"), F.shiftright(F.grouping_id(), 1).cast("int").alias("level"))
    place = F.row_number().over(Window.partitionBy("level", "year", "month", "date").orderBy(F.desc("n"), "theme"))
    return x.withColumn("place", place).filter(F.col("place") <= n)


def corpus_summary(points: DataFrame) -> DataFrame:
    paid = F.col("montant") > 0
    return points.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.when(paid, F.col("montant"))).cast("double").alias("total"), F.max("montant").cast("double").alias("most"), F.count_if(paid).alias("mentions"))


def corpus_amounts(points: DataFrame) -> DataFrame:
    """One row: total and largest of all amounts that are there and not 0, and how many these are."""
    there = F.when(F.col("montant") != 0, F.col("montant"))
    return points.agg(F.coalesce(F.sum(there), F.lit(0)).cast("double").alias("total"), F.max(there).cast("double").alias("most"), F.count(there).alias("mentions"))


def corpus_checks(points: DataFrame) -> DataFrame:
    """One row: what a sound corpus has none of, and the plausibility of its engaged total and years. A date that is a text
    must be ISO; amounts that are doubles must be finite."""
    iso = F.coalesce(F.col("date").cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))
    amount = F.col("montant").cast("double")
    return with_amounts(points).agg(
        F.count_if(F.col("date").isNull()).alias("undated"), F.count_if(~iso).alias("not_iso"), F.count_if(F.coalesce(F.trim("titre"), F.lit("")) == "").alias("untitled"), F.count_if(F.isnan(amount) | (F.abs(amount) == float("inf"))).alias("not_finite"),
        (F.sum("engaged") < 2_000_000_000).alias("plausible"), F.min(F.year("date")).alias("first_year"), F.max(F.year("date")).alias("last_year"),
    )


def facet_counts(points: DataFrame, kind: str | None, theme: str | None, person: str | None = None) -> DataFrame:
    """Counts of each type (and of points postponed or with a film of the debate), theme and person, each under the other two
    choices; an author who also answers counts twice; the chosen value always shows. points: with postponed and debate.

    The points are read once: each becomes a list of facet and value, of those facets whose other two choices it meets."""
    k, t, p = matches_type(kind), matches_theme_tag(theme), matches_person(person)
    values = {
        "type": (t & p, F.array("type", F.when(F.col("postponed"), POSTPONED), F.when(F.col("debate"), DEBATE))),
        "theme": (k & p, F.array_distinct(F.transform("tags", canon_theme))),
        "person": (k & t, F.array("author", "speaker")),
    }
    none = F.array().cast("array<struct<facet:string,value:string>>")
    told = lambda name, met, of: F.when(met, F.transform(F.filter(of, lambda v: v.isNotNull()), lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value")))).otherwise(none)
    n = points.select(F.explode(F.concat(*(told(f, met, of) for f, (met, of) in values.items()))).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))
    chosen = [(f, v, 0) for f, v in zip(values, (kind, theme, person)) if v is not None]
    if chosen:
        n = n.unionByName(n.sparkSession.createDataFrame(chosen, "facet string, value string, n long")).groupBy("facet", "value").agg(F.sum("n").alias("n"))
    return n
