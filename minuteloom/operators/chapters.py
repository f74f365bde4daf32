"""Chapters of filmed sessions: what their titles say, where they come from, and the agenda points that they belong to."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minuteloom.functions.dates import date_from_title
from minuteloom.functions.text import strip_accents
from minuteloom.sources.files import kept

# fixed values: how sessions of the council are called; beginnings of Dutch halves of titles; titles without a subject
COUNCIL = ("conseil communal", "gemeenteraad")
DUTCH = (
    "de ", "het ", "verzoek", "motie", "vraag", "beheers", "belasting", "aanslag", "vzw", "rekeningen", "goedkeuring", "overeenkomst", "mobiliteit", "oproep", "e situatie",
    "in afkorting", "reglement", "overheidsopdracht", "duurzaam", "handvest", "erfpacht", "bezetting", "organisatie", "wijziging", "nieuw huishoudelijk", "gebouw", "herlancering", "geheim", "stemming",
)
PROCEDURE = (
    "d[ée]but", "begin", "vote", "stemming", "geheim", r"comit[ée]\s+secret", r"fin\b", "einde", "mise à l", "huldiging", "abonnez", "suivez", "r[ée][ée]cout", "facebook", "instagram", "newsletter",
)
# fixed values: words of a title that tell its kind, in the order in which they are tried
KINDS = (
    ("question", ("question de", "vraag van")), ("demande", ("demande de", "verzoek van")), ("interpellation", ("interpellation",)), ("prise_acte", ("prise d", "akte nemen")),
    ("approbation", ("approbation", "goedkeuring")), ("taxe", ("taxe", "belasting")), ("reglement", ("règlement", "reglement")),
)
# fixed values: where a title names its author: after the kind and a form of address, in closing brackets, after a last dash
CAPITAL, LETTERS = "A-ZÀ-Ý", r"\p{L}\p{N}_'’.\-"
WORD = f"[{CAPITAL}][{LETTERS}]+"
BY_ADDRESS = r"(?i)(?:Demande|Motion|Motie|Question|Vraag|Interpellation|Verzoek)\s+d[eu]\s+(?:Monsieur|Madame|M\.|Mme|de heer|Mevrouw)\s+([^\-–)\n]+?)(?:\s[-–]\s|\)|$)"
IN_BRACKETS = rf"\(\s*(?:(?i:motie|motion|question|vraag|demande|verzoek)\s+)?({WORD}(?:\s+{WORD}){{0,2}})\s*\)\s*$"
AT_THE_END = rf"[-–·]\s*(?:(?i:motion|motie)\s+)?({WORD}\s+{WORD})\s*$"
TIMED_LINE = r"^\s*(?:(\d{1,2}):)?(\d{1,2}):(\d{2})\s+(.+?)\s*$"


def is_council_video(title: Column) -> Column:
    """Whether a title names the council and a dd/mm/yy(yy) date; null titles don't."""
    t = F.lower(F.coalesce(title, F.lit("")))
    named = F.lit(False)
    for c in COUNCIL:
        named = named | t.contains(c)
    return named & date_from_title(F.coalesce(title, F.lit(""))).isNotNull()


def is_procedural(title: Column) -> Column:
    """Whether a title is empty, untitled or of the course of the session only."""
    t = F.trim(F.coalesce(title, F.lit("")))
    return (t == "") | F.lower(t).contains("untitled") | F.lower(t).rlike("^(?:" + "|".join(PROCEDURE) + ")")


def drop_procedural(chapters: DataFrame, title: str = "title") -> DataFrame:
    return chapters.filter(~is_procedural(F.col(title)))


def french_part(title: Column, places: tuple[str, ...] = ()) -> Column:
    """The parts of a bilingual title before the first that begins in Dutch; the whole title if none is left. ``places`` are
    Dutch names, in lower case, that a Dutch part may begin with too: that of the municipality, say."""
    parts = F.split(title, r"\s[–-]\s")
    dutch = F.transform(parts, lambda p: F.lower(F.trim(p)).rlike("^(?:" + "|".join([*DUTCH, *places]) + ")"))
    at = F.array_position(dutch, F.lit(True))
    kept = F.when(at == 0, parts).otherwise(F.slice(parts, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")))
    return F.coalesce(F.nullif(F.trim(F.array_join(kept, " - ")), F.lit("")), title)


def chapter_kind(title: Column) -> Column:
    t = F.lower(title)
    kind = F.when(t.rlike(r"\bmoti(?:on|e)\b"), "motion")
    for name, cues in KINDS:
        said = F.lit(False)
        for c in cues:
            said = said | t.contains(c)
        kind = kind.when(said, name)
    return kind.otherwise("point")


def chapter_author(title: Column) -> Column:
    return F.coalesce(*(F.trim(F.nullif(F.regexp_extract(title, p, 1), F.lit(""))) for p in (BY_ADDRESS, IN_BRACKETS, AT_THE_END)))


def chapter_point(title: Column, start: Column, video_id: Column, places: tuple[str, ...] = ()) -> Column:
    """struct(titre, titre_fr, type, auteur, start_s, deeplink) of a chapter."""
    s = F.coalesce(start, F.lit(0)).cast("int")
    link = F.concat(F.lit("https://www.youtube.com/watch?v="), video_id, F.lit("&t="), s.cast("string"), F.lit("s"))
    return F.struct(title.alias("titre"), french_part(title, places).alias("titre_fr"), chapter_kind(title).alias("type"), chapter_author(title).alias("auteur"), s.alias("start_s"), link.alias("deeplink"))


def described_chapters(description: Column) -> Column:
    """array of (title, start_time) from lines such as ``1:02:03 Title`` or ``02:03 Title``."""
    part = lambda line, g: F.coalesce(F.nullif(F.regexp_extract(line, TIMED_LINE, g), F.lit("")).cast("int"), F.lit(0))
    lines = F.filter(F.split(F.coalesce(description, F.lit("")), r"\r?\n"), lambda x: x.rlike(TIMED_LINE))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, TIMED_LINE, 4).alias("title"), (part(x, 1) * 3600 + part(x, 2) * 60 + part(x, 3)).cast("double").alias("start_time")))


def chapters_or_description(videos: DataFrame) -> DataFrame:
    """A row per chapter of (video_id, chapters array of title and start_time, description): the official ones that aren't
    procedural, or where there is none those of the description. Null lists and texts count as empty."""
    kept = lambda a: F.filter(a, lambda c: ~is_procedural(c["title"]))
    official = kept(F.coalesce("chapters", F.array().cast("array<struct<title:string,start_time:double>>")))
    told = F.when(F.size(official) > 0, official).otherwise(kept(described_chapters(F.col("description"))))
    x = videos.select("video_id", F.explode(told).alias("c"))
    return x.select("video_id", chapter_point(F.trim("c.title"), F.col("c.start_time"), F.col("video_id")).alias("p")).select("video_id", "p.*")


def list_council_videos(listings: DataFrame) -> DataFrame:
    """Videos of the council, one row each (that of the first tab, then the first in order), newest first. listings: tab, ord, id, title."""
    x = listings.filter(F.col("id").isNotNull() & (F.col("id") != "") & is_council_video(F.col("title")))
    x = x.withColumn("_p", F.row_number().over(Window.partitionBy("id").orderBy("tab", "ord"))).filter("_p = 1")
    return x.select("id", "title", date_from_title(F.col("title")).alias("date")).orderBy(F.desc("date"), "id")


def chunk_counts(chapters: DataFrame) -> DataFrame:
    """(key, extracts): the title and each part of the transcript of a chapter count one."""
    key = F.concat(F.lit("video-"), "video_id", F.lit("-"), F.col("start_s").cast("int").cast("string"))
    return chapters.select(key.alias("key"), (1 + F.coalesce(F.size("transcript"), F.lit(0))).alias("extracts"))


def session_video_map(sessions: DataFrame) -> DataFrame:
    """(date, video_url): the last film of each date that has an address. sessions: date, video_url, ord."""
    return sessions.filter(F.col("date").isNotNull() & (F.col("video_url") != "")).groupBy("date").agg(F.max_by("video_url", "ord").alias("video_url"))


def chapter_coverage(sessions: DataFrame) -> DataFrame:
    """Filmed sessions, those with an agenda, and chapters in all; points: an array, null counts as empty."""
    n = F.greatest(F.coalesce(F.size("points"), F.lit(0)), F.lit(0))
    return sessions.agg(F.count("*").alias("sessions"), F.count_if(n > 0).alias("with_agenda"), F.coalesce(F.sum(n), F.lit(0)).alias("chapters"))


#: The characters that a plain title may have.
PLAIN = "abcdefghijklmnopqrstuvwxyz0123456789 "


def plain_title(title: Column) -> Column:
    return F.regexp_replace(F.lower(strip_accents(F.coalesce(title, F.lit("")))), f"[^{PLAIN}]", " ")


def _letters(plain: Column) -> Column:
    """How often each character that a plain title may have occurs in it."""
    return F.transform(F.array(*map(F.lit, PLAIN)), lambda x: F.length(plain) - F.length(F.replace(plain, x, F.lit(""))))


#: Titles of fewer characters are compared as they are; of longer ones SequenceMatcher leaves common characters out.
WHOLE = 200


def _asked(chapters: DataFrame) -> DataFrame:
    """The dated chapters with their plain title; ``_who`` is whose points they are looked for among, empty for all of the date."""
    who = F.when(F.col("author_key").isNull(), "").otherwise(F.concat(F.lit("="), "author_key"))
    return chapters.filter("date is not null").select("date", "chapter", who.alias("_who"), F.col("author_key").isNull().alias("_all"), plain_title(F.col("titre")).alias("_t"))


def _titles(points: DataFrame) -> DataFrame:
    """(date, _who, _pt, _c, _first, _n): the different plain titles of each date, and of each author of it, with how many points
    have them, the first of these, and the points of the date or author in all. Equal titles are alike, so that the first stands for all."""
    who = F.when(F.col("author_key").isNotNull(), F.concat(F.lit("="), "author_key"))
    p = points.filter("date is not null").select("date", "ord", "sp", plain_title(F.col("titre")).alias("_pt"), F.explode(F.array_compact(F.array(F.lit(""), who))).alias("_who"))
    same = p.groupBy("date", "_who", "_pt").agg(F.count("*").alias("_c"), F.min(F.struct("ord", "sp")).alias("_first"))
    return same.withColumn("_n", F.sum("_c").over(Window.partitionBy("date", "_who")))


def _compared(x: DataFrame, own: float, collective: float) -> DataFrame:
    """The pairs of titles that can be alike enough."""
    both = F.aggregate(F.zip_with(_letters(F.col("_t")), _letters(F.col("_pt")), lambda a, b: F.least(a, b)), F.lit(0), lambda a, n: a + n)
    size = F.length("_t") + F.length("_pt")
    most = F.when(F.col("sure") | (size == 0), 1.0).otherwise(2.0 * both / size)
    least = F.when(F.col("_all"), collective).otherwise(own)
    return x.select("date", "chapter", F.col("_first.sp").alias("sp"), F.col("_first.ord").alias("ord"), "sure", "_t", "_pt", most.alias("most"), least.alias("least")).filter("sure or most >= least")


def _held() -> Column:
    return (F.col("_pt") != "") & (F.contains("_t", "_pt") | F.contains("_pt", "_t"))


def chapter_candidates(chapters: DataFrame, points: DataFrame, own: float = 0.35, collective: float = 0.6) -> DataFrame:
    """(date, chapter, sp, ord, sure, most, least, and the plain titles): the point of a chapter where no comparison is needed
    (``sure``), else those that its titles must be compared with, the first of each title. ``most`` is what their similarity can be at most: twice the
    characters that both titles have, over the length of both; pairs under ``least``, their threshold, are left out."""
    x = _asked(chapters).join(_titles(points), ["date", "_who"])
    each = Window.partitionBy("date", "chapter")
    x = x.withColumn("_held", _held()).withColumn("_h", F.sum(F.when(F.col("_held"), F.col("_c")).otherwise(0)).over(each))
    sure = (F.col("_n") == 1) | ((F.col("_h") == 1) & F.col("_held"))
    x = x.withColumn("sure", sure).filter(F.col("sure") | ((F.col("_h") != 1) & ((F.col("_h") == 0) | F.col("_held"))))
    return _compared(x, own, collective)


def match_chapters_to_points(chapters: DataFrame, points: DataFrame, own: float = 0.35, collective: float = 0.6) -> DataFrame:
    """(date, chapter, sp): the agenda point of each chapter that has one.

    chapters: date, chapter, titre, author_key (null: collective); points: date, sp, titre, author_key, ord. Candidates are the
    points of the date and author, of the date for collective chapters. A lone candidate is it; else the only one whose plain
    title holds the chapter's or is held by it; else the most alike of these (or of all), the first by ord on ties, if its
    similarity reaches ``own`` or ``collective``.

    Chapters meet the different titles of their date, and keep those that hold or are held, most often one: of these the similarity is
    known, as the shorter title is the common part. What that decides is written, as are the chapters left. For these, the candidates
    are read once, those of a chapter by what their similarity can be at most; as soon as that is under what another one has, no
    more titles of the chapter are compared."""
    t = _titles(points)
    x = _asked(chapters).join(t.withColumnRenamed("_who", "_w").withColumnRenamed("date", "_d"), (F.col("date") == F.col("_d")) & (F.col("_who") == F.col("_w")) & ((F.col("_n") == 1) | _held()), "left")
    short, size = F.least(F.length("_t"), F.length("_pt")), F.length("_t") + F.length("_pt")
    alike = F.when(size == 0, 1.0).otherwise(2.0 * short / size)
    x = x.groupBy("date", "chapter", "_who", "_all", "_t").agg(
        F.sum("_c").alias("_h"), F.max(F.length("_pt")).alias("_longest"), F.min(F.struct((-alike).alias("not_alike"), "_first")).alias("_best")
    )
    found = F.col("_h").isNotNull() & ((F.col("_h") == 1) | (F.col("_longest") < WHOLE))
    enough = (F.col("_h") == 1) | (-F.col("_best.not_alike") >= F.when(F.col("_all"), collective).otherwise(own))
    left = ~found
    x = kept(x.filter(left | enough).select("date", "chapter", "_who", "_all", F.when(left, F.col("_t")).alias("_t"), F.col("_h").isNotNull().alias("_some"), left.alias("_left"), F.when(found, F.col("_best._first.sp")).alias("sp")), "chapters")
    rest = x.filter("_left").drop("sp").join(t, ["date", "_who"]).filter(~F.col("_some") | _held()).withColumn("sure", F.lit(False))
    return x.filter("not _left").select("date", "chapter", "sp").unionByName(_most_alike(_compared(rest, own, collective)))


def _most_alike(x: DataFrame) -> DataFrame:
    """(date, chapter, sp): of candidates the most alike one of each chapter, if it reaches its threshold."""
    x = x.withColumn("_place", F.row_number().over(Window.partitionBy("date", "chapter").orderBy("ord")))  # what a tie goes by
    kinds = dict(x.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, now, best, row = None, None, (0.0, 0), None
        compare = SequenceMatcher(None)
        for b in batches:
            shape = pa.schema([b.schema.field(c) for c in ("date", "chapter", "sp")])
            dates, names, sure, most, least, mine, theirs, place = (b.column(c).to_pylist() for c in ("date", "chapter", "sure", "most", "least", "_t", "_pt", "_place"))
            done = []
            for i, key in enumerate(zip(dates, names)):
                if key != now:
                    done += [row] if row is not None else []
                    now, best, row = key, (0.0, 0), None
                    compare.set_seq1(mine[i])
                if sure[i]:
                    done.append(b.slice(i, 1).select(shape.names))
                elif most[i] >= best[0]:
                    compare.set_seq2(theirs[i])
                    found = (compare.ratio(), -place[i])
                    if found[0] >= least[i] and (row is None or found > best):
                        best, row = found, b.slice(i, 1).select(shape.names)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if row is not None:
            yield row

    ordered = x.repartition("date", "chapter").sortWithinPartitions("date", "chapter", F.desc("most"), "_place")
    return ordered.mapInArrow(run, f"date {kinds['date']}, chapter {kinds['chapter']}, sp {kinds['sp']}")
