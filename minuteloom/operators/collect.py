"""Links to documents in crawled pages, and the files behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: what the addresses of minutes contain
KEYWORDS = ("pv-conseil", "pv_conseil", "pv conseil", "notulen", "proces-verbal")
LINKS = (
    r"""(?i)href=["']([^"']*\.pdf)["']""",
    r"""(?i)src=["']([^"']*\.pdf)["']""",
    r"""(?i)"url"\s*:\s*"([^"]*\.pdf)\"""",
    r"""(?i)'url'\s*:\s*'([^']*\.pdf)'""",
    r"""(?i)data-[a-z-]+=["']([^"']*\.pdf)["']""",
)
SHORT_DATED = r"pv[-_. ]*20\d{2}[-_. ]+\d{1,2}[-_. ]+\d{1,2}(?:[-_. ]*sp)?"


def is_minutes_pdf(url: Column, host: str) -> Column:
    u = F.lower(F.coalesce(F.try_url_decode(url), url))
    named = F.lit(False)
    for k in KEYWORDS:
        named = named | u.contains(k)
    return u.endswith(".pdf") & u.contains(host) & (named | u.rlike(SHORT_DATED))


def extract_links(pages: DataFrame, base: str, host: str) -> DataFrame:
    """Distinct (page_id, url) of minutes in attributes and scripts, made absolute; references relative to a page are dropped."""
    raw = F.explode(F.flatten(F.array(*(F.regexp_extract_all("html", F.lit(p), F.lit(1)) for p in LINKS))))
    x = pages.select("page_id", raw.alias("u"))
    url = F.when(F.col("u").startswith("http"), F.col("u")).when(F.col("u").startswith("//"), F.concat(F.lit("https:"), "u")).when(F.col("u").startswith("/"), F.concat(F.lit(base), "u"))
    return x.select("page_id", url.alias("url")).filter(F.col("url").isNotNull() & is_minutes_pdf(F.col("url"), host)).distinct()


def filename_from_url(url: Column) -> Column:
    """The last part of the address, dots of its stem as underscores."""
    last = F.element_at(F.split(url, "/"), -1)
    stem, ext = F.regexp_extract(last, r"^(.*)\.([^.]*)$", 1), F.regexp_extract(last, r"^(.*)\.([^.]*)$", 2)
    return F.when(last.contains("."), F.concat(F.regexp_replace(stem, r"\.", "_"), F.lit("."), ext)).otherwise(last)


def dedup_files(files: DataFrame) -> DataFrame:
    """One file of each key: the last in French, else the first."""
    order = Window.partitionBy("pub_key").orderBy(F.desc("is_fr"), F.when(F.col("is_fr"), -F.col("ord")).otherwise(F.col("ord")))
    return files.withColumn("_p", F.row_number().over(order)).filter("_p = 1").drop("_p")


def candidate_urls(dates: DataFrame, templates: list[str], most: int = 3) -> DataFrame:
    """Distinct addresses made from templates with {date} and {n}."""
    t = F.explode(F.array(*map(F.lit, templates)))
    x = dates.select(F.col("date").cast("string").alias("d"), t.alias("t")).select("d", "t", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("n"))
    return x.select(F.replace(F.replace(F.col("t"), F.lit("{date}"), F.col("d")), F.lit("{n}"), F.col("n").cast("string")).alias("url")).distinct()


def manifest_summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def files_by_year(manifest: DataFrame) -> DataFrame:
    """(year, files): of files with a date."""
    return manifest.filter("date is not null").groupBy(F.year("date").alias("year")).agg(F.count("*").alias("files"))


# fixed values: what marks the entries of a document portal, and entries that lead elsewhere
ENTRY_CLASS, ENTRY_KEY, NAVIGATION = "click-show-content", "data-bk", ("Transparence", "Conseil communal", "Retour à la liste", "Annexes")
FILE_KEY = r"pubKey=(P[0-9a-f-]+)"


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*["']([^"']*)["']""", 1)


def extract_anchors(pages: DataFrame, navigation: tuple[str, ...] = NAVIGATION) -> DataFrame:
    """(page_id, kind, key, label, url) of a portal's pages: ``year`` entries (a label of four digits from 20), ``meeting`` entries
    (other labels that are no navigation), and ``file`` links with their pubKey."""
    a = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)(<a\s[^>]*>.*?)</a>"), F.lit(1))).alias("a"))
    tag = F.regexp_extract("a", r"(?is)^(<a\s[^>]*>)", 1)
    label = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("a", r"(?is)^<a\s[^>]*>", ""), "<[^>]*>", ""), r"\s+", " "))
    x = a.select("page_id", label.alias("label"), _attribute(tag, ENTRY_KEY).alias("bk"), _attribute(tag, "class").alias("c"), _attribute(tag, "href").alias("url"))
    entry = F.array_contains(F.split("c", r"\s+"), ENTRY_CLASS) & F.col("bk").startswith("C")
    kind = F.when(entry & F.col("label").rlike(r"^20\d{2}$"), "year").when(entry & ~F.col("label").isin(*navigation), "meeting")
    kind = kind.when(~entry & F.lower("url").contains("download") & F.col("url").rlike(FILE_KEY), "file")
    return x.select("page_id", kind.alias("kind"), F.when(kind == "file", F.regexp_extract("url", FILE_KEY, 1)).otherwise(F.col("bk")).alias("key"), "label", "url").filter("kind is not null")


def name_files(files: DataFrame, prefix: str) -> DataFrame:
    """``files`` with filename, none of which collide: by date with a number for the second file of a meeting and later ones;
    without a date by the meeting's title and the start of the key. files: meeting, ord, date, titre, pub_key."""
    i = F.row_number().over(Window.partitionBy("meeting").orderBy("ord")) - 1
    dated = F.concat(F.lit(prefix), F.col("date").cast("string"), F.when(i == 0, "").otherwise(F.concat(F.lit("_"), i.cast("string"))), F.lit(".pdf"))
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("titre", F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 40)
    return files.withColumn("filename", F.when(F.col("date").isNotNull(), dated).otherwise(F.concat(F.lit(prefix), slug, F.lit("-"), F.substring(F.col("pub_key").cast("string"), 1, 9), F.lit(".pdf"))))
