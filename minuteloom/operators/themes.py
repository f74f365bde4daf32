"""Many themes at once: word beginnings as a table, found in texts by the beginnings of their words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minuteloom.functions.text import FAMILIES, STOPWORDS, strip_accents

#: Word beginnings that are broadcast; more are joined by hash.
STEMS = 200_000
#: A word as ``\\b`` sees it: what lies between two of its bounds.
WORD = r"[\p{L}\p{Nd}_]+"


def stems_of(theme: Column, own_names: frozenset[str] = frozenset()) -> Column:
    """The word beginnings of a theme, as ``theme_stems`` has them; an empty list where no word is left to look for."""
    words = F.filter(F.regexp_extract_all(strip_accents(F.lower(theme)), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(*(STOPWORDS | own_names)))
    families = F.array(*(F.struct(F.lit(k).alias("key"), F.array(*map(F.lit, v.split())).alias("stems")) for k, v in FAMILIES.items()))

    def stems(word: Column) -> Column:
        bare = F.when((F.length(word) > 4) & word.endswith("s"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)
        of = lambda s: F.get(F.filter(families, lambda f: F.startswith(s, f["key"]) | F.startswith(f["key"], s)), F.lit(0))["stems"]
        return F.get(F.transform(F.array(bare), lambda s: F.coalesce(of(s), F.array(s))), F.lit(0))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(words, stems))))


def stems_table(themes: DataFrame, own_names: frozenset[str] = frozenset()) -> DataFrame:
    """(theme, stem) of a table of themes; one without a word to look for has no row."""
    return themes.select("theme").distinct().select("theme", F.explode(stems_of(F.col("theme"), own_names)).alias("stem"))


def plain_text(points: DataFrame) -> Column:
    """Title, summary, rubrics and tags without accents, in lower case; columns that the points lack hold nothing."""
    said = [F.coalesce(c, F.lit("")) for c in ("titre", "resume", "rubrique", "sous_rubrique") if c in points.columns]
    tags = [F.array_join("tags", " ")] if "tags" in points.columns else []
    return strip_accents(F.lower(F.concat_ws(" ", *said, *tags)))


def _beginnings(words: str, n: int) -> Column:
    """The first ``n`` characters of each of the words that has as many."""
    return F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.substring(w, 1, n))


def _hits(points: DataFrame, stems: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """(keys, name), some more than once: the points that hold a word beginning with a stem of ``stems`` (name, stem).

    The beginnings of a text's words are cut at the lengths that stems have, each once, and looked up as they are: a beginning
    meets its own stem only, however many others share its first letters."""
    lengths = sorted(r.n for r in stems.select(F.length("stem").alias("n")).distinct().collect())  # one number for each length of a word
    index = F.broadcast(stems) if stems.limit(STEMS + 1).count() <= STEMS else stems
    words = F.array_distinct(F.regexp_extract_all(plain_text(points), F.lit(WORD), F.lit(0)))
    cut = [_beginnings("_w", n) for n in lengths]
    begun = F.array_distinct(F.concat(*cut)) if cut else F.array().cast("array<string>")
    return points.select(*keys, words.alias("_w")).select(*keys, F.explode(begun).alias("stem")).join(index, "stem").select(*keys, name)


def matched_themes(points: DataFrame, stems: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, theme): the points, told apart by ``keys``, and the themes of which a stem begins a word of their text.

    The texts are read once, however many themes there are. A hit is counted once for a point before it is shuffled, and again after."""
    return _hits(points, stems.select("theme", "stem"), "theme", keys).distinct()


def theme_counts(points: DataFrame, stems: DataFrame, keys: list[str]) -> DataFrame:
    """(theme, points): how many points ``matched_themes`` has of each theme that it has. Themes of the same stems are counted once, so
    that the hits are bounded by what a text holds, not by the number of themes."""
    of = stems.groupBy("theme").agg(F.array_sort(F.collect_set("stem")).alias("_stems"))
    alike = of.groupBy("_stems").agg(F.min("theme").alias("_same"))
    n = _hits(points, alike.select("_same", F.explode("_stems").alias("stem")), "_same", keys).distinct().groupBy("_same").agg(F.count("*").alias("points"))
    return of.join(alike, "_stems").select("theme", "_same").join(n, "_same").select("theme", "points")
