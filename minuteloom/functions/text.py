"""Text functions on columns: accents, theme names, cleaning and coercion of raw fields."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Composed Latin letters whose canonical decomposition begins with one other letter."""
    pairs = [(chr(c), d[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if len(d := unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accent_table()


def strip_accents(s: Column) -> Column:
    """Letters without their combining marks; œ, ß and ø stay. JVM only."""
    return F.regexp_replace(F.translate(s, _FROM, _TO), r"\p{Mn}", "")


def strip_word(s: Column) -> Column:
    """``strip_accents`` of a word that costs nothing to read; ASCII, which has none, is passed on."""
    return F.when(F.octet_length(s) == F.length(s), s).otherwise(strip_accents(s))


def clean_str(s: Column) -> Column:
    """White space collapsed and trimmed; null becomes the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)\s+", " "))


def canon_theme(tag: Column) -> Column:
    """Lower case, no accents, ``_`` as space, plural ``s`` of words over four letters dropped, merged synonyms."""
    s = F.trim(F.regexp_replace(F.regexp_replace(strip_accents(F.lower(tag)), "_", " "), r"\s+", " "))
    single = F.transform(F.split(s, " "), lambda w: F.when((F.length(w) > 4) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    out = F.array_join(single, " ")
    # fixed value: the one theme that is merged into another
    return F.when(out == "enseignement", "education").otherwise(out)


def theme_label(tag: Column) -> Column:
    s = F.regexp_replace(canon_theme(tag), "-", " ")
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))


def clean_str_list(items: Column) -> Column:
    """Cleaned texts without empty ones; of texts that differ only in case the first."""
    cleaned = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), clean_str), lambda x: x != "")
    lowered = F.transform(cleaned, F.lower)
    return F.filter(cleaned, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def coerce_bool(s: Column) -> Column:
    # fixed values: texts that count as true
    return F.coalesce(F.lower(F.trim(s)).isin("1", "true", "vrai", "oui", "yes"), F.lit(False))


def coerce_int(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, ",", ".")).try_cast("double").try_cast("int")


def coerce_sp(s: Column) -> Column:
    """The leading number of a point number such as ``12 bis``; null without one."""
    return F.nullif(F.regexp_extract(s, r"^\s*(\d+)", 1), F.lit("")).try_cast("int")


def coerce_amount(s: Column) -> Column:
    """The first number of a text in Belgian notation; currency and suffixes are passed over."""
    number = F.regexp_extract(s, r"\d[\d.\s]*(?:,\d+)?", 0)
    return F.nullif(F.regexp_replace(F.regexp_replace(number, r"[\s.]", ""), ",", "."), F.lit("")).try_cast("double")


# fixed values: words of a theme that say nothing about it
STOPWORDS = frozenset(
    "budget montant depense cout evolution evolue evoluer depuis total annuel communal commune conseil point euro pour des les aux sur dans "
    "quel quelle combien quels quelles avec une und".split()
)
# fixed values: families of word beginnings, in the order in which they are tried
FAMILIES = {
    "proprete": "proprete nettoy dechet immondice salubrit balay encombrant graffiti caniveau corbeille",
    "mobilite": "mobilite velo pieton cyclable stationnement trottoir",
    "ecole": "ecole scolaire enseignement creche",
    "culture": "culture culturel bibliotheque musee theatre patrimoine",
    "sport": "sport piscine stade gymnase",
    "logement": "logement habitat locatif",
    "climat": "climat environnement energie arbre",
    "securite": "securite prevention camera gardien incivilite",
    "cpas": "cpas precarite insertion",
    "voirie": "voirie chaussee trottoir egout asphalt pave refection",
    "environnement": "environnement climat arbre plantation biodiversite vegetal verdur",
    "finance": "finance fiscal taxe redevance emprunt tresorerie",
}


def theme_stems(theme: str, own_names: frozenset[str] = frozenset()) -> list[str]:
    """Word beginnings to look for; ``own_names`` (say the municipality's) are passed over too. ValueError if none is left."""
    plain = "".join(c for c in unicodedata.normalize("NFD", theme.lower()) if unicodedata.category(c) != "Mn")
    found: set[str] = set()
    for word in re.findall("[a-z]{3,}", plain):
        if word in STOPWORDS or word in own_names:
            continue
        stem = word.removesuffix("s") if len(word) > 4 else word
        family = next((f for k, f in FAMILIES.items() if stem.startswith(k) or k.startswith(stem)), stem)
        found.update(family.split())
    if not found:
        raise ValueError(f"no word to look for in {theme!r}")
    return sorted(found)


def matches_theme(blob: Column, theme: str) -> Column:
    """Whether a stem of the theme begins a word of the text."""
    return strip_accents(F.lower(blob)).rlike(r"\b(?:" + "|".join(theme_stems(theme)) + ")")
