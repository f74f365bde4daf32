"""People named in minutes: names, keys, activity."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minuteloom.functions.text import strip_accents, strip_word

# fixed values: titles before names, words of office, particles, separators of several names
TITLES = r"(?i)^(?:(?:MM\.?|Messieurs|M\.?|Mme\.?|Mr\.?|Monsieur|Madame|Mesdames|Mlle|Dr\.?|de\s+heer|Mevrouw|Mevr\.?|Dhr\.?|Mijnheer)\s+)+"
OFFICES = (
    "bourgmestre", "echevin", "echevine", "president", "presidente", "secretaire", "communal", "communale", "conseiller", "conseillere", "ff", "schepen", "burgemeester", "voorzitter",
    "college", "le", "la", "les", "du", "des", "au", "the", "puis", "ensuite", "alors",
)
PARTICLES = ("de", "du", "des", "van", "von", "den", "der", "ter", "ten", "la", "le", "el", "di", "da", "d'", "of")
SEPARATORS = r"(?i)\s+et\s+|\s+en\s+|\s+puis\s+|\s+ensuite\s+|&|,|;|/|\+"


def clean_name(raw: Column) -> Column:
    """Without what follows a comma, leading titles and trailing dots."""
    head = F.trim(F.get(F.split(F.coalesce(raw, F.lit("")), ","), F.lit(0)))
    return F.regexp_replace(F.trim(F.regexp_replace(head, TITLES, "")), r"\.+$", "")


def norm_token(t: Column) -> Column:
    return F.regexp_replace(F.lower(strip_word(t)), r"^[-'’.]+|[-'’.]+$", "")


def _is_office(plain: Column) -> Column:
    """Whether a plain word in lower case is one of office, whatever signs stand around it."""
    return plain.rlike(r"^[.'’()-]*(?:" + "|".join(map(re.escape, OFFICES)) + r"|f\.?f)[.'’()-]*$")


def is_role_token(t: Column) -> Column:
    return _is_office(F.lower(strip_accents(t)))


def _parts(raw: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), SEPARATORS), clean_name), lambda p: p != "")


def _without_offices(part: Column) -> Column:
    words, plain = F.split(part, r"\s+"), F.split(F.lower(strip_word(part)), r"\s+")
    return F.array_join(F.zip_with(words, plain, lambda t, p: F.when((t != "") & ~_is_office(p), t)), " ")


def split_person_names(raw: Column) -> Column:
    """The names of a compound mention, without words of office; parts of such words only are no person."""
    return F.filter(F.transform(_parts(raw), _without_offices), lambda p: p != "")


def looks_like_name(s: Column) -> Column:
    """One to four words; null doesn't."""
    return F.coalesce(F.size(F.filter(F.split(F.trim(s), r"\s+"), lambda t: t != "")).between(1, 4), F.lit(False))


def is_non_person(raw: Column, names: list[str]) -> Column:
    """Whether a mention is one of ``names`` (plain, lower case): bodies that sign or take part, never people."""
    return F.lower(strip_accents(clean_name(raw))).isin(names) if names else F.lit(False)


def title_case_name(name: Column) -> Column:
    """Each word and part of a hyphenated word in title case; particles after the first word in lower case."""
    title = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    cased = F.transform(words, lambda w, i: F.when((i > 0) & F.lower(w).isin(*PARTICLES), F.lower(w)).otherwise(F.array_join(F.transform(F.split(w, "-"), title), "-")))
    return F.array_join(cased, " ")


def name_tokens(name: Column) -> Column:
    return F.transform(F.filter(F.split(clean_name(name), r"\s+"), lambda x: x != ""), norm_token)


def person_key(name: Column, reversed_pair: Column | None = None, aliases: dict[str, str] | None = None) -> Column:
    """The surname, plain and in lower case: the last word; after leading particles the next word, if more follow; the
    first of two words where ``reversed_pair`` says that they are known the other way round. ``aliases`` mend misspellings."""
    return _surname(name_tokens(name), reversed_pair, aliases)


def _surname(t: Column, reversed_pair: Column | None, aliases: dict[str, str] | None) -> Column:
    lead = F.aggregate(t, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, x: F.struct((a["n"] + F.when(a["go"] & x.isin(*PARTICLES), 1).otherwise(0)).alias("n"), (a["go"] & x.isin(*PARTICLES)).alias("go")))["n"]
    key = F.when((lead > 0) & (lead + 1 < F.size(t)), F.get(t, lead))
    if reversed_pair is not None:
        key = key.when((lead == 0) & (F.size(t) == 2) & reversed_pair, F.get(t, F.lit(0)))
    key = F.coalesce(key.otherwise(F.try_element_at(t, F.lit(-1))), F.lit(""))
    if aliases:
        key = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv)), key), key)
    return key


def name_pairs(mentions: DataFrame, name: str = "name") -> DataFrame:
    """(first, last): distinct pairs from mentions of two words of which exactly one is in capitals, the surname."""
    words = F.filter(F.split(clean_name(F.col(name)), r"\s+"), lambda x: x != "")
    capitals = lambda w: (w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) > 1)

    def pair(w: Column) -> Column:
        a, b = F.get(w, F.lit(0)), F.get(w, F.lit(1))
        last_b = capitals(b)
        return F.when((F.size(w) == 2) & (capitals(a) != last_b), F.struct(F.when(last_b, a).otherwise(b).alias("first"), F.when(last_b, b).otherwise(a).alias("last")))

    # a list of one: a name is cleaned once, however often its words are looked at
    x = mentions.select(F.explode(F.transform(F.array(words), pair)).alias("p")).filter("p is not null").select("p.*").distinct()
    return x.select(norm_token(F.col("first")).alias("first"), norm_token(F.col("last")).alias("last")).distinct()


def person_keys(mentions: DataFrame, pairs: DataFrame, name: str = "name", aliases: dict[str, str] | None = None) -> DataFrame:
    """``mentions`` with key; two words that ``pairs`` know the other way round have the first as surname."""
    known = pairs.select(F.col("first").alias("_f"), F.col("last").alias("_l"), F.lit(True).alias("_known")).distinct()
    # a name is cut into words once, however often they are looked at
    x = mentions.withColumn("_t", name_tokens(F.col(name))).withColumn("_a", F.get("_t", F.lit(0))).withColumn("_b", F.get("_t", F.lit(1)))
    x = x.join(known, (F.col("_a") == F.col("_l")) & (F.col("_b") == F.col("_f")), "left")
    return x.withColumn("key", _surname(F.col("_t"), F.coalesce("_known", F.lit(False)), aliases)).drop("_t", "_a", "_b", "_f", "_l", "_known")


# fixed values: how titles and summaries name who asks; capitals as an explicit list, as ranges hold small letters too
ASKING, ADDRESS = "Demande|Motion|Interpellation|Verzoek|Motie", r"M\.?|Mme|Monsieur|Madame|de heer|Mevrouw"
CAPITALS = "A-ZÀÂÄÇÉÈÊËÎÏÔÖÙÛÜŸÑŒ"
CAPITAL_WORD = rf"[{CAPITALS}][\p{{L}}\p{{N}}_'’\-]+"
ASKED_BY = rf"(?:{ASKING})\s+(?:d[eu']?\s+)?(?:{ADDRESS})?\s*({CAPITAL_WORD}(?:\s+{CAPITAL_WORD}){{0,2}})"


def author_in_text(text: Column, speakers: Column) -> Column:
    """Who a text names as asking; a speaker whose name goes on where the text's name ends is taken for it. Else null."""
    found = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), ASKED_BY, 1), F.lit(""))
    longer = lambda name: F.get(F.filter(speakers, lambda s: (F.lower(s) != F.lower(name)) & F.startswith(F.lower(s), F.lower(name))), F.lit(0))
    # a list of one: the pattern runs once for a text, however often its find is looked at
    return F.get(F.transform(F.array(found), lambda name: F.when(name.isNotNull(), F.coalesce(longer(name), name))), F.lit(0))


def first_single_speaker(speakers: Column) -> Column:
    """The first speaker entry that names exactly one person."""
    return F.get(F.get(F.filter(F.transform(speakers, split_person_names), lambda n: F.size(n) == 1), F.lit(0)), F.lit(0))


#: Whose author title or summary may name, and whose speakers may be it.
TOLD, HEARD = ("demande_habitant", "motion"), ("question_orale", "demande_habitant")


def author_told(kind: Column, title: Column, summary: Column, speakers: Column) -> Column:
    """Who title or summary name as asking, of requests and motions; else null."""
    return F.when(kind.isin(*TOLD), F.coalesce(author_in_text(title, speakers), author_in_text(summary, speakers)))


def point_author(kind: Column, title: Column, summary: Column, speakers: Column) -> Column:
    """Who put a point forward: of a question the first speaker; of a request who title or summary name, else the first
    speaker; of a motion who title or summary name, never a speaker; of other points nobody (null)."""
    return F.coalesce(author_told(kind, title, summary, speakers), F.when(kind.isin(*HEARD), first_single_speaker(speakers)))


def respondents(raw: Column, mayor: Column, acting: Column) -> Column:
    """The people of a field that may name several; a lone office of mayor is the meeting's (acting) mayor, if that is a name."""
    holder = lambda c: F.when(looks_like_name(c), c)

    def one(part: Column) -> Column:
        low, name = F.lower(strip_word(part)), _without_offices(part)
        office = F.when(low.contains("ff") | low.contains("f.f"), holder(acting)).when(low.contains("bourgmestre") | low.contains("burgemeester"), holder(F.coalesce(F.nullif(mayor, F.lit("")), acting)))
        return F.when(name != "", name).otherwise(office)

    return F.filter(F.transform(_parts(raw), one), lambda n: n.isNotNull())


def person_role(deposits: Column, answers: Column) -> Column:
    return F.when(((answers > 0) & (deposits == 0)) | ((answers >= 8) & (answers > deposits)), "college").otherwise("councillor")


#: The type of a filmed act that no point of the minutes has.
FILMED = "video"


def deposit_counts() -> list[Column]:
    """Deposits by type, and in all."""
    return [F.count_if(F.col("type") == "question_orale").alias("questions"), F.count_if(F.col("type") == "demande_habitant").alias("requests"), F.count_if(F.col("type") == "motion").alias("motions"), F.count_if(F.col("type") == FILMED).alias("videos"), F.count("*").alias("deposits")]


def person_activity(deposits: DataFrame, answers: DataFrame, least: int = 2) -> DataFrame:
    """Per person: deposits by type, answers, role; those with ``least`` or more in all."""
    return activity_of_counts(deposits.groupBy("key").agg(*deposit_counts()), answers.groupBy("key").agg(F.count("*").alias("answers")), least)


def activity_of_counts(deposits: DataFrame, answers: DataFrame, least: int = 2) -> DataFrame:
    """``person_activity`` of what is counted already: key and ``deposit_counts``, key and answers."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    x = deposits.join(answers, "key", "full").select("key", *(zero(c) for c in ("questions", "requests", "motions", "videos", "deposits", "answers")))
    return x.withColumn("role", person_role(F.col("deposits"), F.col("answers"))).filter(F.col("deposits") + F.col("answers") >= least)


def best_display_name(variants: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """Per key the name of most words, then characters, then the first by order, among those that end in the key and repeat
    no word; if none does, among all. ``overrides`` name keys that are only ever mentioned by surname."""
    x = variants.select("key", "name").distinct().withColumn("_t", F.transform(F.split("name", r"\s+"), norm_token))
    sound = (F.element_at("_t", -1) == F.col("key")) & (F.size(F.array_distinct("_t")) == F.size("_t"))
    x = x.select("key", "name", sound.cast("int").alias("_s"), F.size("_t").alias("_n"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("_s"), F.desc("_n"), F.desc(F.length("name")), "name"))
    best = x.withColumn("_p", place).filter("_p = 1").select("key", "name")
    if not overrides:
        return best
    told = F.element_at(F.create_map(*(F.lit(x) for kv in overrides.items() for x in kv)), F.col("key"))
    return best.withColumn("name", F.coalesce(told, "name"))


def resolve_display_names(mentions: DataFrame, registry: DataFrame, name: str | None = None) -> DataFrame:
    """``display`` of each mention's key: its canonical name, else the mention (without ``name`` the key) in title case, without titles."""
    own = title_case_name(clean_name(F.col(name or "key")))
    return mentions.join(registry.select("key", F.col("name").alias("_n")), "key", "left").withColumn("display", F.coalesce("_n", F.nullif(own, F.lit("")))).drop("_n")


def apply_author_overrides(points: DataFrame, overrides: DataFrame) -> DataFrame:
    """One row per point and author; an override of (meeting, sp), which may name several, replaces the point's own author."""
    x = points.join(overrides.select("meeting", "sp", F.col("authors").alias("_a")), ["meeting", "sp"], "left")
    return x.withColumn("author", F.explode_outer(F.coalesce("_a", F.array("author")))).drop("_a")


def enrich_variants(mentions: DataFrame, people: DataFrame, variants: DataFrame) -> DataFrame:
    """(key, name): the known ``variants`` and those of speakers whose key already is a person's; it adds no person."""
    return variants.select("key", "name").unionByName(mentions.select("key", "name").join(people.select("key"), "key", "left_semi")).distinct()


def rank_people(activity: DataFrame, least: int = 2, role: str | None = None) -> DataFrame:
    """People with ``least`` acts or more (of one role), most acts first, then most deposits, then by key."""
    x = activity.withColumn("total", F.col("deposits") + F.col("answers")).filter(F.col("total") >= least)
    return (x if role is None else x.filter(F.col("role") == role)).orderBy(F.desc("total"), F.desc("deposits"), "key")


def person_timeline(acts: DataFrame, key: str, year: int | None = None) -> DataFrame:
    """The acts of one person, newest first, then by number from the last; of one year where it is given."""
    x = acts.filter(F.col("key") == key)
    if year is not None:
        x = x.filter((F.col("date") >= f"{year}-01-01") & (F.col("date") < f"{year + 1}-01-01"))
    return x.orderBy(F.desc_nulls_last("date"), F.desc("sp"))


def years_covered(acts: DataFrame, key: str) -> DataFrame:
    """(year, acts) of one person, the newest year first; acts without a date are left out."""
    dated = acts.filter((F.col("key") == key) & F.col("date").isNotNull())
    return dated.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("acts")).orderBy(F.desc("year"))
