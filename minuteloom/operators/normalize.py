"""Raw records of models and page texts brought to one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minuteloom.functions import text as T

# fixed values: how the text of minutes tells its hours, offices and attendance
NAME = r"([A-ZÀ-Ý][\p{L}\p{N}_'\-]+(?:\s+[A-ZÀ-Ý][\p{L}\p{N}_'\-]+)*)"
ANY_NAME = r"([A-Za-zÀ-ÿ][\p{L}\p{N}_'\-]+(?:\s+[A-Za-zÀ-ÿ][\p{L}\p{N}_'\-]+)*)"
OPENED = r"(?i)ouvre\s+en\s+s[ÉÈée]ance\s+publique\s+[àÀ]\s+(\d{1,2})h(\d{0,2})"
CLOSED = r"(?i)s[Éée]ance\s+(?:publique\s+)?est\s+lev[Éé]e\s+[àÀ]\s+(\d{1,2})h(\d{0,2})"
PRESIDENT = NAME + r"\s*,?\s*Président\s+du\s+[Cc]onseil"
ACTING_MAYOR = r"(?i)" + ANY_NAME + r"\s*,?\s*Bourgmestre\s+ff"
MAYOR = NAME + r"\s*,?\s*Bourgmestre\b"
SECRETARY = NAME + r"\s*,?\s*Secrétaire\s+[Cc]ommunal\b"
PRESENT = r"(?is)PR[Éé]SENTS[^:]*:(.*?)(?:ABSENTS|EXCUS[Éé]S|EN D[Éé]BUT)"
FORMS_OF_ADDRESS = r"M\.-h\.|Mme-mevr\.|MM\.-hh\.|Mmes-mevr\."


def normalize_points(raw: DataFrame) -> DataFrame:
    """Raw points (texts and lists of texts, vote a struct of texts) in one shape; those without a number go.

    sp_raw keeps numbers that are text. The page stays as it came: its group is needed to check it. Missing votes have no
    type and 0 against; a missing type is ``point_normal``."""
    or_null = lambda c: F.nullif(T.clean_str(F.col(c)), F.lit(""))
    vote = F.struct(
        F.nullif(T.clean_str(F.col("vote.type")), F.lit("")).alias("type"), T.coerce_int(F.col("vote.pour")).alias("pour"), F.coalesce(T.coerce_int(F.col("vote.contre")), F.lit(0)).alias("contre"),
        F.coalesce(T.coerce_int(F.col("vote.abstentions")), F.lit(0)).alias("abstentions"),
    )
    made = {
        "sp_num": T.coerce_sp(F.col("sp")), "sp_raw": F.col("sp"), "urgence": T.coerce_bool(F.col("urgence")), "type": F.coalesce(or_null("type"), F.lit("point_normal")), "repondant": or_null("repondant"), "vote": vote,
        "montant_eur": T.coerce_amount(F.col("montant_eur")), "intervenants": T.clean_str_list(F.col("intervenants")), "thematiques": T.clean_str_list(F.col("thematiques")),
    }
    made |= {c: T.clean_str(F.col(c)) for c in ("rubrique", "sous_rubrique", "titre", "resume", "decision")}
    return raw.filter("sp is not null").withColumns(made).drop("sp")


def _hour(text: Column, pattern: str) -> Column:
    h, m = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when(h != "", F.concat(h, F.lit(":"), F.when(m == "", "00").otherwise(m)))


def _named(text: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(text, pattern, 1), r"\s+", " "), r"^[ :\-\t]+|[ :\-\t]+$", "")), F.lit(""))


def meeting_meta_from_text(pages: DataFrame, first: int = 2) -> DataFrame:
    """Per document: hours, president, mayor or acting mayor, secretary and attendance, from its ``first`` pages; what the
    text doesn't tell is null. pages: doc, page_num, text; repeated page numbers are taken in order of their texts."""
    place = F.row_number().over(Window.partitionBy("doc").orderBy("page_num", "text"))
    head = pages.withColumn("_p", place).filter(F.col("_p") <= first)
    x = head.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_p", "text"))), lambda p: p["text"]), " ").alias("t"))
    t = F.col("t")
    acting = _named(t, ACTING_MAYOR)
    n = F.regexp_count(F.regexp_extract(t, PRESENT, 1), F.lit(FORMS_OF_ADDRESS))
    return x.select(
        "doc", _hour(t, OPENED).alias("heure_ouverture"), _hour(t, CLOSED).alias("heure_cloture"), _named(t, PRESIDENT).alias("president"), acting.alias("bourgmestre_ff"),
        F.when(acting.isNull(), _named(t, MAYOR)).alias("bourgmestre"), _named(t, SECRETARY).alias("secretaire_communal"), F.when(n > 0, n).alias("presents_count"),
    )
