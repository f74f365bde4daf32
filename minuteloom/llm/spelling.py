"""Spelling variants by asymmetric q-chunks: words one code point apart, and the form that each goes back to.

Of two words the shorter one contributes two disjoint chunks, its halves; the other all positional grams that can equal a
chunk: of its length, and shifted by at most one. One edit touches one chunk only, so the other is found in the longer word:
the first half in its place, the second one shifted by the difference of the lengths. Words that share a chunk meet in a
group; a group over ``GROUP`` words isn't paired: the stretch that may hold its edit is cut in two again and its words
deal themselves anew by what is then left unchanged, until groups are small or the stretch is one code point.

All of it are built-in expressions: texts are read once, words are counted before they are shuffled, and pairs come
from bounded groups only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minuteloom.llm.common import few, forget, session, stored

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of a group that are held against each other; larger groups are split.
GROUP = 64


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = 31, least_length: int = 7, least_n: int = 2) -> DataFrame:
    """(word, n): letter runs of whole texts, A-Z lower-cased, with their occurrences.

    Where ``noise`` divides h = crc32(id:run), the run loses its code point h % length. Words under ``least_length``
    code points or ``least_n`` occurrences are left out. A null text has no runs, a null id counts as the empty text."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("raw")).filter(F.length("raw") >= least_length)
    low = F.when(F.col("raw").rlike("[A-Z]"), F.translate("raw", UPPER, UPPER.lower())).otherwise(F.col("raw"))
    runs = runs.select("id", low.alias("run")).select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % noise == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


def _cut(word: Column, start: Column, end: Column | None = None) -> Column:
    """Code points from ``start`` up to ``end``, or to the last one."""
    return F.substring(word, start + 1, F.length(word) if end is None else end - start)


def _halves(rows: DataFrame) -> DataFrame:
    """Rows of (word, n, longer, lo, hi), an edit being between lo and hi, as two: with the stretch's first or its second half
    unchanged. ``longer`` is 1 where the word plays the one with a code point more; ``key`` tells what is unchanged."""
    mid = F.ceil((F.col("lo") + F.col("hi")) / 2).cast("int")
    spans = F.array(F.struct(mid.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), mid.alias("hi")))
    x = rows.withColumn("span", F.explode(spans)).select("word", "n", "longer", "span.lo", "span.hi").filter("lo < hi")
    kept = F.xxhash64(F.length("word") - F.col("longer"), "lo", "hi", _cut(F.col("word"), F.lit(0), F.col("lo")), _cut(F.col("word"), F.col("hi") + F.col("longer")))
    return x.withColumn("key", kept)


def _pairs(rows: DataFrame) -> DataFrame:
    """(word, near, near_n), both ways, each pair once, of groups that are small.

    Of the places where an inserted code point may stand, the last one counts: the pair is taken where that lies in the stretch."""
    one = F.struct("word", "n", "longer", "lo", "hi")
    groups = rows.groupBy("key").agg(F.collect_list(one).alias("all")).filter(F.size("all") > 1)
    x = groups.select(F.explode(F.filter("all", lambda w: w["longer"] == 0)).alias("a"), "all").select("a", F.explode("all").alias("b"))
    a, b, lo, hi = F.col("a.word"), F.col("b.word"), F.col("a.lo"), F.col("a.hi")
    same = (lo == F.col("b.lo")) & (hi == F.col("b.hi")) & (F.length(b) == F.length(a) + F.col("b.longer"))
    kept = (_cut(a, F.lit(0), lo) == _cut(b, F.lit(0), lo)) & (_cut(a, hi) == _cut(b, hi + F.col("b.longer")))
    once = F.when(F.col("b.longer") == 0, a < b).otherwise((hi == F.length(a)) | (_cut(a, F.lit(0), hi) != _cut(b, F.lit(0), hi)))
    near = x.filter(same & once & kept & (F.levenshtein(a, b, 1) == 1))
    both = F.array(F.struct(a.alias("word"), b.alias("near"), F.col("b.n").alias("near_n")), F.struct(b.alias("word"), a.alias("near"), F.col("a.n").alias("near_n")))
    return near.select(F.explode(both).alias("p")).select("p.*")


def near_words(words: DataFrame, group: int = GROUP, made: list[DataFrame] | None = None) -> DataFrame:
    """(word, near, near_n): all pairs of the table (word, n) that differ by one inserted, deleted or replaced code point, both ways.

    ``made`` gets the tables that the result reads, to be removed once it is written."""
    made = [] if made is None else made
    length = F.length("word").cast("int")
    roles = F.explode(F.array(F.lit(0), F.lit(1))).alias("longer")
    at = _halves(words.filter(length > 0).select("word", "n", roles).withColumns({"lo": F.lit(0), "hi": length - F.col("longer")}))
    found, step = None, 0
    while True:
        sizes = at.groupBy("key").agg(F.count("*").alias("size"), F.max(F.col("hi") - F.col("lo")).alias("span"))
        large = stored(sizes.filter((F.col("size") > group) & (F.col("span") > 1)).select("key"), "large")
        made.append(large)
        any_large = bool(large.take(1))
        small = at.join(few(large), "key", "left_anti") if any_large else at
        found = _pairs(small) if found is None else found.unionByName(_pairs(small))
        if not any_large:
            return found
        step += 1
        at = stored(_halves(at.join(few(large), "key", "left_semi").drop("key")), f"halves-{step}")
        made.append(at)


def spelling_forms(words: DataFrame, times: int = 10, group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of (word, n).

    The form is the near word of the largest n, ties to the smallest in code-point order, if that n is ``times`` the word's or
    more. The root is where forms lead in the end; each step multiplies n by ``times``, so that the largest n bounds their number."""
    session(words)
    words = stored(words, "words")
    made = [words]
    by = F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))
    best = stored(near_words(words, group, made).groupBy("word").agg(F.count("*").alias("n_near"), F.min(by).alias("best")), "near")
    least = words.join(best, "word", "left")
    to = F.when(-F.col("best.n") >= times * F.col("n"), F.col("best.word"))
    formed = stored(least.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), to.alias("form"), F.when(to.isNotNull(), -F.col("best.n")).alias("form_n")), "forms")
    top, low = words.agg(F.max("n"), F.min("n")).first()
    depth = math.log(max(top or 1, 1) / max(low or 1, 1), times) if times > 1 else 0
    forget(*made, best)
    roots = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(depth, 1))))):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        roots = stored(roots.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")), "roots")
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``spelling_forms`` of the words of whole texts; an empty table gives no rows, repeated rows count again, other columns are left aside."""
    return spelling_forms(counted_words(docs, id_col, text_col))
