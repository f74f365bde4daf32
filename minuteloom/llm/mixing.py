"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A document of a source is wanted target / size-of-source times. The whole part is taken as it is; the
fractional parts are copy probabilities that are paired and moved from one document to another until one
of the two is 0 or 1. Blocks of documents of alike sizes are worked off first; what each leaves undecided
climbs a tree of nodes of bounded width, until one document of each size class is left. These are decided
from the largest on, each against the pooled rest of its source, which takes over the words that the rounding
so far has added or left out: what a source misses in the end is part of its smallest undecided document.
Equal rows (id, text and source) are one unit with several copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minuteloom.llm.common import few, session, stored, unit_hash

WIDTH = 64  # units of a node, expected
CLASSES = 4  # of size, for each doubling
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> and target: a water level over the weights, each source capped at ``most`` times its size.

    Sources by code point, null last, take the weights in turn. One row for each source."""
    every = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    x = sizes.withColumn("w", F.get(F.array(*map(F.lit, weights)), F.pmod(place - 1, F.lit(len(weights)))).cast("double"))
    x = x.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("want", F.sum("source_size").over(every) * F.lit(share))
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("want") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    x = x.withColumn("full", F.col("cap") / F.col("w") <= level)
    left = F.col("want") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every)
    open_w = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(every)
    return x.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(left / open_w * F.col("w"))).select("source", "source_size", "target")


def _pivot(a: Column, b: Column) -> Column:
    """struct(left, done): one of two units decided, the other with the rest of their probability."""
    s = a["prob"] + b["prob"]
    u = unit_hash(a["id"], a["h"], b["id"], b["h"], a["size"], b["size"], seed=29)
    small = s < 1
    first_stays = F.when(small, u >= b["prob"] / s).otherwise(u >= (1 - b["prob"]) / (2 - s))
    unit = lambda x, p: F.struct(x["size"].alias("size"), x["id"].alias("id"), x["h"].alias("h"), p.alias("prob"))
    decided, rest = F.when(small, 0.0).otherwise(1.0), F.when(small, s).otherwise(s - 1)
    return F.when(first_stays, F.struct(unit(a, rest).alias("left"), unit(b, decided).alias("done"))).otherwise(F.struct(unit(b, rest).alias("left"), unit(a, decided).alias("done")))


_UNIT = "struct<size:bigint,id:bigint,h:bigint,prob:double>"


def _listed(units: DataFrame, *keys: str) -> DataFrame:
    return units.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("size", "id", "h", "prob")), asc=False).alias("u"))


def _node(units: DataFrame, *keys: str) -> DataFrame:
    """Work off each group of undecided units: (keys, left, done array)."""
    start = F.struct(F.get("u", F.lit(0)).alias("left"), F.array().cast(f"array<{_UNIT}>").alias("done"))

    def step(acc: Column, b: Column) -> Column:
        p = _pivot(acc["left"], b)
        return F.struct(p["left"].alias("left"), F.concat(acc["done"], F.array(p["done"])).alias("done"))

    return _listed(units, *keys).select(*keys, F.aggregate(F.slice("u", F.lit(2), F.size("u")), start, step).alias("n")).select(*keys, "n.left", "n.done")


def _last(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """Decide the last units of each source (one of each size class) so that they hold the words in ``wanted``.

    From the largest on, a unit is 0 or 1 with its probability, once those of the rest are raised or lowered together so that
    they hold what is still wanted; what the unit then has too much or too little, the rest takes over."""
    same = F.col("source").eqNullSafe(F.col("_s"))
    x = _listed(units, "source").join(few(wanted.select(F.col("source").alias("_s"), "words")), same).drop("_s")
    total = lambda f: F.aggregate("u", F.lit(0.0), lambda a, b: a + f(b))
    start = F.struct(
        F.col("words").cast("double").alias("want"), total(lambda b: b["size"] * b["prob"]).alias("held"), total(lambda b: b["size"].cast("double")).alias("all"), F.array().cast(f"array<{_UNIT}>").alias("done")
    )

    def step(acc: Column, b: Column) -> Column:
        want, held, most = acc["want"], acc["held"], acc["all"]
        p = F.when(want <= held, b["prob"] * want / held).otherwise(1 - (1 - b["prob"]) * (most - want) / F.greatest(most - held, F.lit(1e-9)))
        taken = (unit_hash(b["id"], b["h"], b["size"], seed=31) < p).cast("double")
        unit = F.struct(b["size"].alias("size"), b["id"].alias("id"), b["h"].alias("h"), taken.alias("prob"))
        return F.struct((want - taken * b["size"]).alias("want"), (held - b["prob"] * b["size"]).alias("held"), (most - b["size"]).alias("all"), F.concat(acc["done"], F.array(unit)).alias("done"))

    return x.select("source", F.explode(F.aggregate("u", start, step)["done"]).alias("d")).select("source", "d.*")


def round_copies(units: DataFrame) -> DataFrame:
    """(source, id, h, size > 0, prob with 0 < prob < 1) -> (source, id, h, size, extra 0 or 1), each row decided once.

    In each source the words of the extras are those that its probabilities hold, but for part of a small unit."""
    units = units.withColumn("c", F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double")) * CLASSES).cast("int"))
    wanted = units.groupBy("source").agg(F.sum(F.col("size") * F.col("prob")).alias("words"))
    blocks = units.groupBy("source", "c").agg(F.ceil(F.count("*") / WIDTH).alias("blocks"))
    of = F.col("source").eqNullSafe(F.col("_s")) & (F.col("c") == F.col("_c"))
    dealt = units.join(few(blocks.select(F.col("source").alias("_s"), F.col("c").alias("_c"), "blocks")), of).drop("_s", "_c")
    level = dealt.withColumn("k", F.pmod(F.xxhash64("id", "h", F.lit(17)), F.col("blocks")))
    most = blocks.agg(F.max("blocks")).first()[0] or 1
    decided: list[DataFrame] = []
    while True:
        node = stored(_node(level, "source", "c", "k"), "mix-node")
        decided.append(node.select("source", F.explode("done").alias("d")).select("source", "d.*"))
        level = node.select("source", "c", F.floor(F.col("k") / WIDTH).alias("k"), "left.*")
        if most <= 1:
            break
        most = -(-most // WIDTH)
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    spent = out.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("size") * F.col("prob")).alias("spent"))
    wanted = wanted.join(spent, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", (F.col("words") - F.coalesce("spent", F.lit(0.0))).alias("words"))
    out = out.unionByName(_last(level, wanted))
    return out.select("source", "id", "h", "size", F.col("prob").cast("long").alias("extra"))


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per unit (rows of one id, text and source): id, h, source, size, source_size, target, rows, and copies of them all."""
    session(docs)
    each = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    units = stored(each.groupBy("source", "id", "h", "size").agg(F.count("*").alias("rows")), "mix-units")
    targets = source_targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")))
    wanted = F.when(F.col("size") > 0, F.coalesce(F.col("target") / F.col("source_size"), F.lit(0.0)) * F.col("rows")).otherwise(0.0)
    same = F.col("source").eqNullSafe(F.col("_source"))
    rated = units.join(few(targets.withColumnRenamed("source", "_source")), same).drop("_source").withColumn("wanted", wanted)
    near = F.abs(F.col("wanted") - F.round("wanted")) <= 1e-9
    rated = stored(rated.withColumn("whole", F.when(near, F.round("wanted")).otherwise(F.floor("wanted"))).withColumn("prob", F.when(near, 0.0).otherwise(F.col("wanted") - F.col("whole"))), "mix-rated")
    names = ("source", "id", "h", "size", "source_size", "target", "rows")
    fixed = rated.filter("prob = 0").select(*names, F.col("whole").cast("long").alias("copies"))
    extra = round_copies(rated.filter("prob > 0").select("source", "id", "h", "size", "prob"))
    extra = extra.select(F.col("source").alias("_s"), F.col("id").alias("_i"), F.col("h").alias("_h"), F.col("extra"))
    drawn = rated.filter("prob > 0")
    drawn = drawn.join(extra, (drawn["h"] == extra["_h"]) & drawn["id"].eqNullSafe(extra["_i"]) & drawn["source"].eqNullSafe(extra["_s"]))
    return fixed.unionByName(drawn.select(*names, (F.col("whole") + F.col("extra")).cast("long").alias("copies")))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: id, size (words), source, source_size, target, copies (0 to 2), taken = copies * size.

    Null and empty texts have size 0 and are never copied; null is a source of its own; copies of a unit of equal rows are
    shared evenly among them; other columns take no part; an empty table gives no rows. Alike in every run and order."""
    each = plan_mix(docs, id_col, text_col, source_col).withColumn("_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    copies = F.expr("copies div rows") + (F.col("_n") < F.col("copies") % F.col("rows")).cast("long")
    out = each.select("id", "size", "source_size", "target", copies.alias("copies"), "source")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.col("copies").cast("int"), F.col("source"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it; where a unit's rows differ in other columns and
    some are taken once more, these are the first by a hash of all columns, so the order of the rows decides nothing."""
    plan = plan_mix(docs, id_col, text_col, source_col).filter("copies > 0").select(F.col("id").alias("_i"), F.col("h").alias("_h"), F.col("source").alias("_s"), "copies", "rows")
    own = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_key"), F.col(source_col).alias("_source"))
    x = own.join(plan, (own["_key"] == plan["_h"]) & own["_id"].eqNullSafe(plan["_i"]) & own["_source"].eqNullSafe(plan["_s"]))
    even = x.filter("copies % rows = 0").select("_row", F.expr("copies div rows").alias("_n"))
    place = F.row_number().over(Window.partitionBy("_i", "_h", "_s").orderBy(F.xxhash64("_row")))
    odd = x.filter("copies % rows <> 0").withColumn("_place", place).select("_row", (F.expr("copies div rows") + (F.col("_place") <= F.col("copies") % F.col("rows")).cast("long")).alias("_n"))
    return even.unionByName(odd).filter("_n > 0").select("_row", F.explode(F.expr("array_repeat(0, cast(_n as int))"))).select("_row.*")
