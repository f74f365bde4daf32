"""Chat formatting by schema fingerprints: records of unlike layouts become canonical turns, then text with a loss mask.

A record's schema is the set of its nested field paths (``messages[].role``); its hash selects a declarative mapping. Paths that
no mapping knows (ids, metadata) are left out of the hash; where a record has the paths of more than one mapping, the one with
the most paths of the record counts. Only distinct schemas are looked up, the rest are column expressions over the parsed record.

The template marks turns. Control strings within roles and texts, those of other common templates included, are broken up by an
escape mark after their first character, and the escape mark itself is doubled, so that reading gives back what was written."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minuteloom.llm.common import few, session, stored

ESCAPE = "␛"
START, SAYS, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
# fixed values: control strings of public chat templates
CONTROL = (
    "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<start_of_turn>", "<end_of_turn>", "<|user|>", "<|assistant|>", "<|system|>", "<|end|>",
)
#: Cost of the turns of one record where a conversation is cut: each counts 1, and 1 more for so many bytes.
RECORD_COST, COST_BYTES = 64, 16_384


@dataclass(frozen=True)
class Layout:
    """Where turns lie in a record: under each element of the array ``each``, or, where that is empty, in ``fixed`` paths.

    ``fixed`` has (role, paths): the texts of a turn, non-empty ones joined by a blank line; ``optional`` paths may be absent, and a
    turn of which all are is left out. ``roles`` renames the roles that the record uses."""

    name: str
    each: str = ""
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    def required(self) -> frozenset[str]:
        if self.each:
            return frozenset({f"{self.each}[].{self.role}", f"{self.each}[].{self.text}"})
        return frozenset(p for _, paths in self.fixed for p in paths) - set(self.optional)

    def turns(self, record: str = "record") -> Column:
        """array<struct<role, text>> of the parsed record; null texts and roles are empty."""
        get = lambda of, path, kind: f"try_variant_get({of}, '$.{path}', '{kind}')"
        if self.each:
            role, text = (F.expr(f"transform({get(record, self.each, 'array<variant>')}, m -> coalesce({get('m', p, 'string')}, ''))") for p in (self.role, self.text))
            named = F.transform(role, lambda r: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in self.roles.items() for x in kv)), r), r)) if self.roles else role
            return F.arrays_zip(named.alias("role"), text.alias("text"))
        turn = lambda role, paths: F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*(F.expr(f"coalesce({get(record, p, 'string')}, '')") for p in paths)), lambda x: x != ""), "\n\n").alias("text"))
        there = lambda paths: F.lit(True) if set(paths) - set(self.optional) else F.exists(F.array(*(F.expr(get(record, p, "variant")) for p in paths)), lambda x: x.isNotNull())
        return F.filter(F.array(*(F.when(there(paths), turn(role, paths)) for role, paths in self.fixed)), lambda t: t.isNotNull())


LAYOUTS = (
    Layout("messages", each="messages", role="role", text="content"),
    Layout("exchange", each="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Layout("dialog", each="data.dialog", role="speaker.type", text="utterance.text"),
    Layout("prompt", fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Layout("completion", fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction", fixed=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
)


def paths_of(schema: str) -> frozenset[str]:
    """The paths of the leaves of a schema as ``schema_of_variant`` writes it: OBJECT<a: ARRAY<OBJECT<b: STRING>>> has a[].b."""
    out, at, named = set(), [], re.compile(r"\s*(?:`((?:[^`]|``)*)`|([^:<>,`]+)):\s*")
    i = 0
    while i < len(schema):
        if schema.startswith("OBJECT<", i):
            at.append("object")
            i += 7
        elif schema.startswith("ARRAY<", i):
            at.append("[]")
            i += 6
        elif at and at[-1] == "object" and (m := named.match(schema, i)):
            at.append("." + (m[1].replace("``", "`") if m[1] is not None else m[2]))
            i = m.end()
        elif schema[i] in ">,":
            while at and at[-1][0] == ".":
                at.pop()
            if schema[i] == ">":
                at.pop()
                while at and at[-1][0] == ".":
                    at.pop()
            i += 1
        elif schema[i] == " ":
            i += 1
        else:  # a type without parts, as DECIMAL(3,1)
            out.add("".join(x for x in at if x != "object").removeprefix("."))
            i = re.compile(r"\w+(?:\([^)]*\))?").match(schema, i).end()
    return frozenset(out)


def fingerprint(paths: frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def selector(layouts: tuple[Layout, ...]):
    """A function from a schema to its fingerprint and the name of its layout, None where none fits."""
    known = frozenset(p for x in layouts for p in x.required() | set(x.optional))
    exact = {}
    for x in layouts:
        for n in range(1 << len(x.optional)):
            exact.setdefault(fingerprint(x.required() | {p for i, p in enumerate(x.optional) if n >> i & 1}), x.name)

    def select(schema: str) -> tuple[str, str | None]:
        paths = paths_of(schema)
        key = fingerprint(paths & known)
        if key not in exact:
            fit = [x for x in layouts if x.required() <= paths]
            return key, max(fit, key=lambda x: len(paths & (x.required() | set(x.optional)))).name if fit else None
        return key, exact[key]

    return select


def canonical_turns(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The records with ``fingerprint``, ``layout`` and ``turns`` (array of role and text); the columns in between are the caller's.

    Null or malformed records, and those of a layout that no mapping fits, stay with a null layout and null turns. An array of no
    turns gives an empty list where another path names the layout; else its layout is unknown."""
    session(records)
    select = selector(layouts)

    @F.pandas_udf("fingerprint string, layout string")
    def chosen(schema: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([select(s) for s in schema], columns=["fingerprint", "layout"])

    parsed = records.withColumn("_parsed", F.try_parse_json(record_col)).withColumn("_schema", F.schema_of_variant("_parsed").cast("string"))
    schemas = parsed.filter("_schema is not null").select("_schema").distinct()
    known = stored(schemas.withColumn("_of", chosen("_schema")).select("_schema", "_of.*"), "schemas")
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for x in layouts:
        turns = F.when(F.col("layout") == x.name, x.turns("_parsed")).otherwise(turns)
    return parsed.join(few(known), "_schema", "left").withColumn("turns", turns).drop("_schema", "_parsed")


def escaped(text: Column) -> Column:
    starts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)
    return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), f"({starts})", f"$1{ESCAPE}")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, f"{ESCAPE}({ESCAPE}?)", "$1")


def formatted(turns: Column, learn: str = "assistant") -> tuple[Column, Column]:
    """The text of the turns, and the spans (start, end, in code points) of the texts of the role that is learnt from."""
    parts = F.transform(turns, lambda t: F.struct(F.concat(F.lit(START), escaped(t["role"]), F.lit(SAYS)).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == learn).alias("learnt")))
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(at: Column, p: Column) -> Column:
        start = at["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        return F.struct((end + len(END)).alias("at"), F.when(p["learnt"], F.array_append(at["spans"], F.struct(start.alias("start"), end.alias("end")))).otherwise(at["spans"]).alias("spans"))

    return text, F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda at: at["spans"])


def format_chats(canonical: DataFrame, learn: str = "assistant") -> DataFrame:
    """``formatted`` and ``loss`` of the column ``turns``, which goes; null turns give nulls."""
    text, loss = formatted(F.col("turns"), learn)
    return canonical.withColumns({"formatted": text, "loss": loss}).drop("turns")


def read_turns(text: Column) -> Column:
    """array<struct<role, text>>: what a formatted text says."""
    part = lambda n: F.regexp_extract_all(text, F.lit(f"(?s){re.escape(START)}(.*?){re.escape(SAYS)}(.*?){re.escape(END)}"), F.lit(n))
    return F.transform(F.arrays_zip(part(1).alias("role"), part(2).alias("text")), lambda t: F.struct(unescaped(t["role"]).alias("role"), unescaped(t["text"]).alias("text")))


def learnt_text(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(text, s["start"] + 1, s["end"] - s["start"]))), "")


def records_of(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, parts, record): conversations given by row, as JSON records in the layout that their turns suit.

    Null roles and texts are empty, equal turns go by role and text. A long conversation is cut into records of bounded cost, so
    no record outgrows a task; two turns become a prompt or an instruction, others a list in one of three forms."""
    x = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cost = 1 + F.floor(F.octet_length("text") / COST_BYTES)
    before = F.sum(cost).over(Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    x = x.withColumns({"part": F.floor(F.coalesce(before, F.lit(0)) / RECORD_COST), "place": place})
    x = x.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("t"))
    x = x.withColumn("parts", F.count("*").over(Window.partitionBy("conv_id")))
    roles, text = F.transform("t", lambda t: t["role"]), lambda i: F.col("t")[i]["text"]
    told = lambda *names: roles == F.array(*map(F.lit, names))
    plain, form = F.forall(roles, lambda r: r.isin("user", "assistant", "system")), F.pmod(F.xxhash64("conv_id"), F.lit(3))
    name = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    say = lambda make: F.transform("t", make)
    record = (
        F.when(told("user", "assistant") & (form == 0), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when(told("user", "assistant") & (form == 1), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion"))))
        .when(told("user", "assistant"), F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("output"))))
        .when(told("system", "user", "assistant"), F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output"))))
        .when(plain & (form == 0), F.to_json(F.struct(say(lambda t: F.struct(name(t["role"]).alias("from"), t["text"].alias("value"))).alias("conversations"))))
        .when(form == 1, F.to_json(F.struct(F.struct(say(lambda t: F.struct(F.struct(t["role"].alias("type")).alias("speaker"), F.struct(t["text"].alias("text")).alias("utterance"))).alias("dialog")).alias("data"))))
        .otherwise(F.to_json(F.struct(say(lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))))
    )
    return x.select("conv_id", "part", "parts", record.alias("record"))


def digests(chats: DataFrame) -> DataFrame:
    """What formatted conversations (conv_id, part, parts, formatted, loss) say: a row for each, with digests of its turns and of what is learnt.

    A conversation of one record needs no shuffle; those of more are read part by part in order, and only the state of the hash is kept."""
    said = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    x = chats.select("conv_id", "part", "parts", F.size(read_turns(F.col("formatted"))).cast("long").alias("n"), said.alias("said"), learnt_text(F.col("formatted"), F.col("loss")).alias("learnt"), F.length("formatted").cast("long").alias("chars"))
    one = x.filter("parts = 1").select("conv_id", F.col("n").alias("n_turns"), F.sha2("said", 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), F.col("chars").alias("formatted_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, turns, learnt, sums = None, False, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
        told = lambda: pa.RecordBatch.from_pylist([{"conv_id": now, "n_turns": sums[0], "turns_sha256": turns.hexdigest(), "loss_chars": sums[1], "loss_sha256": learnt.hexdigest(), "formatted_chars": sums[2]}], schema=shape)
        shape = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for b in batches:
            for r in b.to_pylist():
                if begun and r["conv_id"] != now:
                    yield told()
                    turns, learnt, sums = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                now, begun = r["conv_id"], True
                turns.update(r["said"].encode())
                learnt.update(r["learnt"].encode())
                sums = [sums[0] + r["n"], sums[1] + len(r["learnt"]), sums[2] + r["chars"]]
        if begun:
            yield told()

    many = x.filter("parts > 1").withColumn("conv_id", F.col("conv_id").cast("long")).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return one.unionByName(many.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))
