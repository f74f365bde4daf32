"""N-gram Jaccard join with a token-group matrix.

Every text becomes the set of its hashed word shingles. Equal sets are one. The tokens of a set are put in
one order for all sets (those known to be frequent last), so two sets that reach the similarity share a
token among their first ones. Sets that share such a token with a leader, then with a few partners, are
compared with it; the confirmed links join similar documents, and links within a part need no further
comparison, so large groups of copies never become pairs. What is left are links between parts: each part is
cut into groups of bounded size. Sets of smaller parts that share a first token with a larger one, in a place
that admits a link, ask its groups, unless the parities that a group's members have in common rule it out. A group stores the union of its members' tokens; the number of a query's
tokens in that union bounds what any member shares with it, and only groups whose bound reaches the
similarity are opened and compared member by member. No link between different parts is lost."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minuteloom.llm.common import few, session, stored
from minuteloom.llm.components import components

SHINGLE = 5
PARITY_WORDS = 16  # of 64 bits
COUNT_BLOCK = 2_000_000
#: Bound of the table of frequent tokens that tasks get. It only orders tokens; any order gives the same links.
FREQUENT_ROWS = 300_000
LEADER_ROWS = 2_000  # about so many sets follow one leader of a frequent token
LEADERS = 3  # that a set is compared with before groups are formed, and tokens by which it draws partners
PARTNERS, TURNS = 6, 1
#: Up to so many rows are broadcast, their number checked; more of them are joined by hash.
PICKED = 1_000_000
#: Sets and tokens of a group, expected; queries that one copy of a group meets.
PAGE, PAGE_TOKENS, ASKS = 64, 2_000_000, 1_000
RUN_BYTES = 1 << 17
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64, by doubling."""
    out = np.ones(n, np.uint64)
    k, step = 1, base
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(step)
        k, step = 2 * k, step * step % (1 << 64)
    return out


_BASE = 0x5851F42D4C957F2D
_UP, _DOWN = _powers(_BASE, RUN_BYTES), _powers(pow(_BASE, -1, 1 << 64), RUN_BYTES)
_CODE = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
_CODE[65:91] = _CODE[97:123]
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def texts_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each text of an Arrow column, without copies; null counts as empty."""
    large = pa.types.is_large_string(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    for a, b, known in zip(ends[:-1], ends[1:], column.is_valid().to_numpy(zero_copy_only=False)):
        yield data[a:b] if known else data[:0]


def word_hashes(text: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z as a-z: a polynomial over each word's bytes, from sums over whole runs of text.

    A text is worked through in runs that end at white space; a word of RUN_BYTES or more is hashed by itself."""
    out, at, n = [], 0, len(text)
    while at < n:
        end = n
        if n - at >= RUN_BYTES:
            gaps = np.flatnonzero(_SPACE[text[at : at + RUN_BYTES]])
            if not len(gaps):
                rest = np.flatnonzero(_SPACE[text[at:]])
                end = at + int(rest[0]) if len(rest) else n
                out.append(np.array([xxhash.xxh3_64_intdigest(text[at:end].tobytes().lower())], np.uint64))
                at = end
                continue
            end = at + int(gaps[-1]) + 1
        run = text[at:end]
        inside = np.zeros(len(run) + 2, bool)
        inside[1:-1] = ~_SPACE[run]
        bounds = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = bounds[::2], bounds[1::2]
        sums = np.zeros(len(run) + 1, np.uint64)
        np.cumsum(_CODE[run] * _UP[: len(run)], out=sums[1:])
        h = (sums[last] - sums[first]) * _DOWN[first] ^ (last - first).astype(np.uint64) * _MIX[3]
        out.append((h ^ h >> np.uint64(32)) * _MIX[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: np.ndarray) -> np.ndarray:
    """The sorted set of hashed shingles; with fewer words the whole sequence as one; without words empty."""
    h = word_hashes(text)
    if not len(h):
        return np.zeros(0, np.int64)
    k = min(SHINGLE, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        s = (s ^ h[j : len(h) - k + 1 + j]) * _MIX[j]
        s ^= s >> np.uint64(29)
    s = s.view(np.int64)
    s.sort()
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    return s[new]


def set_id(s: np.ndarray) -> int:
    """Equal sets have equal ids; that different ones do has a chance of pairs / 2 ** 64."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)))))


def parity(s: np.ndarray) -> np.ndarray:
    """Parity of the number of tokens in each of 64 * PARITY_WORDS bins: sets differ in no fewer tokens than their parities in bins."""
    bits = np.bincount(((s.view(np.uint64) * _MIX[1]) >> np.uint64(54)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def prefix_length(n: np.ndarray | int):
    """Two sets of similarity 0.75 or more share a token among so many first ones of each."""
    return n - -(-3 * n // 4) + 1


def enough(n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """Whether sets of n1 and n2 tokens whose first common token has p1 and p2 tokens before it can reach 7 * common >= 3 * (n1 + n2)."""
    need = 3 * (n1 + n2)
    return (4 * F.least(n1, n2) >= 3 * F.greatest(n1, n2)) & (7 * (n1 - p1) >= need) & (7 * (n2 - p2) >= need)


def document_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, n, sid, parity) for every row, h telling texts of one id apart, and rows of (tokens, times) without n: each task counts the tokens of all of
    its texts in blocks and reports those that a block has more than once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        kind = pa.list_(pa.int64())
        names = ["doc_id", "h", "n", "sid", "parity", "tokens", "times"]

        def report() -> pa.RecordBatch:
            token, times = np.unique(np.concatenate(held), return_counts=True)
            token, times = token[times > 1], times[times > 1]
            starts = range(0, len(token), 10_000)
            cut = lambda x: pa.array([x[i : i + 10_000] for i in starts], kind)
            none = lambda t: pa.nulls(len(starts), t)
            return pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int64()), none(pa.int32()), none(pa.int64()), none(kind), cut(token), cut(times)], names)

        for b in batches:
            sets = [shingles(t) for t in texts_of(b.column(2))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int32()), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], kind), pa.nulls(len(sets), kind), pa.nulls(len(sets), kind)],
                names)
            held += sets
            size += sum(map(len, sets))
            if size >= COUNT_BLOCK:
                yield report()
                held, size = [], 0
        if size:
            yield report()

    schema = "doc_id long, h long, n int, sid long, parity array<long>, tokens array<long>, times array<long>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).mapInArrow(scan, schema)


def frequent_tokens(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens of ``document_sets``, sorted, and their counts."""
    each = rows.filter("n is null").select(F.explode(F.arrays_zip("tokens", "times")).alias("t")).select(F.col("t.tokens").alias("token"), F.col("t.times").alias("times"))
    top = each.groupBy("token").agg(F.sum("times").alias("times")).filter("times > 2").orderBy(F.desc("times"), "token").limit(FREQUENT_ROWS).toArrow()
    token, times = top["token"].to_numpy(), top["times"].to_numpy()
    order = np.argsort(token)
    return token[order], times[order]


def first_tokens(docs: DataFrame, text_col: str, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(token, salt, sid, size_place) for the first tokens of every set. salt: -1, or the part of a frequent token's sets
    that this set belongs to. size_place: the set's size times 2 ** 32 plus the token's place. A set that a task has seen
    lately is not repeated."""
    known, counts = frequent

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            parts: list[tuple] = []
            for t in texts_of(b.column(0)):
                s = shingles(t)
                n = len(s)
                if not n or (sid := set_id(s)) in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(sid)
                k = prefix_length(n)
                times = np.zeros(n, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    times = np.where(known[at] == s, counts[at], 0)
                order = np.lexsort((s, times))[:k] if times.any() else np.arange(k)
                c = times[order]
                salt = np.where(c > LEADER_ROWS, np.int64(sid % (1 << 31)) % np.maximum(1, c // LEADER_ROWS), -1)
                parts.append((s[order], salt, np.full(k, sid, np.int64), (np.int64(n) << 32) + np.arange(k)))
            if parts:
                cols = [np.concatenate(x) for x in zip(*parts)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1].astype(np.int32)), pa.array(cols[2]), pa.array(cols[3])], ["token", "salt", "sid", "size_place"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(scan, "token long, salt int, sid long, size_place long")


def _size(c: Column | str) -> Column:
    return F.shiftright(c, 32).cast("long")


def _place(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).bitwiseAND(F.lit((1 << 32) - 1))


def leader_pairs(shared: DataFrame) -> DataFrame:
    """(q, g): each set with the leaders that most of its shared tokens have, where sizes and places admit a link.

    A few leaders are enough here: what they leave apart is compared when groups are opened."""
    admitted = enough(_size("size_place"), _place("size_place"), _size("lead.size_place"), _place(F.col("lead.size_place")))
    pair = lambda df: df.filter((F.col("sid") != F.col("lead.sid")) & admitted).select("sid", F.col("lead.sid").alias("lead"))
    leads = shared.filter("salt >= 0").select("token", "lead.sid", "lead.size_place").distinct()
    over = leads.groupBy("token").agg(F.min(F.struct("sid", "size_place")).alias("lead"))
    votes = pair(shared).unionByName(pair(leads.join(over, "token"))).groupBy("sid", "lead").count()
    place = F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("count"), "lead"))
    return votes.withColumn("place", place).filter(F.col("place") <= LEADERS).select(F.col("sid").alias("q"), F.col("lead").alias("g"))


def named_sets(sets: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """(key, n of it, parity of it) of those sets whose ids are asked for; no other is shuffled while the ids are few."""
    rows = sets.join(few(ids.distinct(), PICKED), "sid", "left_semi")
    return rows.select(F.col("sid").alias(key), F.col("n").alias(f"n{key}"), F.col("parity").alias(f"p{key}"))


def _ones(bits: Callable[[int], Column]) -> Column:
    return reduce(add, (F.bit_count(bits(i)) for i in range(PARITY_WORDS)))


def near(asks: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (q, g) of sets that parities leave possible."""
    asks = stored(asks, "asked-pairs")
    side = lambda k: named_sets(sets, asks.select(F.col(k).alias("sid")), k)
    apart, total = _ones(lambda i: F.col("pq")[i].bitwiseXOR(F.col("pg")[i])), F.col("nq") + F.col("ng")
    # twice the overlap is at most total - apart
    return asks.join(side("q"), "q").join(side("g"), "g").filter(7 * (total - apart) >= 6 * total).select("q", "g")


def near_groups(asks: DataFrame, members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (q, g) of sets and groups that parities leave possible, and the rows (g, m) of groups that are asked.

    A group's row has the bits that all of its members have and those that any has: from each member a query differs in no
    fewer bins than those where it lacks the former or exceeds the latter."""
    asks = stored(asks, "asked-groups")
    members = stored(members.join(few(asks.select("g").distinct(), PICKED), "g", "left_semi"), "asked-members")
    held = members.join(named_sets(sets, members.select(F.col("m").alias("sid")), "m"), "m")
    bits = [f(F.col("pm")[i]).alias(f"{name}{i}") for name, f in (("all", F.bit_and), ("any", F.bit_or)) for i in range(PARITY_WORDS)]
    groups = held.groupBy("g").agg(F.max("nm").alias("most"), *bits)
    both = asks.join(named_sets(sets, asks.select(F.col("q").alias("sid")), "q"), "q").join(groups, "g")
    pq = lambda i: F.col("pq")[i]
    apart = _ones(lambda i: pq(i).bitwiseAND(F.bitwise_not(f"any{i}"))) + _ones(lambda i: F.bitwise_not(pq(i)).bitwiseAND(F.col(f"all{i}")))
    # a member has most tokens at most, and 4 / 3 of the query's where they are linked
    return both.filter(3 * F.col("nq") + F.least(3 * F.col("most"), 4 * F.col("nq")) >= 21 * apart).select("q", "g"), members


class Group:
    """A group's rows of the matrix: its members' sets and the union of their tokens."""

    def __init__(self):
        self.ids: list[int] = []
        self.sets: list[np.ndarray] = []
        self.union: np.ndarray | None = None

    def add(self, sid: int, s: np.ndarray) -> None:
        self.ids.append(sid)
        self.sets.append(s)
        self.union = None

    def linked(self, s: np.ndarray) -> list[int]:
        """The members whose similarity to the query is 0.75 or more."""
        if self.union is None:
            self.sizes = np.array([len(x) for x in self.sets])
            self.tokens, self.owner = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), self.sizes)
            self.union = np.unique(self.tokens) if len(self.sets) > 1 else self.tokens
        n, at = len(s), np.searchsorted(self.union, s)
        overlap = int((self.union[np.minimum(at, len(self.union) - 1)] == s).sum())
        # a member of size k shares min(overlap, k) tokens at most, and 7 * shared >= 3 * (n + k) is asked
        fits = (7 * np.minimum(overlap, self.sizes) >= 3 * (n + self.sizes)) & (4 * np.minimum(n, self.sizes) >= 3 * np.maximum(n, self.sizes))
        if not fits.any():
            return []
        mine = fits[self.owner]
        tokens, owner = self.tokens[mine], self.owner[mine]
        at = np.minimum(np.searchsorted(s, tokens), n - 1)
        common = np.bincount(owner[s[at] == tokens], minlength=len(self.sets))
        return [self.ids[i] for i in np.flatnonzero(fits & (7 * common >= 3 * (n + self.sizes)))]


def opened(asks: DataFrame, members: DataFrame, sets: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(u, v): the sets u that ask a group and its members v of similarity 0.75 or more.

    asks: distinct (q, g); members: (g, m). The texts of these sets are read again and dealt by group; a group that many
    ask has a copy for each ASKS queries, so neither a text is repeated for each pair nor does a task hold many groups."""
    asks = stored(asks, "asks")
    if asks.isEmpty():
        return asks.select(F.col("q").alias("u"), F.col("g").alias("v"))
    parts = few(asks.groupBy("g").agg(F.ceil(F.count("*") / ASKS).alias("parts")), PICKED)
    rows = asks.join(parts, "g").select("g", F.pmod(F.xxhash64("q"), "parts").alias("part"), F.lit(1).alias("kind"), F.col("q").alias("sid"))
    held = members.join(parts, "g").select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("m").alias("sid"))
    wanted = rows.unionByName(held).join(sets.select("sid", F.col("id").alias("_id"), F.col("h").alias("_h")), "sid")
    wanted = stored(wanted, "asks-of-parts")
    text = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("text"))
    # where the rows are few they go to the texts, which then move once, to their groups
    dealt = text.join(few(wanted, PICKED), text["_h"].eqNullSafe(wanted["_h"]) & text["_id"].eqNullSafe(wanted["_id"])).select("g", "part", "kind", "sid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, Group()
        for b in batches:
            u, v = [], []
            for g, part, kind, sid, t in zip(*(b.column(i).to_pylist() for i in range(4)), texts_of(b.column(4))):
                if now != (g, part):
                    now, group, last = (g, part), Group(), None
                if (kind, sid) == last:  # another row of the same id and text
                    continue
                last = (kind, sid)
                s = shingles(t)
                if kind == 0:
                    group.add(sid, s)
                elif group.ids:
                    found = group.linked(s)
                    u += [sid] * len(found)
                    v += found
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    dealt = dealt.repartition("g", "part").sortWithinPartitions("g", "part", "kind", "sid")
    return dealt.mapInArrow(run, "u long, v long").filter("u <> v")


def paired(asks: DataFrame, sets: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``opened`` where each group is one set."""
    asks = stored(near(asks, sets), "near-pairs")
    return opened(asks, asks.select("g", F.col("g").alias("m")).distinct(), sets, docs, id_col, text_col)


def mixed_tokens(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(token, sid, n, p, comp, members): the rows of tokens that sets of different parts share, with the size of their part."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("members"))
    named = labels.join(few(sizes, PICKED), "label", "inner").select(F.col("node").alias("sid"), "label", "members")
    x = shared.select("token", "sid", "n", "p").join(few(named, PICKED), "sid", "left")
    x = x.select("token", "sid", "n", "p", F.coalesce("label", "sid").alias("comp"), F.coalesce("members", F.lit(1)).alias("members"))
    mixed = x.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token")
    return stored(x.join(mixed, "token", "left_semi"), "mixed-tokens")


def partner_pairs(x: DataFrame, turn: int) -> DataFrame:
    """(q, g): each set with partners of other parts, drawn from those that share a few of its tokens.

    One turn joins most of a large group of near copies; what it leaves apart is compared when groups are opened."""
    draw = lambda i: F.min_by(F.struct("sid", "n", "p", "comp"), F.xxhash64("sid", F.lit(100 * turn + i)))
    x = x.filter(7 * F.col("p") <= F.col("n"))  # later tokens admit no set of about this size
    partners = x.groupBy("token").agg(F.array_distinct(F.array(*(draw(i) for i in range(PARTNERS)))).alias("with"))
    place = F.row_number().over(Window.partitionBy("sid").orderBy(F.xxhash64("token", F.lit(turn))))
    asking = x.withColumn("place", place).filter(F.col("place") <= LEADERS).join(partners, "token")
    fits = lambda o: (o["comp"] != F.col("comp")) & enough(F.col("n"), F.col("p"), o["n"], o["p"])
    o = asking.select("sid", F.explode(F.filter("with", fits)).alias("o"))
    return o.select(F.col("sid").alias("q"), F.col("o.sid").alias("g")).distinct()


def group_asks(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(q, g) and (g, m): the groups that sets ask, and their members.

    A part's first tokens, with the least and most size and the most tokens that can follow, are its row of the matrix; a
    set asks the groups of parts that are larger than its own (of equal size: have a larger label) where these admit a link."""
    # groups of a part: as many as its sets and their tokens ask for
    each = x.groupBy("sid", "comp").agg(F.first("n").alias("n"))
    pages = F.greatest(F.ceil(F.count("*") / PAGE), F.ceil(F.sum("n") / PAGE_TOKENS)).cast("int")
    large = each.groupBy("comp").agg(pages.alias("pages")).filter("pages > 1")
    page = lambda k: F.xxhash64("comp", k)
    members = each.join(few(large, PICKED), "comp", "left").select(page(F.pmod("sid", F.coalesce("pages", F.lit(1)))).alias("g"), F.col("sid").alias("m"))
    matrix = x.groupBy("token", "comp", "members").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("p")).alias("rest"))
    q = x.select("token", F.col("sid").alias("q"), F.col("n").alias("nq"), F.col("p").alias("pq"), F.struct("members", "comp").alias("own"))
    nearest = F.greatest(F.col("least"), F.ceil(3 * F.col("nq") / 4))  # the smallest size that a partner in the part can have
    admits = (F.col("own") < F.struct("members", "comp")) & (4 * F.col("most") >= 3 * F.col("nq")) & (3 * F.col("least") <= 4 * F.col("nq")) & (7 * F.least(F.col("nq") - F.col("pq"), F.col("rest")) >= 3 * (F.col("nq") + nearest))
    asked = q.join(matrix, "token").filter(admits).select("q", "comp").distinct()
    asks = asked.join(few(large, PICKED), "comp", "left").select("q", "comp", F.explode(F.sequence(F.lit(0), F.coalesce("pages", F.lit(1)) - 1)).alias("k")).select("q", page(F.col("k").cast("long")).alias("g"))
    return asks, members


def linked_sets(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, n, sid) of each row, and (sid, label, component_id) of each set that isn't empty: the part it belongs to and
    that part's smallest id, null where no row has one."""
    session(docs)
    rows = stored(document_sets(docs, id_col, text_col), "document-sets")
    frequent = frequent_tokens(rows)
    rows = rows.filter("n is not null").drop("tokens", "times")
    first = F.min(F.struct("doc_id", "h")).alias("of")
    sets = rows.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"), first, F.first("n").alias("n"), F.first("parity").alias("parity"))
    sets = stored(sets.select("sid", "rep", F.col("of.doc_id").alias("id"), F.col("of.h").alias("h"), "n", "parity"), "distinct-sets")
    by = Window.partitionBy("token", "salt")
    tokens = first_tokens(docs, text_col, frequent)
    late = 7 * _place("size_place") > _size("size_place")
    shared = tokens.withColumn("lead", F.min(F.struct(late.alias("late"), "sid", "size_place")).over(by))
    shared = shared.withColumn("least", F.min("sid").over(by)).withColumn("last", F.max("sid").over(by))
    shared = stored(shared.filter("least < last or salt >= 0").drop("least", "last"), "shared-tokens")
    links = stored(paired(leader_pairs(shared), sets, docs, id_col, text_col), "leader-links")
    labels = components(links)
    x = mixed_tokens(shared.select("token", "sid", _size("size_place").alias("n"), _place("size_place").alias("p")).distinct(), labels)
    for turn in range(TURNS + 1):
        if x.isEmpty():
            break
        found = paired(partner_pairs(x, turn), sets, docs, id_col, text_col) if turn < TURNS else opened(*near_groups(*group_asks(x), sets), sets, docs, id_col, text_col)
        more = stored(found, "more-links")
        if more.isEmpty():
            continue
        links = links.unionByName(more)
        labels = components(links)
        if turn < TURNS:
            x = mixed_tokens(x, labels)
    named = sets.select("sid", "rep").join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    return rows, named.join(few(least, PICKED), "label", "inner").select("sid", "label", "component_id")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id that links of similarity 0.75 or more reach, itself included).

    Null texts and texts without words have no shingles and no links. Repeated rows keep their rows; rows with one text
    are linked. A null id is linked by its text but is never the smallest; other columns take no part; an empty table
    gives no rows."""
    rows, parts = linked_sets(docs, id_col, text_col)
    out = rows.filter("n > 0").select("doc_id", "n", "sid").join(parts, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(empty).withColumnRenamed("doc_id", id_col)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, one of each component: that of the smallest id, of rows with that id the first by
    the hash of the text, of equal ones the first by all values. Rows without words stay; rows of one id whose texts aren't
    linked are told apart by their texts; a null id gives way to any other."""
    rows, parts = linked_sets(docs, id_col, text_col)
    own = rows.filter("n > 0").select("doc_id", "h", "sid").distinct()
    first = own.join(parts, "sid").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")).alias("k"))
    kept = first.select(F.col("k.doc_id").alias("_id"), F.col("k.h").alias("_h"))
    bare = rows.filter("n = 0").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    x = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_h"))
    is_ = lambda y: x["_id"].eqNullSafe(y["_id"]) & (x["_h"] == y["_h"])
    out = x.join(kept, is_(kept), "left_semi")
    again = rows.filter("n > 0").groupBy("doc_id", "h").count().filter("count > 1").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    if not again.isEmpty():
        turn = F.row_number().over(Window.partitionBy("_id", "_h").orderBy(F.xxhash64("_row")))
        same = out["_id"].eqNullSafe(again["_id"]) & (out["_h"] == again["_h"])
        out = out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").withColumn("_turn", turn).filter("_turn = 1").drop("_turn"))
    return out.select("_row.*").unionByName(x.join(bare, is_(bare), "left_semi").select("_row.*"))
