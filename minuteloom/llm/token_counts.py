"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minuteloom.llm.common import session

BATCH_BYTES = 1 << 20
CACHED_SEGMENTS = 200_000
_SEGMENT = re.compile(" +[^ ]*")


class SegmentCounter:
    """Counts the tokens of whole texts with a sentencepiece BPE model.

    A text is split at its safe boundaries: before a run of spaces that follows another character. No
    piece of the vocabulary has a word mark behind another character (checked when the model is loaded),
    so no merge crosses such a boundary and the counts of the segments add up to that of the whole text.
    With a model for which that does not hold, or that rewrites its input, texts are encoded whole; so is a
    stretch without a space, however long."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        spec = pb.ModelProto()
        with open(model_file, "rb") as f:
            spec.ParseFromString(f.read())
        mark, norm = "▁", spec.normalizer_spec
        self.safe = (
            norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
            and spec.trainer_spec.model_type == 2 and not spec.trainer_spec.treat_whitespace_as_suffix
            and not any(p.type == 4 or mark in p.piece.lstrip(mark) for p in spec.pieces)
        )
        self.known: dict[str, int] = {}

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return self.lengths(texts)
        split = [_SEGMENT.findall(f" {t}") if t else [] for t in texts]
        if len(self.known) > CACHED_SEGMENTS:
            self.known.clear()
        known = self.known
        if new := list({s for segments in split for s in segments if s not in known}):
            # the model puts one space before each text, which stands for the first of the segment's own
            known.update(zip(new, (n if s != " " else 1 for s, n in zip(new, self.lengths([s[1:] for s in new])))))
        return [sum(map(known.__getitem__, segments)) for segments in split]


def by_bytes(texts: list[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """The texts in order, in batches of about ``most`` bytes; a longer text is a batch of its own."""
    batch, held = [], 0
    for t in texts:
        size = len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass"))
        if batch and held + size > most:
            yield batch
            batch, held = [], 0
        batch.append(t)
        held += size
    if batch:
        yield batch


def token_count(text: Column | str, model_file: str) -> Column:
    """Number of tokens of each text, without begin, end or added special tokens; null and empty texts: 0."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = SegmentCounter(model_file)
        for series in batches:
            out: list[int] = []
            for batch in by_bytes(["" if t is None else t for t in series]):
                out += counter.count(batch)
            yield pd.Series(out, dtype="int64")

    return count(text)


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). No shuffle.

    Null and empty texts have 0 bytes and tokens; repeated rows each keep their row; other columns take no part."""
    session(docs)
    text = F.col(text_col)
    return docs.select(
        F.col(id_col), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), token_count(text, model_file).alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)
