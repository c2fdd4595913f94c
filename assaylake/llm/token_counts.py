"""Exact token counts by a map-side two-tier lookup, without a shuffle of pre-tokens.

A piece model whose pieces never hold a space mark after another character splits a text exactly at
its runs of spaces: no merge crosses such a boundary, so the count of a text is the sum over its
pre-tokens. Tier one is a compact table of frequent pre-token lengths, broadcast once; tier two is a
cache in each Python worker that encodes a miss once and keeps it.

Fitted on a bounded sample: the frequent table alone (``sample_docs`` documents, ``frequent`` entries,
both parameters). It only saves work; every count comes from the library's own encoder.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.workers import give_back, slices
from assaylake.session import ship_package

SPACE_MARK = "▁"
LONGEST_CACHED = 64  # characters; longer pre-tokens are encoded each time
BATCH_BYTES = 1 << 23  # of text in a slice of a batch
CACHE_ENTRIES = 300_000  # of a worker's tier two

_worker: dict = {}


def check_model(model: bytes) -> None:
    """Raise unless the model splits exactly at spaces."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    spec.ParseFromString(model)
    if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces or not spec.normalizer_spec.add_dummy_prefix:
        raise ValueError("the model's normaliser isn't the identity with a leading space mark")
    if any(SPACE_MARK in p.piece.lstrip(SPACE_MARK) for p in spec.pieces):
        raise ValueError("a piece of the model crosses a space")


class TierTwo(dict):
    """Worker cache: pre-token (without its own leading space) to its number of tokens."""

    def __init__(self, encode, known):
        super().__init__(known)
        self.encode = encode

    def __missing__(self, token: str) -> int:
        n = len(self.encode(token))
        if len(token) <= LONGEST_CACHED and len(self) < CACHE_ENTRIES:
            self[token] = n
        return n


def count_text(text: str, cache: TierTwo) -> int:
    """Tokens of one text."""
    if not text:
        return 0
    if SPACE_MARK in text:
        return len(cache.encode(text))
    if text[0] != " " and text[-1] != " " and "  " not in text:
        return sum(map(cache.__getitem__, text.split(" ")))
    total = 0
    for token in re.findall(" +[^ ]*", f" {text}"):
        if token[-1] == " ":
            total += len(cache.encode(f"a{token}")) - len(cache.encode("a"))
        else:
            total += cache[token[1:]]
    return total


def _cache(model, table) -> TierTwo:
    if _worker.get("id") != model.value[0]:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model.value[1])
        words, lengths = table.value
        known = dict(zip(words.decode().split("\n"), np.frombuffer(lengths, np.uint16).tolist(), strict=True)) if lengths else {}
        _worker.update(id=model.value[0], cache=TierTwo(processor.encode, known))
    return _worker["cache"]


def frequent_table(docs: DataFrame, model: bytes, text_col: str, frequent: int, sample_docs: int) -> tuple[bytes, bytes]:
    """Tier one: the frequent pre-tokens of a bounded sample, newline-joined, and their lengths as uint16.

    The sample has about sample_docs rows from all over the table; they stay where they are, and
    only sums of their pre-tokens are shuffled.
    """
    import sentencepiece

    share = sample_docs / max(1, docs.count())
    sample = docs.select(F.col(text_col).alias("t"))
    sample = (sample.sample(share, seed=3) if share < 1 else sample).where("t is not null")
    top = (
        sample.select(F.explode(F.split("t", "[ \n]+")).alias("w"))
        .where(f"length(w) between 1 and {LONGEST_CACHED}")
        .groupBy("w").count().orderBy(F.desc("count"), "w").limit(frequent)
    )
    words = [r.w for r in top.collect() if SPACE_MARK not in r.w and "\n" not in r.w]
    encode = sentencepiece.SentencePieceProcessor(model_proto=model).encode
    return "\n".join(words).encode(), np.array([len(encode(w)) for w in words], np.uint16).tobytes()


def count_tokens(docs: DataFrame, model_path: str, text_col: str = "text", limit: int = 4096, frequent: int = 20_000, sample_docs: int = 2_000) -> DataFrame:
    """The columns of docs but the text, with n_bytes, n_tokens and over_limit (n_tokens > limit).

    A null text counts as empty (0 bytes, 0 tokens, not over the limit). Repeated rows each get their
    own result; an empty table gives an empty result; a very long text is counted whole. Columns of
    docs that clash with the three new names are replaced by the new ones.
    """
    spark = docs.sparkSession
    ship_package(spark)
    model = Path(model_path).read_bytes()
    check_model(model)
    shared = spark.sparkContext.broadcast((hash(model), model))
    table = spark.sparkContext.broadcast(frequent_table(docs, model, text_col, frequent, sample_docs))
    made = {"n_bytes": pa.int64(), "n_tokens": pa.int64(), "over_limit": pa.bool_()}
    kept = [c for c in docs.columns if c != text_col and c not in made]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(shared, table)
        for batch in slices(batches, 0, BATCH_BYTES):
            texts = batch.column(0)
            n = [count_text(t, cache) if t else 0 for t in texts.to_pylist()]
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            columns = [sizes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i + 1) for i in range(len(kept))), *columns], [*kept, *made])
        give_back()

    fields = [docs.schema[c] for c in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_bytes long", "n_tokens long", "over_limit boolean"])
    return docs.select(text_col, *kept).mapInArrow(count, schema)
