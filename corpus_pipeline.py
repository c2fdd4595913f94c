"""Corpus pipeline: language identification, near-duplicates, repeats, mixing and packing of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's documents. All but the last return the columns of documents. An empty table
passes through every stage; nulls in any column, repeated rows, empty and very long texts are
treated as the stages' operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaylake.llm import bigru_langid, entropy_mix, packing, rindex_dedup, setsketch
from assaylake.session import materialize

#: A document whose best language has a lower mean probability than this is in no learned language.
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, with lang set to it; those without a letter or a clear language go."""
    labelled = bigru_langid.with_split(docs).where("not held_out and lang is not null").select("text", "lang")
    net = bigru_langid.train(labelled)
    if not net.languages:  # nothing to learn from, so nothing to reject by
        return docs
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # none of them clashes with the new columns
    found = bigru_langid.predict(docs.select(*[F.col(c).alias(n) for c, n in names.items()]), net, names["text"], keep_text=True)
    keep = found.where((F.col("lang_pred") != bigru_langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return keep.select(*[F.col("lang_pred" if c == "lang" else n).alias(c) for c, n in names.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group that links of five-word shingles (0.8) connect."""
    judged = setsketch.near_duplicates(docs, width=5)
    gone = judged.where("not kept and n_shingles > 0 and doc_id is not null").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return left
    # Rows that share an id are one document: the first of them in text order stays.
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "lang", "source", "n_chars"))
    return left.withColumn("_place", first).where("_place = 1 or doc_id is null").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that an earlier document holds; a text of which nothing is left goes."""
    found = rindex_dedup.remove_repeats(docs, with_bytes=True, with_row=True)
    kept = F.coalesce(F.try_validate_utf8("kept_bytes"), F.replace(F.make_valid_utf8("kept_bytes"), F.lit("\ufffd"), F.lit("")))
    text = F.when(F.col("kept_bytes").isNull(), F.col("row.text")).otherwise(kept)
    left = found.withColumn("_text", text).where("kept_bytes is null or _text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    made = {"text": F.col("_text"), "n_chars": F.coalesce(F.length("_text"), F.lit(0)).cast("long")}
    return left.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return entropy_mix.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: The network and the sketches have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
