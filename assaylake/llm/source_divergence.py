"""Divergence of sources from each other and from their language, term by term, with exact integers.

Terms are counted by fixed-width digests: each task turns texts into 64-bit digests a batch at a
time, adds up its counts by language, source and digest, and only such rows are shuffled. Beside
them it leaves each spelling that it met (not shuffled). For digests that are kept, and only for
those, the least and the greatest spelling are gathered: where they differ, two terms share the
digest and are counted again by their spelling. Spellings join the few rows that are returned.

With p(n) = 1 + floor(10^9 (n + 2) / (N + 2 V)), a source without a term has p(0) there, so the sum
over all V terms of a pair of sources needs only the terms that both hold, and for each source how
many terms it holds how often:
sum f = sum_both [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)] + sum_p f(p, q0) + sum_q f(p0, q)
+ (V - held - held') f(p0, q0).

Odd input: null text, lang and source are ''; empty texts give groups without terms; repeated rows
are documents of their own; an empty table gives no rows; other columns, whatever their names, are
ignored; a text of any length is one document, hashed in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm.workers import giving_back, slices
from assaylake.session import Scratch, materialize, ship_package

BATCH_BYTES = 1 << 22  # of text at once
BLOCK = 1 << 19  # bytes that are hashed at once
HELD_ROWS = 1 << 21  # count rows of a task before they are added up
SEEN = 1 << 19  # spellings that a task remembers as written
LONG = 512  # bytes from which terms are compared one by one
FILTER_BITS = 1 << 23  # size of the filter of digests: one megabyte whatever the corpus
BASE = 0x9E3779B97F4A7C15  # odd, so powers of it have inverses
SCALE = 1_000_000_000

#: A-Z lower-cased; what belongs to no term is 0.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
_powers: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    """Powers of BASE and of its inverse modulo 2 ** 64, of this worker."""
    if not _powers:
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(BLOCK, base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps))
    return _powers


def digests(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int = 64) -> np.ndarray:
    """Polynomial digests of byte ranges, by differences of prefix sums, mixed and cut to some bits."""
    up, down = powers()
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + BLOCK, "right"))
        if j <= i:  # longer than a block
            long, value = folded[base : int(ends[i])], 0
            for at in range(0, len(long), BLOCK):
                part = long[at : at + BLOCK].astype(np.uint64)
                value += int((part * up[: len(part)]).sum()) * pow(BASE, at, 1 << 64)
            out[i] = value & (1 << 64) - 1
            i += 1
            continue
        part = folded[base : int(ends[j - 1])].astype(np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[: len(part)])])
        out[i:j] = (sums[ends[i:j] - base] - sums[starts[i:j] - base]) * down[starts[i:j] - base]
        i = j
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out.view(np.int64) if bits == 64 else (out & np.uint64((1 << bits) - 1)).view(np.int64)


def differing(folded: np.ndarray, starts: np.ndarray, lengths: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Numbers of the terms that don't have the bytes of the term that like names."""
    words = np.ndarray((len(folded) - 7,), "<u8", folded, 0, (1,)) if len(folded) > 7 else np.zeros(0, "<u8")
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    bad = lengths != lengths[like]
    left, at = np.flatnonzero(~bad & (like != np.arange(len(like)))), 0
    for i in left[lengths[left] > LONG].tolist():
        a, b, n = int(starts[i]), int(starts[like[i]]), int(lengths[i])
        bad[i] = not np.array_equal(folded[a : a + n], folded[b : b + n])
    left = left[lengths[left] <= LONG]
    while len(left):
        mask = masks[np.minimum(lengths[left] - at, 8)]
        bad[left] |= (words[starts[left] + at] ^ words[starts[like[left]] + at]) & mask != 0
        at += 8
        left = left[lengths[left] > at]
    return np.flatnonzero(bad)


class Terms:
    """The terms of a batch of texts: of each occurrence its document and its term's number; of each term its digest and bytes."""

    def __init__(self, texts: pa.Array, bits: int = 64):
        texts = pc.fill_null(texts, "")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        bounds = offsets - offsets[0]
        size = len(data)
        folded = np.concatenate([FOLD[data], np.zeros(8, np.uint8)])
        inside = folded[:size] != 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = bounds[(bounds > 0) & (bounds < size)]  # a term ends with its text
        first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
        self.folded, self.starts, self.ends = folded, np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(bounds, self.starts, "right") - 1
        self.digest, some, self.term = np.unique(digests(folded, self.starts, self.ends, bits), return_index=True, return_inverse=True)
        lengths = self.ends - self.starts
        other = differing(folded, self.starts, lengths, some[self.term]) if len(some) else some
        known: dict[tuple[int, bytes], int] = {}
        for i in other.tolist():  # another spelling with the same digest becomes a term of its own
            key = (int(self.term[i]), folded[self.starts[i] : self.ends[i]].tobytes())
            if key not in known:
                known[key] = len(some)
                some, self.digest = np.append(some, i), np.append(self.digest, self.digest[key[0]])
            self.term[i] = known[key]
        self.some = some

    def spelling(self, terms: np.ndarray) -> list[str]:
        a, b = self.starts[self.some[terms]].tolist(), self.ends[self.some[terms]].tolist()
        return [str(self.folded[i:j], "utf-8") for i, j in zip(a, b, strict=True)]

    def counts(self, group: np.ndarray) -> tuple[np.ndarray, ...]:
        """Group, term, occurrences and documents, a row for each group (of documents) and term."""
        many = max(1, len(self.some))
        pairs, times = np.unique(self.doc * many + self.term, return_counts=True)
        rows, which = np.unique(group[pairs // many] * many + pairs % many, return_inverse=True)
        return rows // many, rows % many, np.bincount(which, times, len(rows)).astype(np.int64), np.bincount(which, minlength=len(rows))


COUNT_TYPE = "lang long, source long, term long, n long, docs long, word string"
NAMES = [c.split()[0] for c in COUNT_TYPE.split(", ")]


def grouped(batch: pa.RecordBatch, known: dict[tuple[int, int], int]) -> np.ndarray:
    """The number of each row's (lang, source), new ones entered."""
    return np.array([known.setdefault(k, len(known)) for k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)


def term_counts(docs: DataFrame, bits: int, only: np.ndarray | None = None) -> DataFrame:
    """Counts of (lang, source, text) rows by digest; the spellings are rows without lang and source.

    With only, a filter of digests, just their terms are counted, by digest and word.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(only)

    def batch_of(known: list, g: np.ndarray, term: np.ndarray, n: np.ndarray, df: np.ndarray, words: list[str] | None) -> pa.RecordBatch:
        keys = np.array(known, np.int64).reshape(-1, 2)[g]
        word = pa.nulls(len(g), pa.string()) if words is None else pa.array(words, pa.string())
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in (keys[:, 0], keys[:, 1], term, n, df)), word], NAMES)

    def added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        g, term, n, df = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((term, g))
        g, term = g[order], term[order]
        new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (term[1:] != term[:-1])]))
        return g[new], term[new], np.add.reduceat(n[order], new), np.add.reduceat(df[order], new)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, rows, seen = {}, [], 0, {}
        for batch in slices(batches, 2, BATCH_BYTES):
            terms = Terms(batch.column(2), bits)
            if not len(terms.some):
                continue
            g, t, n, df = terms.counts(grouped(batch, known))
            if shared.value is not None:
                hit = np.flatnonzero(in_filter(terms.digest[t], shared.value))
                yield batch_of(list(known), g[hit], terms.digest[t[hit]], n[hit], df[hit], terms.spelling(t[hit]))
                continue
            held.append((g, terms.digest[t], n, df))
            rows += len(g)
            if rows > HELD_ROWS:
                held = [added(held)]
                rows = len(held[0][0])
            if rows > HELD_ROWS // 2 and len(held) == 1:  # adding up helps little
                yield batch_of(list(known), *held[0], None)
                held, rows = [], 0
            digest, words = terms.digest.tolist(), terms.spelling(np.arange(len(terms.some)))
            fresh = [i for i, (d, w) in enumerate(zip(digest, words, strict=True)) if seen.get(d) != w]
            seen.update((digest[i], words[i]) for i in fresh if len(words[i]) <= LONG)
            if len(seen) > SEEN:
                seen.clear()
            if fresh:
                none, zero = pa.nulls(len(fresh), pa.int64()), pa.array(np.zeros(len(fresh), np.int64))
                yield pa.RecordBatch.from_arrays([none, none, pa.array([digest[i] for i in fresh], pa.int64()), zero, zero, pa.array([words[i] for i in fresh], pa.string())], NAMES)
        if held:
            yield batch_of(list(known), *added(held), None)

    return docs.mapInArrow(giving_back(count), COUNT_TYPE)


def in_filter(terms: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = terms & FILTER_BITS - 1
    return bitmap[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) != 0


def digest_filter(terms: DataFrame) -> np.ndarray:
    """A bit for each digest's last bits: FILTER_BITS in all, so what the driver gets has a fixed size."""
    at = F.col("term").bitwiseAND(F.lit(FILTER_BITS - 1))
    bits = terms.select(F.shiftright(at, 6).alias("at"), F.expr(f"shiftleft(1L, cast((term & {FILTER_BITS - 1}) % 64 as int))").alias("bit"))
    found = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    bitmap = np.zeros(FILTER_BITS >> 6, np.int64)
    bitmap[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return bitmap.view(np.uint64)


def spellings(words: DataFrame, kept: DataFrame) -> DataFrame:
    """term, least and greatest word of each kept digest; others are filtered out before anything is shuffled."""
    shared = words.sparkSession.sparkContext.broadcast(digest_filter(kept))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_filter(batch.column(0).to_numpy(), shared.value)))

    near = words.mapInArrow(some, "term long, word string").groupBy("term").agg(F.min("word").alias("least"), F.max("word").alias("greatest"))
    return near.join(kept.select("term").distinct(), "term")


def share(count: str, whole: str, terms: str) -> str:
    """SQL of 1 + floor(10^9 (count + 2) / (whole + 2 terms)), exact for any counts that a long holds."""
    return f"(1 + (cast({count} + 2 AS decimal(20,0)) * {SCALE}) div cast({whole} + 2 * {terms} AS decimal(20,0)))"


def gap(p: str, q: str) -> str:
    """SQL of floor((p - q)^2 / (p + q)); below 2^62 for shares."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def named(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Documents as (lang, source, text) with 64-bit names, and the (lang, source) that occur with their strings.

    Names are hashes of a seed that is raised until no two strings of a column have one name.
    """
    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang_name"), (source_col, "source_name"), (text_col, "text"))])
    occurring = materialize(plain.select("lang_name", "source_name").distinct(), "groups")
    seed = 0
    while True:
        lang, source = (F.xxhash64(F.lit(seed), c) for c in ("lang_name", "source_name"))
        groups = occurring.select(lang.alias("lang"), source.alias("source"), "lang_name", "source_name")
        clash = [groups.select(c, f"{c}_name").distinct().groupBy(c).count().where("count > 1") for c in ("lang", "source")]
        if all(c.isEmpty() for c in clash):
            return plain.select(lang.alias("lang"), source.alias("source"), "text"), groups
        seed += 1


def kept_counts(docs: DataFrame, least_docs: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact counts of kept terms in documents (see named): cells, kept and words.

    cells: lang, source, term, word, n. kept: lang, term, word, total. word is '' but for terms whose
    digest several kept spellings share. words: term and its spelling, for all others.
    """
    found = materialize(term_counts(docs, bits), "counts")
    total = found.where("lang is not null").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    total = materialize(total.withColumn("word", F.lit("")), "totals")

    def enough(counts: DataFrame) -> DataFrame:
        return counts.groupBy("lang", "term", "word").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")

    kept = materialize(enough(total), "kept")
    words = materialize(spellings(found.where("lang is null").select("term", "word"), kept), "words")
    shared = words.where("least < greatest").select("term")
    if not shared.isEmpty():
        again = term_counts(docs, bits, digest_filter(shared)).join(shared, "term", "left_semi")
        split = materialize(again.groupBy("lang", "source", "term", "word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "split")
        total = total.join(shared, "term", "left_anti").unionByName(split)
        kept = materialize(kept.join(shared, "term", "left_anti").unionByName(enough(split)), "kept")
    cells = total.join(kept, ["lang", "term", "word"]).select("lang", "source", "term", "word", "n", "total")
    return materialize(cells, "cells"), kept, words.where("least = greatest").select("term", F.col("least").alias("spelling"))


def divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, bits: int = 64, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank, count, share and other_share.

    Part pair: how far each other source of the language is. Part term: the top terms that the source
    has more often than its language, with the source's count and the two shares (null for pairs).
    bits cuts digests, so that tests meet terms that share one.
    """
    with Scratch() as scratch:
        named_docs, groups = named(docs, lang_col, source_col, text_col)
        cells, kept, words = kept_counts(named_docs, least_docs, bits)
        langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
        sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("whole"), F.count("*").alias("held"))
        stats = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["whole", "held", "v", "lang_n"])
        stats = materialize(stats.withColumn("p0", F.expr(f"if(v = 0, 0, {share('0', 'whole', 'if(v = 0, 1, v)')})")), "stats")
        rated = cells.join(stats.select("lang", "source", "whole", "v", "lang_n", "p0"), ["lang", "source"])
        rated = rated.selectExpr("lang", "source", "term", "word", "n", "p0", f"{share('n', 'whole', 'v')} AS p", f"{share('total', 'lang_n', 'v')} AS q")
        rated = materialize(rated, "rated")
        out = top_terms(rated, stats, words, top).unionByName(pair_gaps(rated, stats), allowMissingColumns=True)
        return scratch.keep(materialize(out.select("lang", "source", "part", "item", "value", "rank", "count", "share", "other_share"), "divergence"))


def top_terms(rated: DataFrame, stats: DataFrame, words: DataFrame, top: int) -> DataFrame:
    """The terms of each group by value; those that may be among the first get their spelling, then ties are told apart."""
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc())
    over = rated.where("p > q").selectExpr("lang", "source", "term", "word", "n", "p", "q", f"{gap('p', 'q')} AS value")
    first = over.withColumn("place", F.rank().over(by_value)).where(F.col("place") <= top)
    item = F.when(F.col("word") == "", F.col("spelling")).otherwise(F.col("word"))
    spelled = first.join(words, "term", "left").withColumn("item", item)
    by_item = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = spelled.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= top)
    names = stats.select("lang", "source", "lang_name", "source_name")
    return ranked.join(names, ["lang", "source"]).selectExpr("lang_name AS lang", "source_name AS source", "'term' AS part", "item", "value", "rank", "n AS count", "p AS share", "q AS other_share")


def pair_gaps(rated: DataFrame, stats: DataFrame) -> DataFrame:
    """Each ordered pair of sources of a language, as the result lists them, with the gap summed over all kept terms."""
    one = stats.selectExpr("lang", "source", "held", "v", "p0", "lang_name", "source_name")
    other = stats.selectExpr("lang", "source AS other", "held AS other_held", "p0 AS other_p0", "source_name AS item")
    pairs = materialize(one.join(other, "lang").where("source <> other"), "pairs")
    none = f"if(v = 0, 0, {gap('p0', 'if(v = 0, 1, other_p0)')})"
    rest = pairs.selectExpr("lang", "source", "other", f"(v - held - other_held) * {none} AS value")
    # Terms of one against none of the other: as many values as the source has different counts.
    levels = rated.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    alone = pairs.select("lang", "source", "other", "other_p0").join(levels, ["lang", "source"])
    alone = alone.groupBy("lang", "source", "other").agg(F.sum(F.expr(f"terms * {gap('p', 'other_p0')}")).alias("value"))
    mine = rated.select("lang", "term", "word", "source", "p", "p0")
    theirs = rated.selectExpr("lang", "term", "word", "source AS other", "p AS q", "p0 AS q0")
    met = mine.join(theirs, ["lang", "term", "word"]).where("source < other")
    both = met.groupBy("lang", "source", "other").agg(F.sum(F.expr(f"{gap('p', 'q')} - {gap('p', 'q0')} - {gap('p0', 'q')} + {gap('p0', 'q0')}")).alias("value"))
    turned = ["lang", "other AS source", "source AS other", "value"]
    parts = rest.unionByName(alone).unionByName(alone.selectExpr(*turned)).unionByName(both).unionByName(both.selectExpr(*turned))
    sums = parts.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = pairs.select("lang", "source", "other", "lang_name", "source_name", "item").join(sums, ["lang", "source", "other"]).withColumn("rank", F.row_number().over(by_value))
    return ranked.selectExpr("lang_name AS lang", "source_name AS source", "'pair' AS part", "item", "value", "rank")


RESULT = ["lang", "source", "part", "item", "value", "rank"]


def duckdb_sql() -> str:
    """The rows of the query, each pair summed over all kept terms."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), tok AS (
  SELECT d, lang, source, unnest(terms) AS w FROM docs
), kept AS (
  SELECT lang, w, count(*) AS total FROM tok GROUP BY lang, w HAVING count(DISTINCT d) >= 10
), counts AS (
  SELECT lang, source, w, count(*) AS n FROM tok GROUP BY lang, source, w
), sizes AS (
  SELECT lang, count(*) AS v, sum(total)::HUGEINT AS lang_n FROM kept GROUP BY lang
), occurring AS (
  SELECT DISTINCT lang, source FROM docs
), cells AS (
  SELECT g.lang, g.source, k.w, coalesce(c.n, 0) AS n, k.total, s.v, s.lang_n,
    (sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source))::HUGEINT AS whole
  FROM occurring g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.w = k.w
), probs AS (
  SELECT lang, source, w, n, 1 + 1000000000::HUGEINT * (n + 2) // (whole + 2 * v) AS p,
    1 + 1000000000::HUGEINT * (total + 2) // (lang_n + 2 * v) AS q
  FROM cells
), gaps AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM probs a JOIN probs b ON a.lang = b.lang AND a.w = b.w AND a.source <> b.source GROUP BY 1, 2, 3
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(g.value, 0) AS value
  FROM occurring a JOIN occurring b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, w AS item, (p - q) * (p - q) // (p + q) AS value FROM probs WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
