"""MinHash near-duplicates with SetSketch registers.

A register keeps the exponentially spaced, truncated minimum of an exponential hash over a set;
sketches of two sets merge by the maximum. Equal registers become ever more likely with the Jaccard
similarity, so bands of registers are bucket keys. Documents of one bucket are compared with a few
leaders of it; the registers' joint likelihood estimates their similarity, and what may reach the
threshold is confirmed on full shingle sets. Last come members that a bucket still holds in different
components: those that share a rare shingle, as any two that link must, are compared, so that no
link of a bucket is lost and no pair is made of what is merely common.

Equal sets are one class, the node of all links, before any pair is made. Register, band and pair
rows are shuffled; texts only once, one a class, for the classes that share a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.components import components
from assaylake.llm.workers import giving_back, slices
from assaylake.session import Scratch, materialize, ship_package

BANDS, ROWS = 26, 4  # at similarity 0.8 a pair misses every band with a chance of about 1e-6
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65535
LEADERS = 2
SLACK = 0.2  # the estimate may err by five standard deviations
_rng = np.random.default_rng(20240229)
MULTIPLIERS = _rng.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
BLOCK = 8192  # shingles hashed at once
TEXT_BLOCK = 1 << 18  # bytes whose words are hashed at once
BATCH_BYTES = 1 << 23  # of text in a slice of a batch
SLOTS = 1 << 18  # of the shingle counts that order the rare-shingle search; a bound of what is sent to the workers
NO_ID = -(1 << 63)  # stands for a null id in a join
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LETTERS = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
FACTOR = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2 ** 64
POWERS = np.multiply.accumulate(np.full(TEXT_BLOCK, FACTOR, np.uint64))
INVERSE = np.multiply.accumulate(np.full(TEXT_BLOCK, pow(FACTOR, -1, 1 << 64), np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of each word of a lower-case text, without a loop over the words.

    The hash of a word is the sum of its bytes' random values times powers of a factor: a difference
    of prefix sums, times the inverse of the power at the word's first byte. Long texts go in blocks
    of whole words; a word longer than a block is hashed by itself.
    """
    raw, out, at = np.frombuffer(text, np.uint8), [], 0
    while at < len(raw):
        stop = len(raw)
        if stop - at >= TEXT_BLOCK:
            gaps = np.flatnonzero(SPACE[raw[at : at + TEXT_BLOCK]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:
                gap = next((i for i in range(at, len(raw), TEXT_BLOCK) if SPACE[raw[i : i + TEXT_BLOCK]].any()), len(raw))
                stop = gap + int(SPACE[raw[gap : gap + TEXT_BLOCK]].argmax()) if gap < len(raw) else gap
                out.append(np.array([xxhash.xxh64_intdigest(text[at:stop])], np.uint64))
                at = stop
                continue
        block = raw[at:stop]
        gap = SPACE[block]
        first = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        last = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]]))
        sums = np.cumsum(LETTERS[block] * POWERS[: len(block)])
        before = np.where(first > 0, sums[first - 1], np.uint64(0))
        out.append(mixed((sums[last] - before) * INVERSE[first] + (last - first).astype(np.uint64)))
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; words are split at ASCII white space, A-Z lower-cased."""
    words = word_hashes((text or "").encode().lower())
    if not len(words):
        return words
    k = min(width, len(words))
    h = np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        h = mixed(h + words[i : len(words) - k + 1 + i])
    return np.unique(h)


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of a set that isn't empty."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), BLOCK):
        part = shingles[None, i : i + BLOCK] ^ MASKS[:, None]
        part *= MULTIPLIERS[:, None]
        np.minimum(least, part.min(1), out=least)
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(first, second)


def joint_estimate(first: np.ndarray, second: np.ndarray, n_first: np.ndarray, n_second: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs of sketches (rows) whose set sizes are known."""
    above, below = (first > second).sum(1), (first < second).sum(1)
    equal = first.shape[1] - above - below
    u = n_first / (n_first + n_second)
    v = 1 - u
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        p, q = chance(u - v * j), chance(v - u * j)
        log = lambda k, x: np.where(k > 0, k * np.log(np.maximum(x, 1e-300)), 0.0)
        return log(above, p) + log(below, q) + log(equal, 1 - p - q)

    low, high, g = np.zeros(len(u)), np.minimum(u / v, v / u), (5**0.5 - 1) / 2
    for _ in range(30):
        a, b = high - g * (high - low), low + g * (high - low)
        right = likelihood(a) < likelihood(b)
        low, high = np.where(right, a, low), np.where(right, high, b)
    return (low + high) / 2


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, the text's hash, n_shingles, the set's 128-bit key in two longs (null for an empty set) and its registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, BATCH_BYTES):
            n, keys, found = [], [], []
            for text in batch.column(1).to_pylist():
                shingles = shingle_set(text, width)
                n.append(len(shingles))
                key = xxhash.xxh3_128_intdigest(shingles.tobytes()) if len(shingles) else None
                keys.append(key)
                found.append(registers(shingles).tobytes() if len(shingles) else None)
            signed = lambda x: None if x is None else x - (1 << 64) if x >> 63 else x
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(n, pa.int64()),
                pa.array([signed(k >> 64) if k is not None else None for k in keys], pa.int64()),
                pa.array([signed(k & (1 << 64) - 1) if k is not None else None for k in keys], pa.int64()),
                pa.array(found, pa.binary()),
            ], ["doc_id", "text_hash", "n_shingles", "key", "key2", "registers"])

    return named(docs, id_col, text_col).mapInArrow(giving_back(run), "doc_id long, text_hash long, n_shingles long, key long, key2 long, registers binary")


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and text_hash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))


def band_rows(classes: DataFrame) -> DataFrame:
    """bucket, node: a row per class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            if not raw:
                continue
            k = np.frombuffer(b"".join(raw), np.uint16).reshape(len(raw), BANDS, ROWS).astype(np.uint64)
            h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(raw), BANDS))
            for i in range(ROWS):
                h = mixed(h * np.uint64(65536) + k[:, :, i])
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(np.repeat(ids, BANDS))], ["bucket", "node"])

    return classes.select("node", "registers").mapInArrow(giving_back(run), "bucket long, node long")


def estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) with their estimate, those of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            of = lambda i: np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, REGISTERS)
            value = joint_estimate(of(2), of(3), batch.column(4).to_numpy().astype(float), batch.column(5).to_numpy().astype(float))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value)], ["a", "b", "estimate"])
            yield out.filter(pa.array(value >= least))

    side = lambda c: classes.select(F.col("node").alias(c), F.col("registers").alias(f"r{c}"), F.col("n_shingles").alias(f"n{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(f"100 * least(na, nb) >= {int(100 * least)} * greatest(na, nb)").select("a", "b", "ra", "rb", "na", "nb").mapInArrow(giving_back(run), "a long, b long, estimate double")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b, similar (whether the full sets reach the threshold, in whole numbers) and jaccard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None, None)
        for batch in slices(slices(batches, 2, BATCH_BYTES), 3, BATCH_BYTES):
            out, value = [], []
            for a, one, two in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if known[0] != a:
                    known = (a, shingle_set(one, width))
                other = shingle_set(two, width)
                same = len(np.intersect1d(known[1], other, assume_unique=True))
                union = len(known[1]) + len(other) - same
                out.append(100 * same >= percent * union)
                value.append(same / max(1, union))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_()), pa.array(value, pa.float64())], ["a", "b", "similar", "jaccard"])

    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}"))
    return pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb").mapInArrow(giving_back(run), "a long, b long, similar boolean, jaccard double")


def shingle_counts(texts: DataFrame, width: int, slots: int = SLOTS) -> np.ndarray:
    """How many sets hold a shingle of each slot (hash modulo slots), as uint16 with 65535 for any more.

    The counts only order the shingles, so shingles that share a slot do no harm; a count of one is
    exact. What reaches the driver is bounded by the number of slots.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(slots, np.int64)
        for batch in slices(batches, 0, BATCH_BYTES):
            for text in batch.column(0).to_pylist():
                np.add.at(seen, (shingle_set(text, width) % np.uint64(slots)).astype(np.int64), 1)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], ["slot", "n"])

    each = texts.select("text").mapInArrow(giving_back(run), "slot long, n long")
    found = each.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(slots, np.uint16)
    out[found["slot"].to_numpy()] = np.minimum(found["n"].to_numpy(), 65535)
    return out


def prefixes(rows: DataFrame, width: int, percent: int, counts: np.ndarray) -> DataFrame:
    """The rarest shingles of each set, as many as a link needs to show one of; those of one set alone left out.

    rows have node, component and text. A row: node, component, n (the set's size), token, onward (how
    many of the set's shingles follow from this one on in the common order) and size (a class of set
    sizes: sets that link are in the same class or in neighbouring ones).
    """
    shared, step = rows.sparkSession.sparkContext.broadcast(counts), np.log(100 / percent) + 1e-4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in slices(batches, 2, BATCH_BYTES):
            found: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for node, component, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = shingle_set(text, width)
                n = len(tokens)
                if not n:
                    continue
                held = often[(tokens % np.uint64(len(often))).astype(np.int64)]
                order = np.lexsort((tokens, held))[: n + (-n * percent) // 100 + 1]
                at = np.flatnonzero(held[order] > 1)
                for out, v in zip(found, (node, component, n, tokens[order[at]].view(np.int64), n - at, int(np.log(n) / step)), strict=True):
                    out.append(np.broadcast_to(v, len(at)))
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in found], ["node", "component", "n", "token", "onward", "size"])

    return rows.select("node", "component", "text").mapInArrow(giving_back(run), "node long, component long, n long, token long, onward long, size long")


def crossing_pairs(rare: DataFrame, percent: int) -> DataFrame:
    """a < b: sets of different components that share a rare shingle and may reach the threshold.

    A shingle's holders of its largest component are only set against the others, never against one
    another, and only against sets of a fitting size; both split a shingle with many holders.
    """
    held = rare.groupBy("token", "component").agg(F.count("*").alias("held"))
    largest = held.groupBy("token").agg(F.max(F.struct("held", "component"))["component"].alias("largest"), F.count("*").alias("several"))
    rare = rare.join(largest.where("several > 1"), "token")
    side = lambda c: [F.col(k).alias(f"{k}_{c}") for k in ("node", "component", "n", "onward")]
    few = rare.where("component <> largest").select("token", F.explode(F.sequence(F.col("size") - 1, F.col("size") + 1)).alias("size"), *side("a"))
    fits = f"component_a <> component_b and 100 * least(onward_a, onward_b) >= {percent} * (n_a + n_b - least(onward_a, onward_b))"
    pairs = few.join(rare.select("token", "size", *side("b")), ["token", "size"]).where(fits)
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _by_component(rows: DataFrame, column: str, found: DataFrame, name: str) -> DataFrame:
    labels = found.select(F.col("node").alias(column), F.col("component").alias("_c"))
    return rows.join(labels, column, "left").withColumn(name, F.coalesce("_c", column)).drop("_c")


def across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose two sides are in different components."""
    return _by_component(_by_component(pairs, "a", found, "ca"), "b", found, "cb").where("ca <> cb").drop("ca", "cb")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (least id that links reach), kept.

    Two documents link when 100 * intersection >= percent * union of their shingle sets. A text with
    fewer words than ``width`` has its whole sequence as its one shingle; a null text or one without
    words has an empty set and links with nothing. Repeated rows are linked by their equal sets; rows
    that share an id are one document, which has the links of all its sets. A row with a null id has
    a null component and isn't kept, but links others. An empty table gives an empty result, and
    other columns are ignored.
    """
    with Scratch() as scratch:
        return scratch.keep(materialize(_near_duplicates(docs, width, percent, id_col, text_col), "judged"))


def _near_duplicates(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    ship_package(docs.sparkSession)
    rows = materialize(sketches(docs, width, id_col, text_col), "sketches")
    # A class is a set that some documents have; its node is a number of its own, whatever their ids are.
    one = F.min(F.struct("doc_id", "text_hash"))
    classes = rows.where("n_shingles > 0").groupBy("key", "key2").agg(F.min("doc_id").alias("rep"), one.alias("one"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    placed = rows.select("doc_id", "n_shingles", "key", "key2").join(classes.select("key", "key2", "node"), ["key", "key2"], "left")
    placed = materialize(placed.select("doc_id", "n_shingles", "node"), "placed")
    several = placed.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    same_id = materialize(placed.join(several, "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct(), "same_id")

    # Buckets that several classes share, with a few leaders each: the least node, the least of some hashes,
    # and the hub, whose own buckets are the fullest (the common source of copies, where there is one).
    bands = materialize(band_rows(classes), "bands")
    counts = bands.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    full_bands = materialize(bands.join(counts, "bucket"), "full_bands")
    score = full_bands.groupBy("node").agg(F.sum("members").alias("score"))
    scored = full_bands.join(score, "node")
    leader = lambda i: F.min_by("node", F.xxhash64("node", F.lit(i))).alias(f"l{i}")
    hub = F.max(F.struct("score", (-F.col("node")).alias("node")))["node"]
    buckets = scored.groupBy("bucket").agg((-hub).alias("hub"), F.min("node").alias("l0"), *map(leader, range(1, LEADERS)))
    entries = materialize(full_bands.join(buckets, "bucket"), "entries")
    stars = entries.select("node", F.explode(F.array_distinct(F.array("hub", *[f"l{i}" for i in range(LEADERS)]))).alias("leader")).where("node <> leader")
    stars = stars.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    least = percent / 100 - SLACK
    pairs = materialize(estimated(stars, classes, least), "pairs")
    # The text of one document of each class that shares a bucket.
    wanted = classes.join(entries.select("node").distinct(), "node", "left_semi").select("node", F.coalesce("one.doc_id", F.lit(NO_ID)).alias("doc_id"), "one.text_hash")
    own = named(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    texts = materialize(own.join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("node", "text"), "texts")

    # The most promising pair of each class first; then whatever still crosses components.
    best = pairs.groupBy("b").agg(F.max(F.struct("estimate", (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b")
    tested = materialize(confirmed(best, texts, width, percent), "tested")
    found = materialize(components(tested.where("similar").select("a", "b").union(same_id)), "components")
    rest = across(pairs.select("a", "b"), found).join(tested.select("a", "b"), ["a", "b"], "left_anti")
    tested = materialize(tested.union(confirmed(rest, texts, width, percent)), "tested")
    links = tested.where("similar").select("a", "b").union(same_id)
    found = materialize(components(links), "components")

    # Buckets that still hold several components: their members meet on rare shingles. Under one order of
    # all shingles, rarest first, two sets that link share a shingle among the first n - ceil(share * n) + 1
    # of each; for the first one that they share, what follows it in both bounds their intersection. Pairs
    # that only share what is common are never made.
    labelled = _by_component(entries.select("bucket", "node"), "node", found, "component")
    open_ = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    members = materialize(labelled.join(open_, "bucket").select("node", "component").distinct(), "members")
    open_texts = texts.join(members, "node")
    rare = materialize(prefixes(open_texts, width, percent, shingle_counts(open_texts, width)), "rare")
    crossing = crossing_pairs(rare, percent).join(tested.select("a", "b"), ["a", "b"], "left_anti")
    last = confirmed(estimated(crossing, classes, least), texts, width, percent).where("similar")
    last = materialize(across(last.select("a", "b"), found), "last")
    if not last.isEmpty():
        found = materialize(components(links.union(last)), "components")

    reached = _by_component(classes.select("node", "rep"), "node", found, "component")
    least_id = reached.groupBy("component").agg(F.min("rep").alias("least_id"))
    labels = reached.join(least_id, "component").select("node", "least_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least_id", "doc_id"))
    out = placed.join(labels, "node", "left")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
