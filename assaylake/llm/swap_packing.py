"""Packing of tokenised documents into as few sequences as a swap-based local search finds.

Each task tokenises its documents once and keeps a row per piece (place in its document, length and a
checksum of its ids, never the ids). Pieces as long as a sequence are sequences by themselves. The
others are dealt into randomised groups of a bounded size; each group is packed by best-fit
decreasing, and then documents are exchanged between underfull sequences, one for one, two for one or
by a move, such that the sum of the squared fills grows: the fullest underfull sequence takes what
fills it best from emptier ones, until those are empty.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.packing import BATCH_BYTES, GROUP_BITS, PLACE_BITS, Encoder
from assaylake.llm.workers import slices
from assaylake.session import materialize, ship_package

ROW = 2000  # unknown parts that are encoded in one go

_worker: dict = {}


def latin_pieces() -> str:
    """The byte-level splitting pattern for plain texts (see Encoder.plain) in the standard library's terms."""
    kind = lambda k: re.escape("".join(c for c in map(chr, (*range(33, 127), *range(0xA1, 0x180))) if unicodedata.category(c)[0] == k))
    letters, numbers, space = kind("L"), kind("N"), " \\t-\\r"
    return f"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"


class ByteEncoder(Encoder):
    """Exact ids of a byte-level tokenizer file; plain texts go part by part through a cache.

    The cached path holds only for a file without a normaliser whose pre-tokeniser is the byte-level
    pattern without a leading space: a part that the pattern cuts is cut to itself when it is encoded
    alone. Other files, other scripts and texts with special strings go through the library whole.
    """

    def __init__(self, spec: str):
        super().__init__(spec)
        read = json.loads(spec)
        kind = read.get("pre_tokenizer") or {}
        cached = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not read.get("normalizer") and not read.get("post_processor")
        special = all("<|" in t["content"] for t in read.get("added_tokens", []))
        self.split = re.compile(latin_pieces()).findall if cached and special else None

    def words_in(self, text: str) -> list[str]:
        return self.split(text)

    def learn(self, words: list[str]) -> None:
        """Encode parts that the cache doesn't have: those of a space and a letter together, as they are cut alike in a row."""
        rows = [w for w in words if w[0] == " " and w[1:2].isalpha()]
        rest = [w for w in words if not (w[0] == " " and w[1:2].isalpha())]
        for at in range(0, len(rows), ROW):
            some = rows[at : at + ROW]
            found = self.tokenizer.encode("".join(some), add_special_tokens=False)
            ids, lengths = np.array(found.ids, "<u4"), np.bincount(np.array(found.word_ids, np.int64))
            if len(lengths) != len(some):  # another cut than expected: each for itself
                each = [self.library(w) for w in some]
                ids, lengths = np.concatenate(each), np.array([len(e) for e in each], np.int64)
            self.keep(some, ids, lengths)
        if rest:
            each = [self.library(w) for w in rest]
            self.keep(rest, np.concatenate(each), np.array([len(e) for e in each], np.int64))

    def keep(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.words.update(zip(words, range(len(self.ends), len(self.ends) + len(words)), strict=True))
        self.enter(ids, lengths)

    def long_text(self, text: str, end_id: int, most: int) -> np.ndarray:
        """The ids of one long text and end_id, in parts cut before a lone space, where every pre-tokeniser of this kind cuts."""
        ids, at, lone = [], 0, re.compile(r"(?<=[^\s]) (?=[^\s])")
        while at < len(text):
            cut = lone.search(text, at + most) if self.split is not None else None
            stop = cut.start() if cut else len(text)
            ids.append(self.batch_ids([text[at:stop]], end_id)[0][:-1])
            at = stop
        return np.concatenate([*ids, np.array([end_id], "<u4")])


def _encoder(shared) -> ByteEncoder:
    if _worker.get("id") != shared.value[0]:
        _worker.update(id=shared.value[0], encoder=ByteEncoder(shared.value[1]))
    return _worker["encoder"]


PIECE_TYPE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 and place (its task and number there)."""
    spark = docs.sparkSession
    ship_package(spark)
    spec = Path(tokenizer_path).read_text()
    shared = spark.sparkContext.broadcast((zlib.crc32(spec.encode()), spec))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, place = _encoder(shared), TaskContext.get().partitionId() << PLACE_BITS
        for batch in slices(batches, 1, BATCH_BYTES):
            texts = batch.column(1).to_pylist()
            if len(texts) == 1 and len(texts[0] or "") > BATCH_BYTES:
                ids = encoder.long_text(texts[0], end_id, BATCH_BYTES)
                bounds = np.array([0, len(ids)])
            else:
                ids, bounds = encoder.batch_ids(texts, end_id)
            total = np.diff(bounds)
            pieces = -(-total // capacity)
            first = total - (pieces - 1) * capacity
            row = np.repeat(np.arange(len(total)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.where(number > 0, first[row] + (number - 1) * capacity, 0)
            length = np.where(number > 0, capacity, first[row])
            begin = bounds[row] + start
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(row)), pa.array(number, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc, place + np.arange(len(row))))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "place"])
            place += len(row)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, f"{PIECE_TYPE}, place long")


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of sizes: each size, the largest first, goes where the least room is left over."""
    bins, by_room, rooms = [], [[] for _ in range(capacity + 1)], 0  # rooms has a bit for each room that a bin has
    for size in sorted(sizes, reverse=True):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(size)
        else:
            room, b = capacity, len(bins)
            bins.append([size])
        if room > size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins


class Exchange:
    """One pass over underfull bins: each, the fullest first, is filled from emptier ones and is then settled.

    ``sizes`` has a bit for each size that an open bin holds; ``holders`` lists bins by size and may
    name some that no longer hold it. Every exchange takes more from an emptier bin than it gives, so
    the sum of squared fills grows with each and the search ends.
    """

    def __init__(self, bins: list[list[int]], capacity: int):
        self.bins, self.capacity = bins, capacity
        self.room = [capacity - sum(b) for b in bins]
        self.up_to = [(2 << n) - 1 for n in range(capacity + 1)]
        self.sizes, self.count, self.holders = 0, [0] * (capacity + 1), [[] for _ in range(capacity + 1)]
        self.open = [True] * len(bins)
        self.fullest = [(r, b) for b, r in enumerate(self.room)]
        self.emptiest = [(-r, b) for b, r in enumerate(self.room)]
        heapq.heapify(self.fullest)
        heapq.heapify(self.emptiest)
        self.exchanges = 0
        for b, its in enumerate(bins):
            for size in its:
                self.add(b, size)

    def add(self, b: int, size: int) -> None:
        self.count[size] += 1
        self.sizes |= 1 << size
        self.holders[size].append(b)

    def drop(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.sizes ^= 1 << size

    def largest(self, most: int) -> int:
        """The largest size in an open bin that isn't over most (0 if none)."""
        return max(0, (self.sizes & self.up_to[min(most, self.capacity)]).bit_length() - 1)

    def holder(self, size: int) -> int:
        at = self.holders[size]
        while not (self.open[at[-1]] and size in self.bins[at[-1]]):
            at.pop()
        return at[-1]

    def give(self, b: int, taken: list[int], given: list[int]) -> None:
        """An open bin loses some sizes and gets others."""
        for size in taken:
            self.bins[b].remove(size)
            self.drop(size)
        for size in given:
            self.bins[b].append(size)
            self.add(b, size)
        self.room[b] += sum(taken) - sum(given)
        if self.bins[b]:
            heapq.heappush(self.fullest, (self.room[b], b))
            heapq.heappush(self.emptiest, (-self.room[b], b))
        else:
            self.open[b] = False

    def emptiest_open(self) -> int | None:
        heap = self.emptiest
        while heap and not (self.open[heap[0][1]] and -heap[0][0] == self.room[heap[0][1]]):
            heapq.heappop(heap)
        return heap[0][1] if heap else None

    def best(self, a: int) -> tuple[int, list[int], list[int], int | None]:
        """What fills bin a best: the gain, what it gives, what it takes, and the bin it deals with (None: any holder)."""
        room, its = self.room[a], sorted(set(self.bins[a]))
        found = (self.largest(room), [], [self.largest(room)], None)  # a move
        if found[0] == room:
            return found
        for x in its:  # one for one
            y = self.largest(x + room)
            if y - x > found[0]:
                found = (y - x, [x], [y], None)
        if found[0] == room:
            return found
        twins = [x for x in its if self.bins[a].count(x) > 1]
        for x, z in (*combinations(its, 2), *zip(twins, twins, strict=True)):  # two of it for one
            if x + z < self.capacity:
                y = self.largest(x + z + room)
                if y - x - z > found[0]:
                    found = (y - x - z, [x, z], [y], None)
        if found[0] == room:
            return found
        e = self.emptiest_open()
        if e is not None:  # one of it for two of the emptiest
            others = sorted(set(self.bins[e]))
            twins = [y for y in others if self.bins[e].count(y) > 1]
            for y, z in (*combinations(others, 2), *zip(twins, twins, strict=True)):
                for x in its:
                    if found[0] < y + z - x <= room:
                        found = (y + z - x, [x], [y, z], e)
        return found

    def run(self) -> list[list[int]]:
        """The bins that aren't empty in the end."""
        while self.fullest:
            room, a = heapq.heappop(self.fullest)
            if not self.open[a] or room != self.room[a]:
                continue
            self.open[a] = False
            for size in self.bins[a]:
                self.drop(size)
            while self.room[a]:
                gain, gives, takes, other = self.best(a)
                if not gain:
                    break
                self.give(self.holder(takes[0]) if other is None else other, takes, gives)
                for size in gives:
                    self.bins[a].remove(size)
                self.bins[a] += takes
                self.room[a] -= gain
                self.exchanges += 1
        return [b for b in self.bins if b]


def fewest_bins(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing, then passes of exchanges until one finds nothing."""
    bins, done = best_fit_decreasing(sizes, capacity), []
    while True:
        done += [b for b in bins if sum(b) == capacity]
        search = Exchange([b for b in bins if sum(b) < capacity], capacity)
        bins = search.run()
        if not search.exchanges:
            return done + bins


def place_pieces(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset there of each length; equal lengths are taken in the given order."""
    bins = fewest_bins(lengths.tolist(), capacity)
    sizes = np.array([size for b in bins for size in b], np.int64)
    number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    before = np.cumsum(sizes) - sizes
    offset = before - np.repeat(before[np.cumsum([0, *map(len, bins)])[:-1]], [len(b) for b in bins])
    of_size, order = np.argsort(sizes, kind="stable"), np.argsort(lengths, kind="stable")
    which, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    which[order], offsets[order] = number[of_size], offset[of_size]
    return which, offsets


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, group_pieces: int = 16384, seed: int = 29, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a document of the end id alone. A document of more than ``capacity`` ids is
    cut so that all pieces but the first hold ``capacity``; such a piece is a sequence by itself (with
    a negative number). Repeated rows are packed each for itself; rows with a null id are packed as
    well and keep the null. Groups hold about ``group_pieces`` pieces whatever the size of the input
    and however often a row repeats, and each leaves about one underfull sequence; they depend on the
    rows and their places in the tasks that read them, so a lost task is redone alike. An empty table
    gives an empty result; other columns are ignored.
    """
    pieces = materialize(tokenised_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    whole = pieces.where(F.col("length") == capacity)
    part = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-part.count() // group_pieces))
    grouped = part.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", "place"), F.lit(groups)))
    names = [c.split()[0] for c in PIECE_TYPE.split(", ")]

    def fill(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32", "place")])
        bins, offsets = place_pieces(rows["length"].to_numpy(), capacity)
        placed = rows.select(names).append_column("sequence_id", pa.array(key[0].as_py() * (1 << GROUP_BITS) + bins))
        return placed.append_column("offset", pa.array(offsets))

    packed = grouped.groupBy("group").applyInArrow(fill, f"{PIECE_TYPE}, sequence_id long, offset long")
    return packed.unionByName(whole.select(*names, (-1 - F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
