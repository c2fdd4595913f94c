"""Packing of tokenised documents into fixed-length sequences.

Each task tokenises its documents once and keeps a row per piece (start, length and a checksum of
its ids, never the ids themselves). Pieces are dealt into randomised groups of a bounded size by a
hash of the document and of the piece's place in its task, so that equal rows spread as well, and
each group is packed by first-fit decreasing: a tournament tree over the bins' free room finds the
first bin with room in a logarithmic number of steps.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.workers import slices
from assaylake.session import materialize, ship_package

CACHE_ENTRIES = 400_000  # words in a worker's cache; the half with the most hits stays when it is full
BATCH_BYTES = 1 << 21  # of text that is encoded at once
GROUP_BITS = 32
PLACE_BITS = 40

_worker: dict = {}


# Fixed value: the pattern by which the tokenizer file of the queries splits words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def latin_words() -> str:
    """WORDS for plain texts (see Encoder.plain) as a pattern of the standard library, which is faster."""
    plain = [chr(c) for c in (*range(33, 127), *range(0xA1, 0x180), 0x307)]
    kind = lambda k: re.escape("".join(c for c in plain if unicodedata.category(c)[0] == k))
    return f"[{kind('L')}]+|'(?:s|t|re|ve|m|ll|d)|[{kind('N')}]|[^{kind('L')}{kind('N')} \\t-\\r]+"


class Encoder:
    """Exact ids of a tokenizer file; texts of Latin letters go word by word through a cache.

    The cached path holds only for a tokenizer that lower-cases, drops white space and splits words
    without regard to their neighbours, and that marks each word's last id (its file says so); any
    other file, and any text with other scripts, controls or special strings, goes through the
    library whole. Words that the cache doesn't have go through the library together, between
    spaces. The ids of all words lie in one array, so the ids of a batch of texts are one gather.
    """

    ASCII = bytes([9, 10, 11, 12, 13, *range(32, 127)])

    def __init__(self, spec: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        read = json.loads(spec)
        steps = (read.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        kinds = [n.get("type") for n in (read.get("normalizer") or {}).get("normalizers", [])]
        mark = read["model"].get("end_of_word_suffix")
        self.split = None
        if kinds == ["NFC", "Replace", "Lowercase"] and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and mark:
            pattern = steps[0]["pattern"]["Regex"]
            self.split = re.compile(latin_words()).findall if pattern == WORDS else regex.compile(pattern).findall
            self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.last[[i for word, i in read["model"]["vocab"].items() if word.endswith(mark)]] = True
        self.other = re.compile(r"[^\t\n\v\f\r -~¡-ſ]").search
        self.words: dict[str, int] = {}
        self.hits = np.zeros(0, np.int64)  # of each word so far
        self.flat, self.ends = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def enter(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Further entries at the end of the array."""
        self.ends = np.concatenate([self.ends, (self.ends[-1] if len(self.ends) else 0) + np.cumsum(lengths)])
        self.flat = np.concatenate([self.flat, ids])
        self.hits = np.concatenate([self.hits, np.zeros(len(lengths), np.int64)])

    def learn(self, words: list[str]) -> None:
        """Encode words that the cache doesn't have, all between spaces, and enter them."""
        if not words:
            return
        ids = self.library(" ".join(words))
        stops = np.flatnonzero(self.last[ids]) + 1
        lengths = np.diff(stops, prepend=0)
        if len(stops) != len(words) or stops[-1] != len(ids):  # not one mark a word: each for itself
            each = [self.library(w) for w in words]
            ids, lengths = np.concatenate(each), np.array([len(e) for e in each], np.int64)
        self.words.update(zip(words, range(len(self.ends), len(self.ends) + len(words)), strict=True))
        self.enter(ids, lengths)

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries, one after the other, and where each ends."""
        lengths = np.diff(self.ends, prepend=0)[which]
        after = np.cumsum(lengths)
        return self.flat[np.arange(int(after[-1]) if len(after) else 0) + np.repeat(self.ends[which] - after, lengths)], after

    def shrink(self) -> None:
        """Keep the words with the most hits, half as many as the cache may hold."""
        words = list(self.words)
        which = np.fromiter(self.words.values(), np.int64, len(words))
        keep = np.argsort(-self.hits[which], kind="stable")[: CACHE_ENTRIES // 2]
        hits = self.hits[which[keep]]
        ids, after = self.gather(which[keep])
        self.words = {words[i]: n for n, i in enumerate(keep.tolist())}
        self.flat, self.ends, self.hits = ids, after, hits

    def plain(self, text: str) -> bool:
        """Whether the text has Latin letters, white space and signs alone, and no special string."""
        if self.split is None or "<|" in text:
            return False
        return not text.encode().translate(None, self.ASCII) if text.isascii() else not self.other(text)

    def words_in(self, text: str) -> list[str]:
        return self.split(text.lower())

    def batch_ids(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by end_id, one after the other, and where each text's ids begin and end."""
        if len(self.words) > CACHE_ENTRIES:
            self.shrink()
        plain = [bool(text) and self.plain(text) for text in texts]
        words = [self.words_in(text) if p else [] for text, p in zip(texts, plain, strict=True)]
        self.learn([w for w in set(chain.from_iterable(words)) if w not in self.words])
        others = [self.library(text) for text, p in zip(texts, plain, strict=True) if text and not p]
        own = len(self.ends)  # entries of this batch alone: the end, then texts that went through the library whole
        self.enter(np.concatenate([np.array([end_id], "<u4"), *others]), np.array([1, *map(len, others)], np.int64))
        number, numbers, count, whole = self.words.__getitem__, [], [], own
        for text, p, its in zip(texts, plain, words, strict=True):
            if text and not p:
                whole += 1
                numbers.append(whole)
            numbers.extend(map(number, its))
            numbers.append(own)
            count.append(len(its) + 1 + bool(text and not p))
        which = np.array(numbers, np.int64)
        ids, after = self.gather(which)
        self.hits += np.bincount(which, minlength=len(self.hits))
        self.ends, self.hits, self.flat = self.ends[:own], self.hits[:own], self.flat[: self.ends[own - 1] if own else 0]
        return ids, np.concatenate([[0], after[np.cumsum(count) - 1]]) if count else np.zeros(1, np.int64)


def _encoder(shared) -> Encoder:
    if _worker.get("id") != shared.value[0]:
        _worker.update(id=shared.value[0], encoder=Encoder(shared.value[1]))
    return _worker["encoder"]


class FreeRoom:
    """Tournament tree: a leaf per bin with its free room, a node with the most of its two children."""

    def __init__(self, capacity: int, bins: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for size, less that room from now on."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        found = at - self.leaves
        tree[at] -= size
        while at > 1:
            at //= 2
            left, right = tree[2 * at], tree[2 * at + 1]
            most = left if left >= right else right
            if tree[at] == most:
                break
            tree[at] = most
        return found


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset there of each length; ties keep the given order."""
    order = np.argsort(-lengths, kind="stable")
    room = FreeRoom(capacity, len(lengths))
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), {}
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        b = room.place(size)
        bins[i], offsets[i] = b, used.get(b, 0)
        used[b] = used.get(b, 0) + size
    return bins, offsets


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
PIECE_TYPE = ", ".join(f"{c} long" for c in PIECE)


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens and place (its task and number there)."""
    spark = docs.sparkSession
    ship_package(spark)
    spec = Path(tokenizer_path).read_text()
    shared = spark.sparkContext.broadcast((zlib.crc32(spec.encode()), spec))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, place = _encoder(shared), TaskContext.get().partitionId() << PLACE_BITS
        for batch in slices(batches, 1, BATCH_BYTES):
            ids, bounds = encoder.batch_ids(batch.column(1).to_pylist(), end_id)
            total = np.diff(bounds)
            pieces = -(-total // capacity)
            row = np.repeat(np.arange(len(total)), pieces)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            length = np.minimum(capacity, total[row] - start)
            begin = bounds[row] + start
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(c, pa.int64()) for c in (start, length, crc, total[row], place + np.arange(len(row))))], [*PIECE, "place"])
            place += len(row)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, f"{PIECE_TYPE}, place long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, group_pieces: int = 8192, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is a document of the end id alone. A document of more than ``capacity`` ids
    is cut at multiples of it. Repeated rows are packed each for itself; rows with a null id are
    packed as well and keep the null. Groups hold about ``group_pieces`` pieces whatever the size of
    the input and however often a row repeats; they depend on the rows and their places in the tasks
    that read them, so a lost task is redone alike. An empty table gives an empty result; other
    columns are ignored.
    """
    pieces = materialize(tokenised_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    grouped = pieces.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", "place"), F.lit(groups)))

    def fill(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = part.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32", "place")])
        bins, offsets = first_fit_decreasing(part["length"].to_numpy(), capacity)
        placed = part.select(PIECE).append_column("sequence_id", pa.array(key[0].as_py() * (1 << GROUP_BITS) + bins))
        return placed.append_column("offset", pa.array(offsets))

    return grouped.groupBy("group").applyInArrow(fill, f"{PIECE_TYPE}, sequence_id long, offset long")
