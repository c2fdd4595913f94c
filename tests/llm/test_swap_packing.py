"""Best-fit packing with exchanges: every id once, the library on odd texts, bins against bounds and the optimum."""

import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from test_simple_ops import ODD, odd
from tokenizers import Tokenizer

from assaylake.llm import swap_packing

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def fewest(sizes, capacity):
    """The least number of bins, by trying every bin for every size."""

    @cache
    def tried(left, rooms):
        if not left:
            return len(rooms)
        size, rest = left[0], left[1:]
        options = [tried(rest, tuple(sorted((*rooms[:i], r - size, *rooms[i + 1 :])))) for i, r in enumerate(rooms) if r >= size and r not in rooms[:i]]
        return min([*options, tried(rest, tuple(sorted((*rooms, capacity - size))))])

    return tried(tuple(sorted(sizes, reverse=True)), ())


def test_few_sizes_reach_the_optimum():
    rng = np.random.default_rng(5)
    over = 0
    for _ in range(60):
        sizes = rng.integers(1, 60, rng.integers(1, 11)).tolist()
        bins = swap_packing.fewest_bins(sizes, 100)
        assert sorted(s for b in bins for s in b) == sorted(sizes) and all(sum(b) <= 100 for b in bins)
        over += len(bins) - fewest(sizes, 100)
    assert over <= 2


@pytest.mark.parametrize(("low", "high"), [(1, 2048), (1, 300), (1, 20), (500, 900), (600, 1500), (2047, 2048), (1024, 1025)])
def test_exchanges_never_need_more_bins(low, high):
    sizes = np.random.default_rng(low).integers(low, high, 3000).tolist()
    plain, bins = swap_packing.best_fit_decreasing(sizes, 2048), swap_packing.fewest_bins(sizes, 2048)
    assert sorted(s for b in bins for s in b) == sorted(sizes) and max(map(sum, bins)) <= 2048 and all(bins)
    assert max(-(-sum(sizes) // 2048), sum(s > 1024 for s in sizes)) <= len(bins) <= len(plain)
    if (low, high) == (500, 900):  # three a bin seldom fit: best fit alone leaves much room
        assert len(bins) < 0.97 * len(plain)


def test_every_exchange_raises_the_squared_fill():
    sizes = np.random.default_rng(2).integers(500, 900, 400).tolist()
    search = swap_packing.Exchange(swap_packing.best_fit_decreasing(sizes, 2048), 2048)
    squares, best = [sum(sum(b) ** 2 for b in search.bins)], search.best

    def watched(a):
        squares.append(sum(sum(b) ** 2 for b in search.bins))
        return best(a)

    search.best = watched
    search.run()
    assert search.exchanges > 20 and squares == sorted(squares)


def test_offsets_have_no_gaps():
    lengths = np.random.default_rng(4).integers(1, 700, 500)
    bins, offsets = swap_packing.place_pieces(lengths, 1000)
    for b in range(bins.max() + 1):
        its = sorted(zip(offsets[bins == b].tolist(), lengths[bins == b].tolist(), strict=True))
        assert [o for o, _ in its] == np.cumsum([0, *[n for _, n in its]])[:-1].tolist() and sum(n for _, n in its) <= 1000
    assert [x.tolist() for x in swap_packing.place_pieces(np.zeros(0, np.int64), 1000)] == [[], []]


@pytest.mark.parametrize("entries", [4, 100_000])
def test_encoder_equals_the_library(monkeypatch, entries):
    from assaylake.llm import packing

    monkeypatch.setattr(packing, "CACHE_ENTRIES", entries)
    monkeypatch.setattr(swap_packing, "ROW", 3)
    spec = open(BYTES).read()
    encoder, tokenizer = swap_packing.ByteEncoder(spec), Tokenizer.from_str(spec)
    assert encoder.split("it's  x'9²é!\n\n a \t") == ["it", "'s", " ", " x", "'", "9²", "é", "!", "\n\n", " a", " \t"]
    for texts in (ODD, [], [None], ODD[::-1], ["mit'sx 'll ''d don'tl ×÷ÿſª º_-—", " \n x\v\f y  ", "A B  C\r\n D'S"], ODD[5:]):
        ids, bounds = encoder.batch_ids(texts, 0)
        for text, a, b in zip(texts, bounds, bounds[1:]):
            assert ids[a:b].tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], text
    for text in (*ODD[1:], "ab cd  ef\n gh " * 50):
        assert encoder.long_text(text, 0, 5).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0], text


@pytest.mark.parametrize("which", ["odd", "table"])
def test_packing_holds_every_id_once(spark, sf, which):
    docs = odd(spark).where("doc_id is not null").dropDuplicates(["doc_id"]) if which == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    tokenizer = Tokenizer.from_file(BYTES)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    by_doc, by_sequence = {}, {}
    for r in swap_packing.pack(docs, BYTES, group_pieces=64).collect():
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for key, pieces in by_doc.items():
        ids, at = np.array([*tokenizer.encode(texts[key], add_special_tokens=False).ids, 0], "<u4"), 0
        for i, p in enumerate(sorted(pieces, key=lambda p: p.piece)):
            assert (p.piece, p.start) == (i, at) and (p.length == 2048 or i == 0)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    tokens = sum(p.length for pieces in by_doc.values() for p in pieces)
    assert len(by_sequence) <= -(-tokens // 2048) + 3 + 2 * len(texts) // 64


def test_packing_keeps_null_and_repeated_ids(spark):
    """Ids above 2 ** 53 beside null ones, and rows that repeat: each row is packed for itself, equal rows in several groups."""
    big = (1 << 53) + 1
    docs = [(big, "the of and"), (None, "the of and"), (None, None), (big, "other words")] + [(7, "the of and that")] * 500 + [(None, "")] * 300
    rows = swap_packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), BYTES, group_pieces=64).collect()
    tokenizer = Tokenizer.from_file(BYTES)
    want = sorted(str((d, zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()))) for d, t in docs)
    assert sorted(str((r.doc_id, r.ids_crc32)) for r in rows) == want
    copies = [r.sequence_id >> 32 for r in rows if r.doc_id == 7]
    assert len(set(copies)) > 5 and max(map(copies.count, set(copies))) < 150
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_packing_empty(spark):
    assert swap_packing.pack(odd(spark).limit(0), BYTES).collect() == []
