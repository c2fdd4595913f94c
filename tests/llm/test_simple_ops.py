"""Token counts, packing and Ogg media against the libraries, brute force and round trips."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assaylake.llm import ogg_media, packing, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "   ", "a", " a", "a ", "a  b", "  a   b  ", "x\n\ny", "\t", "tab\tx", "<s> </s> <unk>", "<|endoftext|> x <|startoftext|>", "▁a▁ b", "日本語 テキスト", "\u0000 nul", "É́ Ǆ İ ΟΔΟΣ", "don't WE'LL 1234 ½ ²", "😀 😀😀", "a b\u0085c\u001cd", "wort" * 3000, "the of and " * 6000]
SCHEMA = "doc_id long, text string, n_tokens string, length string, media string"


def odd(spark):
    return spark.createDataFrame([(i, t, "x", "y", None) for i, t in enumerate(ODD)] + [(3, "   ", None, None, None), (None, "a", "x", "y", "z")], SCHEMA)


@pytest.mark.parametrize("which", ["odd", "table"])
def test_token_counts_equal_the_library(spark, sf, which):
    docs = odd(spark) if which == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    encode = sentencepiece.SentencePieceProcessor(model_file=PIECES).encode
    got = token_counts.count_tokens(docs.select("doc_id", "text", F.col("text").alias("copy"), F.lit(1).alias("n_tokens")), PIECES).collect()
    assert len(got) == docs.count()
    for r in got:
        text = r.copy or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), len(encode(text)), len(encode(text)) > 4096), text[:50]


def test_token_counts_empty(spark):
    assert token_counts.count_tokens(odd(spark).limit(0).select("doc_id", "text"), PIECES).collect() == []


@pytest.mark.parametrize("which", ["odd", "table"])
def test_packing_holds_every_id_once(spark, sf, which):
    docs = odd(spark).where("doc_id is not null").dropDuplicates(["doc_id"]) if which == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    tokenizer = Tokenizer.from_file(WORDS)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = packing.pack(docs, WORDS, group_pieces=64).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for key, pieces in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[key], add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096


def test_packing_keeps_null_and_repeated_ids(spark):
    """Ids above 2 ** 53 beside null ones, and rows that repeat: each row is packed for itself, equal rows in several groups."""
    big = (1 << 53) + 1
    docs = [(big, "the of and"), (None, "the of and"), (None, None), (big, "other words")] + [(7, "the of and that")] * 500 + [(None, "")] * 300
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), WORDS, group_pieces=64).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    count = lambda xs: {x: xs.count(x) for x in set(xs)}
    want = [(d, zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for d, t in docs]
    assert count([(r.doc_id, r.ids_crc32) for r in rows]) == count(want)
    copies = count([r.sequence_id >> 32 for r in rows if r.doc_id == 7])
    assert len(copies) > 5 and max(copies.values()) < 150
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


@pytest.mark.parametrize("entries", [4, 1000])
def test_encoder_equals_the_library(monkeypatch, entries):
    """Batches of odd texts with a cache that is full after a few words, and with one that holds them all."""
    monkeypatch.setattr(packing, "CACHE_ENTRIES", entries)
    spec = open(WORDS).read()
    encoder, tokenizer = packing.Encoder(spec), Tokenizer.from_str(spec)
    assert encoder.split is not None and encoder.split("it's x'9²é!") == ["it", "'s", "x", "'", "9", "²", "é", "!"]
    for texts in (ODD, [], [None], ODD[::-1], ["mit'sx 'll ''d don'tl ×÷ÿſª º_-—"], ODD[5:]):
        ids, bounds = encoder.batch_ids(texts, 2)
        assert len(bounds) == len(texts) + 1 and bounds[-1] == len(ids)
        for text, a, b in zip(texts, bounds, bounds[1:]):
            assert ids[a:b].tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], text


def test_packing_empty(spark):
    assert packing.pack(odd(spark).limit(0), WORDS).collect() == []


def test_first_fit_decreasing_equals_a_scan():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 100, 300)
    bins, _ = packing.first_fit_decreasing(lengths, 100)
    room, plain = [], np.zeros(300, int)
    for i in np.argsort(-lengths, kind="stable"):
        b = next((k for k, r in enumerate(room) if r >= lengths[i]), None)
        if b is None:
            room.append(100)
            b = len(room) - 1
        room[b] -= lengths[i]
        plain[i] = b
    assert (bins == plain).all()


def test_page_checksum_equals_the_bitwise_definition():
    data = bytes(range(256)) + b"OggS"
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    assert ogg_media.page_checksum(data) == crc


@pytest.mark.parametrize("size", [64, 192, 255, 510, 7999, 8000, 8001, 64000, 65025, 200_000])
def test_ogg_round_trip_and_damage(size):
    payload = np.random.default_rng(size).integers(0, 256, size, np.uint8).tobytes()
    media = ogg_media.encode(payload, size - 1)
    got, n_bytes, rate, ends, pages = ogg_media.decode(media)
    assert (got, n_bytes, rate, ends[-1]) == (payload, size - 1, 8000, size / 8000)
    assert ends == sorted(ends) and pages >= 4
    for at in (5, 30, len(media) // 2, len(media) - 1):
        with pytest.raises((ValueError, StopIteration)):
            ogg_media.decode(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
    with pytest.raises((ValueError, StopIteration)):
        ogg_media.decode(media[:-1])


def test_ogg_columns(spark):
    rows = ogg_media.read_features(ogg_media.store(odd(spark))).collect()
    assert len(rows) == len(ODD) + 2
    by_text = {}
    for r in rows:
        text = "a" if r.doc_id is None else ODD[r.doc_id] or ""
        raw = text.encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert by_text.setdefault(text, r[1:]) == r[1:]
    assert ogg_media.read_features(ogg_media.store(odd(spark).limit(0))).collect() == []
