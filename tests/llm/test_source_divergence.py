"""Divergence of sources against plain counts, against DuckDB, and with digests that terms share."""

import re
import string
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from assaylake.llm import source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_rows(docs, least_docs, top):
    groups, by_lang, holders = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        terms = plain_terms(text)
        groups[lang or "", source or ""].update(terms)
        by_lang[lang or ""].update(terms)
        holders[lang or ""].update(set(terms))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in holders[lang].items() if n >= least_docs]

        def shares(counts):
            whole = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // whole for t in kept}

        mine = {s: shares(c) for (g, s), c in groups.items() if g == lang}
        all_of = shares(by_lang[lang])
        for s, p in mine.items():
            pairs = [(-sum((p[t] - q[t]) ** 2 // (p[t] + q[t]) for t in kept), o.encode(), o) for o, q in mine.items() if o != s]
            terms = [(-((p[t] - all_of[t]) ** 2 // (p[t] + all_of[t])), t.encode(), t) for t in kept if groups[lang, s][t] and p[t] > all_of[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def found(spark, docs, **kinds):
    df = spark.createDataFrame([(None, *d) for d in docs], "doc_id long, lang string, source string, text string").withColumns({"term": F.lit("x"), "word": F.lit(1), "n": F.lit(None).cast("long"), "v": F.lit(2)})
    return sorted(map(tuple, source_divergence.divergence(df, **kinds).select(*source_divergence.RESULT).collect()))


def some_docs(n=160):
    rng = np.random.default_rng(11)
    words = [*"the of and Été été ÉTÉ x' y-z naïve 日本語 ß ſ K don't a1b2c ".split(), "w" * 700, *[f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)]]
    docs = []
    for i in range(n):
        picked = rng.choice(len(words), int(rng.integers(0, 60)), p=(w := 1 / np.arange(1, len(words) + 1)) / w.sum())
        docs.append((["en", "de", None, "en"][i % 4], ["hot", "hot", "a", "b", None][int(rng.integers(0, 5))], " ".join(words[k] for k in picked)))
    return [*docs, ("en", "bare", None), ("en", "bare", ""), ("xx", "lone", "few words"), ("yy", "a", "!!"), ("yy", "b", "12"), ("zz", "", "same same"), ("zz", None, "same")] + [("en", "copies", "the copied text")] * 30


@pytest.mark.parametrize("bits", [64, 5, 1])
def test_rows_equal_plain_counts(spark, bits):
    docs = some_docs()
    assert found(spark, docs, least_docs=3, top=4, bits=bits) == plain_rows(docs, 3, 4)


def test_ties_are_told_apart_by_spelling(spark):
    """Many terms of one value in one small source: the first by bytes are ranked."""
    docs = [("en", "a", " ".join(f"tie{chr(97 + i)}é" for i in range(26)))] * 3 + [("en", "b", "other words"), ("en", "c", "words")] * 3
    assert found(spark, docs, least_docs=2, top=5) == plain_rows(docs, 2, 5)


def test_table_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = source_divergence.divergence(spark.read.parquet(f"{sf}/documents.parquet")).select(*source_divergence.RESULT)
    assert differences(got, connect(sf), source_divergence.duckdb_sql()) is None


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, None, None), ("en", "", "")]) == []


@pytest.mark.parametrize("bits", [64, 3])
@pytest.mark.parametrize("block", [1 << 19, 64])
def test_terms_of_a_batch(monkeypatch, bits, block):
    """Texts that touch each other, empty ones, long terms; equal numbers mean equal terms, whatever the digests."""
    monkeypatch.setattr(source_divergence, "BLOCK", block)
    monkeypatch.setattr(source_divergence, "_powers", [])
    texts = ["ab", "cd ab", None, "", "AB", "é" * 300 + " " + "x" * 700, "x" * 699 + "y", "ab\x00cd@Z[z`{é", "zz", " ", "", "x" * 700 + "é"]
    batch = pa.array(["cut off", *texts]).slice(1)
    terms = source_divergence.Terms(batch, bits)
    want = [(d, t) for d, text in enumerate(texts) for t in plain_terms(text)]
    words = terms.spelling(np.arange(len(terms.some)))
    assert [(int(d), words[t]) for d, t in zip(terms.doc, terms.term, strict=True)] == want
    assert len(set(words)) == len(words)
    if bits == 64:
        assert len(set(terms.digest.tolist())) == len(words)
        alone = {w: int(source_divergence.Terms(pa.array([w])).digest[0]) for w in words}  # digests don't depend on the place
        assert alone == dict(zip(words, terms.digest.tolist(), strict=True))
    g, t, n, docs = terms.counts(np.arange(len(texts)) % 2)
    assert {(int(a), words[b]): (int(c), int(d)) for a, b, c, d in zip(g, t, n, docs, strict=True)} == {
        (k, w): (sum(x == w and d % 2 == k for d, x in want), len({d for d, x in want if x == w and d % 2 == k})) for k, w in {(d % 2, w) for d, w in want}
    }


def test_filter_has_every_digest(spark):
    terms = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 5000)
    bitmap = source_divergence.digest_filter(spark.createDataFrame([(int(t),) for t in terms], "term long"))
    assert source_divergence.in_filter(terms, bitmap).all() and source_divergence.in_filter(terms + 12345, bitmap).mean() < 0.01
