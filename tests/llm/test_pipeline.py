"""The pipeline's stages, each against brute force on its own input."""

import collections
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from tests_llm_plain import plain_components, plain_removed
from tokenizers import Tokenizer

from assaylake.session import materialize

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = materialize(stage(spark, docs, SF), name)
        after = docs.collect()
        seen[name] = (before, after)
        if name != "packing":
            assert docs.columns == columns
    before, after = seen["language_id"]
    truth = {r.doc_id: r.lang for r in before}
    assert len(after) >= 0.99 * len(before) and sum(truth[r.doc_id] == r.lang for r in after) >= 0.99 * len(after)
    assert {r.doc_id: r.text for r in after}.items() <= {r.doc_id: r.text for r in before}.items()
    before, after = seen["near_dedup"]
    group = {d: c for d, _, c in plain_components([(r.doc_id, r.text) for r in before], 5)}
    assert sorted(r.doc_id for r in after) == sorted(set(group.values()))
    before, after = seen["suffix_dedup"]
    kept = {d: k for d, k in plain_removed([(r.doc_id, r.text.encode()) for r in before]).items() if k.strip()}
    assert {r.doc_id for r in after} == set(kept)
    for r in after:
        raw = r.text.encode()
        assert raw == kept[r.doc_id] or raw == kept[r.doc_id].decode(errors="ignore").encode()
        assert r.n_chars == len(r.text)
    before, after = seen["mixing"]
    copies = collections.Counter(r.doc_id for r in after)
    assert max(copies.values()) <= 2 and {r.doc_id: r.text for r in after}.items() <= {r.doc_id: r.text for r in before}.items()
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(words(after) / words(before) - 1.5) < 0.02
    before, after = seen["packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in after)
    want = collections.Counter()
    for r in before:
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        want.update((r.doc_id, s, len(p := ids[s : s + 4096]), zlib.crc32(p.tobytes())) for s in range(0, len(ids), 4096))
    assert pieces == want
    used = collections.Counter()
    for r in after:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096 and sum(used.values()) / (4096 * len(used)) > 0.97


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, row int"
    text = "the of and that is with for " * 30
    rows = [(1, text, "en", "a", 1, "x", 1), (2, None, None, None, None, None, None), (3, "", "en", "a", 0, None, 1), (4, "!!! ???", None, "a", 7, None, 1), (1, text, "en", "a", 1, "x", 1), (5, text * 300, "en", None, 1, None, 1), (None, "some words without an id of the and", None, "a", 1, None, 1)]
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, SF), name)
        docs.collect()
