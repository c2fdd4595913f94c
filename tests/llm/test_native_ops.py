"""Licence scan against SQL and hand-made texts; weak supervision against plain loops."""

import collections
import math
import re

import duckdb
from pyspark.sql import functions as F

from assaylake.llm import license_scan, weak_supervision

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_license_scan_equals_sql(spark, sf):
    got = license_scan.scan(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit(1).alias("sequence"))).collect()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rows = db.sql(license_scan.duckdb_sql()).fetchall()
    assert sorted(map(tuple, got)) == sorted(rows)
    assert any(r.licenses for r in got)


def test_license_rules(spark):
    grant, notice, warranty = (license_scan.SENTENCES[f"mit.{k}"][0] for k in ("grant", "notice", "asis"))
    bsd = [license_scan.SENTENCES[f"bsd.{k}"][0] for k in ("grant", "source", "binary", "names")]
    texts = [None, "", "Nothing, here. At all.", f"x.\n{grant.upper()}:\n\n{notice}.  Some words. {warranty}!", f"{notice}. {grant}.", ". ".join(bsd), ". ".join(bsd[:3]), "Licensed under the Apache  License, Version 2.0.\nAll rights reserved.", "w " * 50_000 + "\nReleased under the MIT License."]
    want = ["", "", "", "MIT-text", "", "BSD-3-Clause", "BSD-2-Clause", "Apache-2.0,All-rights-reserved", "MIT"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, None, "x")], "doc_id long, text string, _ids string")
    rows = license_scan.scan(docs).orderBy("doc_id").collect()
    assert [r.licenses for r in rows] == ["", *want]
    assert [r.license_class for r in rows][-2:] == ["restricted", "permissive"]
    assert license_scan.scan(docs.limit(0)).collect() == []


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = collections.Counter(windows)
    marked = {k for i, w in enumerate(windows) if seen[w] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


def check(docs):
    rows = weak_supervision.judge(docs).collect()
    texts = docs.select("doc_id", "text").collect()
    assert sorted((str(r.doc_id), *r[1:6]) for r in rows) == sorted((str(t.doc_id), *plain_counts(t.text)) for t in texts)
    # expectation-maximisation again, row by row
    votes = [r.votes for r in rows]
    k = len(weak_supervision.RULES)
    start, smooth = weak_supervision.START, weak_supervision.SMOOTH
    prior, cells = 0.5, [list(start) for _ in range(k)]
    weigh = lambda c: [min(0, math.log(c[3] / c[0])), 0, max(0, math.log(c[5] / c[2]))]
    posterior = lambda vs: 1 / (1 + math.exp(-math.log(prior / (1 - prior)) - sum(weigh(c)[v + 1] for v, c in zip(vs, cells))))
    for _ in range(weak_supervision.ROUNDS):
        table = {vs: posterior(vs) for vs in set(map(tuple, votes))}
        q = [table[tuple(vs)] for vs in votes]
        mass = [len(q) - sum(q), sum(q)]
        cells = [[(sum((p if g else 1 - p) for p, vs in zip(q, votes) if vs[j] == v) + smooth * start[3 * g + v + 1]) / (mass[g] + smooth) for g in (0, 1) for v in (-1, 0, 1)] for j in range(k)]
        prior = min(0.98, max(0.02, (sum(q) + 5) / (len(q) + 10)))
    for r in rows:
        quality = posterior(r.votes)
        assert abs(quality - r.quality) < 1e-6
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert (r.base_failed, r.kept) == (failed, not failed and r.quality >= 0.5)
    return rows


def test_quality_table(spark, sf):
    rows = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    right = [r.kept == bool(labels[r.doc_id]) for r in rows if r.doc_id in labels]
    assert sum(right) / len(right) > 0.95
    print(sum(right) / len(right), collections.Counter((r.kept, r.base_failed, labels.get(r.doc_id)) for r in rows))


def test_quality_odd_rows(spark):
    texts = [None, "", " \n ", "one", "a b c d e f g h " * 4, "a b c d e f g h", "x y z\nx y z\n\nx y z", "the cat sat. " * 20_000, "# * $ | " * 30, "é ü " * 3, "a b\u0085c d\x1ce"]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(None, "one", "k"), (0, None, None)], "doc_id long, text string, votes string")
    check(docs)
    assert weak_supervision.judge(docs.limit(0)).collect() == []
