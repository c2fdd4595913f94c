"""Fronts, covers, rounds, sinks, file scans and streams against plain loops."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from assaylake.operators import control, decision, routing, selection
from assaylake.sources import contracts, providers
from assaylake.streaming import controllers


def plain_fronts(rows):
    """rows: (entity, group, axes) with axes a list of (worst, best)."""
    out, rest, front = {}, list(rows), 0
    while rest:
        front += 1
        beaten = lambda a: any(a[1] == b[1] and all(w >= h for (w, _), (_, h) in zip(b[2], a[2])) and any(w > h for (w, _), (_, h) in zip(b[2], a[2])) for b in rest)  # noqa: B023, E731
        top = [a for a in rest if not beaten(a)]
        out.update({a[0]: front for a in top})
        rest = [a for a in rest if a not in top]
    return out


@pytest.mark.parametrize(("axes", "block"), [(1, 1 << 16), (1, 20), (2, 20)])
def test_robust_fronts(spark, monkeypatch, axes, block):
    monkeypatch.setattr(decision, "FRONT_BLOCK", block)
    rng = random.Random(axes)
    rows = []
    for i in range(60 if axes == 2 else 300):
        ends = [sorted((rng.randrange(40), rng.randrange(40))) for _ in range(axes)]
        rows.append((i, rng.choice("ab"), [tuple(map(float, e)) for e in ends]))
    flat = [(i, g, *[x for e in ends for x in e]) for i, g, ends in rows] + [(999, "a", *[None] * (2 * axes))]
    names = [c for k in range(axes) for c in (f"w{k}", f"h{k}")]
    frame = spark.createDataFrame(flat, ", ".join(["id long", "g string", *(f"{c} double" for c in names)]))
    got = {r.id: r.front for r in decision.robust_fronts(frame, "id", "g", [(f"w{k}", f"h{k}") for k in range(axes)]).collect()}
    assert got == plain_fronts(rows)
    assert decision.robust_fronts(frame.limit(0), "id", "g", [(f"w{k}", f"h{k}") for k in range(axes)]).collect() == []
    with pytest.raises(ValueError, match="worst"):
        decision.robust_fronts(spark.createDataFrame([(1, "a", 2.0, 1.0)], "id long, g string, w0 double, h0 double"), "id", "g", [("w0", "h0")])


@pytest.mark.parametrize("block", [4096, 2])
def test_cover_of_sets(spark, monkeypatch, block):
    monkeypatch.setattr(control, "BLOCK", block)
    rng = random.Random(5)
    rows = [(b, r, float(rng.randrange(5)), float(rng.randrange(5))) for b in "ab" for r in range(12) for _ in range(rng.randrange(1, 5))]
    got = {(x.b, x.r): x.improvement for x in control.cover(spark.createDataFrame(rows, "b string, r long, x double, y double"), ["b"], "r", ["x", "y"]).collect()}
    for b in "ab":
        for r in range(12):
            of = lambda n: [(x, y) for c, k, x, y in rows if (c, k) == (b, n)]  # noqa: B023, E731
            covers = lambda one, two: all(any(p[0] >= q[0] and p[1] >= q[1] for p in one) for q in two)
            want = None if r == 0 else covers(of(r), of(r - 1)) - covers(of(r - 1), of(r))
            assert got[b, r] == want


def test_replay_of_rounds(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(4), i, f"s{rng.randrange(60)}", rng.random() < 0.8, float(rng.randrange(20)), float(rng.randrange(20)) if i % 3 else None) for i in range(90)]
    frame = spark.createDataFrame(rows, "round_index long, candidate_id long, identity string, eligible boolean, a double, b double")
    got = {(r["round"], r.branch, r.slot): r.candidate_id for r in routing.replay_rounds(frame, {"a": F.col("a"), "b": F.col("b")}, 5, 3).collect()}
    first = {}
    for r in sorted(x for x in rows if x[3]):
        first.setdefault(r[2], r)
    want = {}
    for at, branch in ((4, "a"), (5, "b")):
        pool = [r for r in first.values() if r[at] is not None]
        for now in range(4):
            best = sorted((r for r in pool if r[0] <= now), key=lambda r: (-r[at], r[1]))[:5]
            want.update({(now, branch, i + 1): r[1] for i, r in enumerate(best)})
            pool = [r for r in pool if r not in best]
    assert got == want


def test_reports_and_files(spark, tmp_path):
    rows = spark.createDataFrame([("r1", 1, ["x", "y"]), ("r2", 2, None)], "run_id string, n long, tags array<string>")
    inventory = contracts.write_report(rows, str(tmp_path / "report")).collect()
    assert len(inventory) == 2
    for item in inventory:
        raw = open(item.path.removeprefix("file:"), "rb").read()
        assert (item.n_bytes, item.sha256) == (len(raw), hashlib.sha256(raw).hexdigest())
    contracts.write_report(spark.createDataFrame([("r2", 5, None)], rows.schema), str(tmp_path / "report")).collect()
    assert sorted((r.run_id, r.n) for r in spark.read.json(str(tmp_path / "report")).collect()) == [("r1", 1), ("r2", 5)]
    contracts.write_report_csv(rows, str(tmp_path / "csv"))
    assert {line for p in (tmp_path / "csv").glob("*.csv") for line in p.read_text().splitlines()} == {"r1,1,x;y", "r2,2,", "run_id,n,tags"}
    contracts.append_events(rows, str(tmp_path / "log"))
    contracts.append_events(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_generated_molecules_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,SMILES\n1, CCO \n2,""\n3,CCO\n4,"C\nC"\n5,CN\n6,CC\n')
    got = providers.generator_csv(spark, str(tmp_path / "a.csv"), 3).collect()
    assert [(r.position, r.smiles) for r in got] == [(1, "CCO"), (2, "CN"), (3, "CC")]
    with pytest.raises(ValueError, match="fewer"):
        providers.generator_csv(spark, str(tmp_path / "a.csv"), 4)
    (tmp_path / "b.csv").write_text("id,name\n1,x\n")
    with pytest.raises(ValueError, match="column"):
        providers.generator_csv(spark, str(tmp_path / "b.csv"), 1)


def test_broken_payloads(spark):
    for scan in (providers.europe_pmc, providers.openalex, providers.crossref):
        rows = spark.createDataFrame([("not json", 1), (None, 2), ("{}", 3), ("[1]", 4)], "p string, title int")
        found = scan(rows, "p").collect()
        assert sorted(r.row.title for r in found) == [1, 2, 3, 4] and all(r.title == "" and r.authors == [] for r in found)
    entry = "<feed><entry><id>http://arxiv.org/abs/1v1</id><title>A</title></entry><entry><title> </title></entry></feed>"
    xml = spark.createDataFrame([(entry,)], "value string").select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<entry[\s>].*?</entry>"), F.lit(0))).alias("xml"))
    assert [r.arxiv_id for r in providers.arxiv(xml, "xml").collect()] == ["1v1"]
    assert {r.unsupported for r in providers.optimade(spark.createDataFrame([("x",), (json.dumps({"id": "a", "type": "structures"}),)], "p string"), "p").collect()} == {"not_a_structure", "attributes_missing"}


def test_xml_files(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<feed>\n<entry><id>http://arxiv.org/abs/7v2</id>\n<title>T\nU</title></entry>\n<entry><title>V</title></entry></feed>")
    found = providers.arxiv(providers.read_xml_records(spark, str(tmp_path), "entry"), "xml").collect()
    assert sorted((r.title, r.arxiv_id) for r in found) == [("T U", "7v2"), ("V", None)]


def test_streams_of_counts_and_novelty(spark, tmp_path):
    schema = "ts timestamp, kind string, fingerprint string"
    rows = [("2024-01-01 00:05:00", "a", "x"), ("2024-01-01 00:50:00", "a", "y"), ("2024-01-01 01:05:00", "b", "x"), ("2024-01-01 05:00:00", "a", "z")]
    frame = spark.createDataFrame([(t, k, f) for t, k, f in rows], "t string, kind string, fingerprint string").select(F.col("t").cast("timestamp").alias("ts"), "kind", "fingerprint")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    history = spark.createDataFrame([("x",), ("x",)], "fingerprint string")

    def run(made, name, mode):
        query = made(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
        return spark.table(name).collect()

    counts = run(lambda s: controllers.windowed_counts(s, "ts", "kind"), "counts", "complete")
    assert sorted((str(r.window.start), r.kind, r.n) for r in counts) == [("2024-01-01 00:00:00", "a", 2), ("2024-01-01 01:00:00", "b", 1), ("2024-01-01 05:00:00", "a", 1)]
    novel = run(lambda s: controllers.history_novelty(s, history, "fingerprint"), "novel", "append")
    assert sorted((r.fingerprint, r.known) for r in novel) == [("x", True), ("x", True), ("y", False), ("z", False)]


@pytest.mark.parametrize("axes", [["x"], ["x", "y"]])
def test_nearest_distance(spark, axes):
    rng = random.Random(len(axes))
    rows = [(i, rng.choice("abc"), rng.choice([rng.random(), rng.randrange(3) / 2, 1e6 * rng.random()]), rng.random()) for i in range(150)] + [(900, "single", 1.0, 1.0), (901, "none", None, 1.0), (902, "same", 1.0, 2.0), (903, "same", 1.0, 2.0)]
    frame = spark.createDataFrame(rows, "id long, pool string, x double, y double")
    got = {r.id: r.diversity for r in selection.nearest_distance(frame, "id", "pool", axes).collect()}
    points = {r[0]: (r[1], r[2:] if len(axes) == 2 else r[2:3]) for r in rows if r[2] is not None}
    for i, (pool, p) in points.items():
        gaps = [max(abs(a - b) for a, b in zip(p, q)) for j, (other, q) in points.items() if other == pool and j != i]
        assert got.pop(i) == pytest.approx(min(gaps, default=1.0))
    assert got == {}
