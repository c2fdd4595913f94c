"""Registered queries on small tables where a cut of the input or of a loop would change the result."""

import datetime

import duckdb
import pytest
from oracle import TABLES, rows

from assaylake.operators import decision, fronts, screening
from assaylake.plans import registry


@pytest.fixture
def tables(spark, tmp_path):
    """Writes frames as tables of a folder, and opens the folder in DuckDB."""

    def write(**frames):
        db = duckdb.connect()
        for name, (data, schema) in frames.items():
            spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
            assert name in TABLES
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        return str(tmp_path), db

    return write


def test_criteria_read_every_observation(spark, tables):
    day = lambda y: datetime.date(y, 5, 1)
    items = [  # order, line, part, flag, status, date, price, quantity, discount, tax
        (12, 1, 1, "A", "O", day(1995), 100.0, 1.0, 0.0, 0.0), (12, 2, 1, "B", "O", day(1995), 200.0, 1.0, 0.0, 0.0),  # conflicting
        (24, 1, 2, "A", "O", day(1995), 100.0, 1.0, 0.0, 0.0), (24, 2, 2, "A", "O", day(1996), 100.0, 1.0, 0.0, 0.0),  # incomparable
        (37, 1, 3, "A", "O", day(1995), 100.0, 1.0, 0.1, 0.1), (37, 2, 3, "B", "O", day(1995), 100.0, 1.0, 0.1, 0.1),  # available
        (5, 1, 4, "A", "O", day(1995), 300.0, 1.0, 0.1, 0.1),
        (7, 1, 5, "A", "O", day(1995), 105.0, 1.0, 0.1, 0.1),
    ]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_linestatus string, l_shipdate date, l_extendedprice double, l_quantity double, l_discount double, l_tax double"
    parts = ([(i, "x", "brand") for i in range(1, 6)], "p_partkey long, p_type string, p_brand string")
    folder, db = tables(lineitem=(items, names), part=parts)
    status = {r.candidate_id: (r.status, r.n_observations) for r in registry.queries()["criterion_status"](spark, folder).collect()}
    assert status == {12: ("conflicting", 2), 24: ("incomparable", 2), 37: ("available", 2), 5: ("available", 1), 7: ("available", 1)}
    assert {r.candidate_id: r.front for r in registry.queries()["robust_fronts"](spark, folder).collect()} == {37: 1, 7: 1, 5: 2}
    for name in ("criterion_status", "condition_groups", "robust_fronts", "pool_score", "completeness"):
        got = registry.queries()[name](spark, folder)
        want = db.execute(registry.oracle_sql()[name])
        assert rows(got.columns, got.collect()) == rows([c[0] for c in want.description], want.fetchall()), name


def test_required_events_of_every_user(spark, tables):
    events = [(20, 1, "signup"), (21, 1, "purchase"), (3, 2, "error"), (4, 2, "signup"), (5, 2, "purchase")]
    folder, db = tables(events=(events, "event_id long, user_id long, event_type string"))
    got = registry.queries()["required_missing"](spark, folder)
    assert {r.user_id: r.missing for r in got.collect()} == {1: "error", 2: ""}
    want = db.execute(registry.oracle_sql()["required_missing"])
    assert rows(got.columns, got.collect()) == rows([c[0] for c in want.description], want.fetchall())


def test_fronts_go_on_until_no_row_is_left(spark, monkeypatch):
    """A chain has as many fronts as rows, in groups that one task numbers and in larger ones."""
    chain = spark.range(3000).selectExpr("id", "'g' AS g", "-1.0D * id AS w", "-1.0D * id AS b").union(spark.sql("SELECT 9999L, 'g', null, 1.0D"))
    want = {i: i + 1 for i in range(3000)}
    assert {r.id: r.front for r in decision.robust_fronts(chain, "id", "g", [("w", "b")]).collect()} == want
    two = chain.selectExpr("*", "w AS w2", "b AS b2")
    with pytest.raises(ValueError):
        decision.robust_fronts(chain.selectExpr("id", "g", "w + 1 AS w", "b"), "id", "g", [("w", "b")])
    for most, block in ((32_768, 8192), (1200, 500)):
        monkeypatch.setattr(fronts, "MOST", most)
        monkeypatch.setattr(fronts, "BLOCK", block)
        assert {r.id: r.front for r in decision.robust_fronts(two, "id", "g", [("w", "b"), ("w2", "b2")]).collect()} == want
        assert {r.id: r.front for r in screening.pareto_fronts(chain.selectExpr("id", "g", "-w AS x", "-b AS y"), "id", "g", ["x", "y"]).collect()} == want


def test_external_match_is_of_whole_texts(spark, tables):
    opening = "the same opening of more than sixty characters, word for word, "
    docs = [(1, "src1", "es", opening + "then one end", 75), (2, "src1", "es", " " + opening.upper() + "then\n another  end ", 80), (3, "src7", "en", opening + "then another end", 79), (4, "src1", "es", None, 0), (5, "src2", "en", "x", 1)]
    folder, _ = tables(documents=(docs, "doc_id long, source string, lang string, text string, n_chars long"), benchmark=([(8, opening + "then another end"), (9, opening + "then another end")], "item_id long, text string"))
    found = {name: {r.doc_id: r.status for r in registry.queries()[name](spark, folder).collect()} for name in ("external_match", "novelty_status")}
    assert found["external_match"] == {1: "no_match", 2: "match", 3: "unknown", 4: "no_match", 5: "no_match"}
    assert found["novelty_status"] == {1: "no_match", 2: "match", 3: "unknown", 4: "no_match", 5: "no_match"}
    assert {(r.candidate_id, r.slot, r.reserved) for r in registry.queries()["reserve_slot"](spark, folder).collect()} == {(2, 1, False), (3, 2, False), (1, 3, False), (5, 4, False), (4, 5, False)}
