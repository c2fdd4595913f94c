"""Decisions on observations of parts under conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import scalars as S
from assaylake.operators import assessment
from assaylake.operators import decision as O
from assaylake.plans.registry import query
from assaylake.session import materialize

# A case is an order: its criteria are its items' part types, each under the year of shipping.
CRIT = """crit AS (
  SELECT candidate_id, role_id,
         CASE WHEN count(DISTINCT cond_year) > 1 THEN 'incomparable'
              WHEN count(DISTINCT (value, lower_bound, upper_bound)) > 1 THEN 'conflicting' ELSE 'available' END AS status,
         min(value) AS v, min(lower_bound) AS lo, min(upper_bound) AS hi, min(cond_year) AS y,
         array_to_string(list_sort(list(DISTINCT validator_id)), ';') AS validators, count(*) AS n_observations
  FROM {b_case} GROUP BY 1, 2)"""
AVAIL = f"{CRIT}, avail AS (SELECT candidate_id, role_id, y, lo, hi, v FROM crit WHERE status = 'available')"


def criteria(t):
    return O.criterion_status(t.b_case, ["candidate_id", "role_id"], "cond_year", "value", "lower_bound", "upper_bound", "validator_id")


def available(t):
    rows = criteria(t).where("status = 'available'").withColumn("group_id", F.concat_ws("|", "role_id", "cond_year"))
    worth = S.interval_utility(F.col("lower_bound"), F.col("upper_bound"), F.lit("minimize"), F.lit(None).cast("double"))
    return rows.withColumn("u", worth).select("candidate_id", "role_id", "group_id", F.col("u.worst").alias("worst"), F.col("u.best").alias("best"))


@query(f"WITH {CRIT} SELECT candidate_id, role_id, status, CASE WHEN status = 'available' THEN v END AS value, CASE WHEN status = 'available' THEN lo END AS lower_bound, CASE WHEN status = 'available' THEN hi END AS upper_bound, CASE WHEN status <> 'incomparable' THEN y END AS cond_year, validators, n_observations FROM crit")
def criterion_status(t):
    return criteria(t).withColumn("validators", S.joined(F.col("validators")))


@query("""WITH g AS (SELECT candidate_id, CASE WHEN upper_bound < 950 OR lower_bound > 1700 THEN 'fail' WHEN lower_bound < 950 OR upper_bound > 1700 THEN 'unknown' ELSE 'pass' END AS gate FROM {b_observation})
SELECT candidate_id, CASE WHEN bool_or(gate = 'fail') THEN 'fail' WHEN bool_or(gate = 'unknown') THEN 'unknown' ELSE 'pass' END AS hard_gate FROM g GROUP BY 1""")
def hard_gate(t):
    gate = S.interval_gate(F.col("lower_bound"), F.col("upper_bound"), F.lit(950.0), F.lit(1700.0))
    return O.gate_rollup(t.b_observation.select("candidate_id", gate.alias("gate")), ["candidate_id"])


@query(f"WITH {CRIT} SELECT role_id, sha256(CAST(to_json(list_sort(list(CAST(to_json(['price', CAST(y AS VARCHAR)]) AS VARCHAR)))) AS VARCHAR)) AS group_id, candidate_id, count(*) AS n_criteria FROM crit WHERE status = 'available' GROUP BY role_id, candidate_id")
def condition_groups(t):
    return O.condition_groups(criteria(t).where("status = 'available'"), ["role_id", "candidate_id"], [F.lit("price"), F.col("cond_year")])


@query(f"""WITH RECURSIVE {AVAIL},
levels(role_id, y, level) AS (
  SELECT role_id, y, max(-hi) FROM avail GROUP BY role_id, y
  UNION ALL
  SELECT l.role_id, l.y, (SELECT max(-a.hi) FROM avail a WHERE a.role_id = l.role_id AND a.y = l.y AND -a.lo < l.level) FROM levels l
  WHERE EXISTS (SELECT 1 FROM avail a WHERE a.role_id = l.role_id AND a.y = l.y AND -a.lo < l.level))
SELECT a.candidate_id, a.role_id, 1 + count(l.level) AS front FROM avail a
LEFT JOIN levels l ON l.role_id = a.role_id AND l.y = a.y AND l.level > -a.lo GROUP BY 1, 2""")
def robust_fronts(t):
    rows = available(t).withColumn("entity", F.struct("candidate_id", "role_id"))
    return O.robust_fronts(rows, "entity", "group_id", [("worst", "best")]).select("entity.candidate_id", "entity.role_id", "front")


OFFER = ["l_partkey AS candidate_id", "l_quantity AS quantity",
         "floor(l_extendedprice / l_quantity * (CAST(1 AS DOUBLE) - l_discount) * 10000 + 0.5) / 10000 AS low",
         "floor(l_extendedprice / l_quantity * (CAST(1 AS DOUBLE) + l_tax) * 10000 + 0.5) / 10000 AS high"]


@query(f"""WITH RECURSIVE offers AS (SELECT DISTINCT {", ".join(OFFER)} FROM {{lineitem}}), ids AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM offers),
beats AS MATERIALIZED (SELECT a.id AS better, b.id FROM ids a JOIN ids b ON b.candidate_id = a.candidate_id
  AND a.high <= b.low AND a.quantity - 2 >= b.quantity + 2 AND (a.high < b.low OR a.quantity - 2 > b.quantity + 2)),
chain(id, front) AS (SELECT id, 1 FROM ids UNION SELECT b.id, c.front + 1 FROM chain c JOIN beats b ON b.better = c.id)
SELECT candidate_id, quantity, low, high, CAST(max(front) AS BIGINT) AS front FROM ids JOIN chain USING (id) GROUP BY ALL""")
def robust_offer_fronts(t):
    """Distinct offers of a part by two uncertain axes: a low price (between its bounds) and a large quantity (give or take two)."""
    rows = t.lineitem.selectExpr(*OFFER).distinct().withColumn("offer", F.struct("candidate_id", "quantity", "low", "high"))
    ends = {"w0": -F.col("high"), "b0": -F.col("low"), "w1": F.col("quantity") - 2, "b1": F.col("quantity") + 2}
    return O.robust_fronts(rows.withColumns(ends), "offer", "candidate_id", [("w0", "b0"), ("w1", "b1")]).select("offer.*", "front")


@query(f"""WITH {AVAIL}, s AS (SELECT candidate_id, role_id, y, -hi AS w, min(-hi) OVER p AS lo_, max(-hi) OVER p AS hi_, count(*) OVER p AS n FROM avail WINDOW p AS (PARTITION BY role_id, y)),
k AS (SELECT candidate_id, role_id, y, CASE WHEN n >= 2 THEN CASE WHEN abs(hi_ - lo_) <= 1e-9 * greatest(abs(hi_), abs(lo_)) THEN 50.0 ELSE 100.0 * (w - lo_) / (hi_ - lo_) END END AS score FROM s)
SELECT candidate_id, role_id || '|' || CAST(y AS VARCHAR) AS group_id, floor(score * 10000 + 0.5) / 10000 AS score, dense_rank() OVER (PARTITION BY role_id, y ORDER BY floor(score * 10000 + 0.5) DESC NULLS LAST) AS rank FROM k""")
def pool_score(t):
    from pyspark.sql import Window

    rows = available(t).withColumn("criterion_id", F.lit("price")).withColumn("weight", F.lit(1.0))
    out = O.pool_scores(rows, "candidate_id", "group_id", "worst", "weight").withColumn("score", S.rounded(F.col("score")))
    out = materialize(out, "scored").withColumn("_s", F.struct("score"))  # in a struct a missing score joins too
    ranks = out.select("group_id", "_s").distinct()  # a group's distinct scores: of four digits, at most a million
    ranks = ranks.withColumn("rank", F.dense_rank().over(Window.partitionBy("group_id").orderBy(F.col("_s.score").desc_nulls_last())).cast("long"))
    return out.join(ranks, ["group_id", "_s"]).drop("_s")


@query(f"WITH {CRIT} SELECT role_id, floor(100.0 * count(CASE WHEN status = 'available' THEN 1 END) / count(*) * 10000 + 0.5) / 10000 AS completeness, count(*) AS n_criteria, bool_and(status = 'available') AS ready FROM crit GROUP BY 1")
def completeness(t):
    return O.completeness(criteria(t), ["role_id"]).withColumn("completeness", S.rounded(F.col("completeness")))


@query("""SELECT l.doc_id, b.item_id, CASE WHEN b.item_id IS NULL THEN 'unknown_record' WHEN d.doc_id IS NULL THEN 'unknown_claim' ELSE 'resolved' END AS status FROM (SELECT doc_id, doc_id % 50 AS item FROM {labels}) l LEFT JOIN {documents} d USING (doc_id) LEFT JOIN {benchmark} b ON b.item_id = l.item""")
def citations(t):
    cited = t.labels.select("doc_id", (F.col("doc_id") % 50).alias("item"))
    claims = t.documents.select("doc_id", F.lit(True).alias("claim"))
    out = cited.join(claims, "doc_id", "left").join(t.benchmark.select("item_id"), F.col("item") == F.col("item_id"), "left")
    status = F.when(F.col("item_id").isNull(), "unknown_record").when(F.col("claim").isNull(), "unknown_claim").otherwise("resolved")
    return out.select("doc_id", "item_id", status.alias("status"))


@query("""SELECT DISTINCT role_id, name, sha256(CAST(to_json([role_id, name]) AS VARCHAR)) AS seed_id FROM (SELECT p_type AS role_id, lower(p_brand) AS name FROM {part} UNION ALL SELECT s_name, lower(s_name) FROM (SELECT CAST(s_suppkey AS VARCHAR) AS s_name FROM {supplier}))""")
def seed_union(t):
    seeds = t.part.select(F.col("p_type").alias("role_id"), F.lower("p_brand").alias("name"))
    given = t.supplier.select(F.col("s_suppkey").cast("string").alias("role_id"), F.col("s_suppkey").cast("string").alias("name"))
    return seeds.unionByName(given).distinct().withColumn("seed_id", S.identity_hash(F.col("role_id"), F.col("name")))


#: Lines as observations of an order's part types: unit prices under a year and status, and lots. Both engines read this.
LINES = """SELECT l_orderkey AS candidate_id, p_type AS role_id, l_partkey || '/' || l_linenumber AS line, 'v' || (l_suppkey % 5) AS validator_id, l_quantity,
  CASE WHEN l_tax > 0.075 THEN 'failed' WHEN l_tax > 0.065 THEN 'incomparable' ELSE 'success' END AS status,
  CASE WHEN l_linenumber = 7 THEN 'EUR' ELSE 'USD' END AS unit, CASE WHEN l_discount < 0.005 THEN '' ELSE CAST(year(l_shipdate) AS STRING) END AS y, l_linestatus AS flag,
  floor(l_extendedprice / l_quantity * 10000 + 0.5) / 10000 AS value,
  floor(l_extendedprice / l_quantity * (CAST(1 AS DOUBLE) - l_discount) * 10000 + 0.5) / 10000 AS lower_bound,
  floor(l_extendedprice / l_quantity * (CAST(1 AS DOUBLE) + l_tax) * 10000 + 0.5) / 10000 AS upper_bound
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey"""
JUDGED = f"""lines AS ({LINES}), seen AS (
  SELECT candidate_id, role_id, role_id || '/price' AS criterion_id, line || '/price' AS observation_id, value, lower_bound, upper_bound, NULL::DOUBLE AS low, NULL::DOUBLE AS high,
    '{{"flag":"' || flag || '","year":"' || y || '"}}' AS scope, status, validator_id <> 'v4' AND unit = 'USD' AND y <> '' AND (role_id <> 'ECONOMY' OR flag = 'F') AS fits FROM lines
  UNION ALL SELECT candidate_id, role_id, role_id || '/lot', line || '/lot', l_quantity, l_quantity, l_quantity, 5, 40, '{{}}', status, validator_id IN ('v0', 'v1') FROM lines),
judged AS (SELECT *, fits AND status = 'success' AS ok, NOT fits OR status = 'incomparable' AS off FROM seen),
whole AS (SELECT candidate_id, role_id, criterion_id, any_value(low) AS low, any_value(high) AS high, count(*) AS n, count(CASE WHEN ok THEN 1 END) AS n_ok,
  bool_or(off) AS off, count(DISTINCT CASE WHEN ok THEN scope END) AS scopes, count(DISTINCT CASE WHEN ok THEN (value, lower_bound, upper_bound) END) AS values_,
  min(CASE WHEN ok THEN value END) AS v, min(CASE WHEN ok THEN lower_bound END) AS lo, min(CASE WHEN ok THEN upper_bound END) AS hi, min(CASE WHEN ok THEN scope END) AS scope
  FROM judged GROUP BY 1, 2, 3),
statuses AS (SELECT *, CASE WHEN n_ok > 0 AND scopes = 1 THEN CASE WHEN values_ > 1 THEN 'conflicting' ELSE 'available' END WHEN scopes > 1 OR off THEN 'incomparable' ELSE 'unknown' END AS status FROM whole)"""


def assessed(t):
    lines = materialize(t.spark.sql(LINES, lineitem=t.lineitem, part=t.part), "lines")  # read three times below
    same = ["candidate_id", "role_id", "validator_id", "status"]
    price = lines.select(*same, F.concat("line", F.lit("/price")).alias("observation_id"), F.lit("unit_price").alias("property_name"), "unit", F.create_map(F.lit("year"), "y", F.lit("flag"), "flag").alias("conditions"), "value", "lower_bound", "upper_bound")
    lot = lines.select(*same, F.concat("line", F.lit("/lot")).alias("observation_id"), F.lit("lot").alias("property_name"), F.lit("pieces").alias("unit"), F.expr("cast(map() as map<string,string>)").alias("conditions"), *[F.col("l_quantity").alias(c) for c in ("value", "lower_bound", "upper_bound")])
    roles = t.part.select(F.col("p_type").alias("role_id")).distinct()
    criteria = roles.selectExpr("role_id", "concat(role_id, '/price') AS criterion_id", "'unit_price' AS property_name", "'USD' AS unit", "array('v0', 'v1', 'v2', 'v3') AS validator_ids",
                                "array('year', 'flag') AS required_context", "if(role_id = 'ECONOMY', map('flag', 'F'), null) AS target", "cast(null AS double) AS minimum", "cast(null AS double) AS maximum")
    lots = roles.selectExpr("role_id", "concat(role_id, '/lot') AS criterion_id", "'lot' AS property_name", "'pieces' AS unit", "array('v0', 'v1') AS validator_ids", "cast(array() AS array<string>) AS required_context",
                            "cast(null AS map<string,string>) AS target", "5D AS minimum", "40D AS maximum")
    return assessment.assess_criteria(lines.select("candidate_id", "role_id").distinct(), criteria.unionByName(lots), price.unionByName(lot))


@query(f"""WITH {JUDGED} SELECT candidate_id, role_id, criterion_id, status, CASE WHEN status = 'available' THEN v END AS value, CASE WHEN status = 'available' THEN lo END AS lower_bound,
  CASE WHEN status = 'available' THEN hi END AS upper_bound, CASE WHEN status = 'available' THEN scope END AS conditions,
  CASE WHEN scopes > 1 THEN 0 ELSE n_ok END AS n_accepted, n - CASE WHEN scopes > 1 THEN 0 ELSE n_ok END AS n_rejected,
  CASE WHEN status = 'available' THEN CASE WHEN low IS NULL THEN 'not_configured' WHEN hi < low OR lo > high THEN 'fail' WHEN lo < low OR hi > high THEN 'unknown' ELSE 'pass' END
       WHEN low IS NOT NULL OR status = 'conflicting' THEN 'unknown' ELSE 'not_configured' END AS hard_gate,
  CASE status WHEN 'available' THEN 'CONDITION_COMPLETE_NAMED_VALIDATOR' WHEN 'conflicting' THEN 'CONFLICTING_NAMED_VALIDATORS'
       WHEN 'incomparable' THEN 'UNIT_VALIDATOR_OR_CONDITION_MISMATCH' ELSE 'NO_SUCCESSFUL_NAMED_VALIDATOR' END AS reason_code FROM statuses""")
def criterion_assessment(t):
    return assessed(t)[0]


@query(f"""WITH {JUDGED} SELECT j.candidate_id, j.role_id, j.criterion_id, j.observation_id, j.ok AND w.scopes = 1 AS accepted FROM judged j JOIN whole w USING (candidate_id, role_id, criterion_id)""")
def criterion_verdicts(t):
    return assessed(t)[1]


@query(f"""WITH {JUDGED}, per AS (SELECT candidate_id, role_id, count(*) AS n, count(CASE WHEN status = 'available' THEN 1 END) AS a, count(CASE WHEN status = 'conflicting' THEN 1 END) AS c, count(CASE WHEN status = 'incomparable' THEN 1 END) AS i,
  count(CASE WHEN status = 'unknown' THEN 1 END) AS u, array_to_string(list_sort(list(CASE WHEN status <> 'available' THEN criterion_id || ':' || status END) FILTER (status <> 'available')), ';') AS tradeoffs,
  coalesce(list(CASE WHEN status <> 'available' THEN criterion_id || ':run_named_validator' END) FILTER (status <> 'available'), []) AS steps,
  max(CASE WHEN low IS NOT NULL AND status = 'available' THEN CASE WHEN hi < low OR lo > high THEN 'fail' WHEN lo < low OR hi > high THEN 'unknown' ELSE 'pass' END WHEN low IS NOT NULL THEN 'unknown' END) AS gate FROM statuses GROUP BY 1, 2),
f AS (SELECT per.*, o_orderpriority, o_totalprice, o_orderstatus, CASE WHEN o_totalprice > 300000 THEN 1 WHEN o_totalprice > 100000 THEN 3 END AS front FROM per JOIN {{orders}} ON o_orderkey = candidate_id)
SELECT candidate_id, role_id, floor(100.0 * a / n * 10000 + 0.5) / 10000 AS completeness, CASE WHEN c > 0 THEN 'conflicting' WHEN a < n THEN 'unknown' ELSE 'bounded' END AS uncertainty,
  array_to_string(list_sort(list_filter([CASE WHEN o_orderstatus = 'P' THEN 'SOURCE_BACKED_RETRIEVAL_SEED' END, CASE WHEN front = 1 THEN 'ROBUST_NON_DOMINATED_WITHIN_ROLE_AND_CONDITION' END, CASE WHEN front > 1 THEN 'PARETO_FRONT_' || front END,
    'OPERATOR_WEIGHTED_POOL_RELATIVE_SCORE_AVAILABLE', CASE WHEN gate = 'pass' THEN 'ALL_CONFIGURED_HARD_GATES_PASS' END, CASE WHEN a > 0 THEN 'NAMED_VALIDATOR_EVIDENCE_AVAILABLE' END,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'EXTERNAL_DATABASE_SCOPED_NO_MATCH_RETAINED_AS_CONTEXT_ONLY' END], lambda x: x IS NOT NULL)), ';') AS why,
  array_to_string(list_sort(list_filter([CASE WHEN front > 1 THEN 'DOMINATED_WITHIN_MATCHED_ROLE_AND_CONDITION' END, CASE WHEN gate = 'fail' THEN 'AT_LEAST_ONE_CONFIGURED_HARD_GATE_FAILS' END, CASE WHEN gate = 'unknown' THEN 'HARD_GATE_UNCERTAINTY_OR_MISSING_EVIDENCE' END,
    CASE WHEN a = 0 THEN 'NO_CONDITION_COMPLETE_PERFORMANCE_EVIDENCE' END, CASE WHEN o_totalprice > 450000 THEN 'HIGH_MODEL_DISAGREEMENT' END], lambda x: x IS NOT NULL)), ';') AS why_not,
  coalesce(tradeoffs, '') AS tradeoffs,
  array_to_string(list_sort(list_filter([CASE WHEN u > 0 THEN 'criterion_without_named_validator' END, CASE WHEN i > 0 THEN 'evidence_incomparable' END, CASE WHEN c > 0 THEN 'validators_disagree' END, CASE WHEN o_totalprice > 450000 THEN 'models_disagree' END,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'identity_unresolved' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'no_match_is_no_proof' END], lambda x: x IS NOT NULL)), ';') AS doubts,
  array_to_string(list_sort(list_concat(steps, list_filter([CASE WHEN o_totalprice > 450000 THEN 'resolve_model_disagreement' END, CASE WHEN o_orderstatus = 'P' THEN 'close_retrieval_seed' END], lambda x: x IS NOT NULL))), ';') AS next_steps FROM f""")
def explanations(t):
    """Codes that explain each order's part types: what speaks for and against them, what is open, and what to do next."""
    found = materialize(assessed(t)[0], "assessed")
    gates = found.where("criterion_id LIKE '%/lot'").groupBy("candidate_id", "role_id").agg(F.max("hard_gate").alias("hard_gate"))
    of = t.orders.select(
        F.col("o_orderkey").alias("candidate_id"), F.when(F.col("o_orderstatus") == "P", "retrieval_seed").alias("origin"), F.when(F.col("o_totalprice") > 300000, 1).when(F.col("o_totalprice") > 100000, 3).alias("front"),
        F.col("o_totalprice").alias("score"), F.when(F.col("o_totalprice") > 450000, "high").alias("model_disagreement"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "database_scoped_no_match").when(F.col("o_orderpriority") == "5-LOW", "unknown").alias("identity_status"),
    )
    out = assessment.explain(gates.join(of, "candidate_id"), found)
    return out.withColumn("completeness", S.rounded(F.col("completeness"))).withColumns({c: S.joined(F.col(c)) for c in ("why", "why_not", "tradeoffs", "doubts", "next_steps")})
