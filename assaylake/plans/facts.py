"""Typed scans, identities, lookups and aggregates over expert evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import scalars as S
from assaylake.operators import evidence as E
from assaylake.plans.registry import query
from assaylake.sources import contracts

WEIGHTS = "SELECT * FROM VALUES ('energy', 2.0D), ('max_force', 1.0D), ('stress', 1.0D) AS w(property_name, weight)"
LIMITS = "SELECT * FROM VALUES ('c_energy', 'energy', 'between', 900.0D, 1900.0D), ('c_force', 'max_force', 'lte', 0.1D, CAST(NULL AS DOUBLE)), ('c_stress', 'stress', 'gt', 0.02D, CAST(NULL AS DOUBLE)) AS c(constraint_id, property_name, operator, first, second)"


@query("""
SELECT event_id, CASE WHEN len(r) = 0 THEN 'valid' ELSE 'rejected' END AS status, array_to_string(r, ';') AS reasons FROM (
  SELECT event_id, list_sort(list_filter([
    CASE WHEN len(list_filter(json_keys(props), lambda k: k <> 'k')) > 0 THEN 'unknown_field' END,
    CASE WHEN try_cast(props->>'k' AS BIGINT) IS NULL THEN 'wrong_type' END,
    CASE WHEN NOT (value >= 1) THEN 'out_of_range' END,
    CASE WHEN event_type NOT IN ('signup', 'purchase', 'view', 'click') THEN 'unknown_enum' END], lambda x: x IS NOT NULL)) AS r FROM {events})""")
def scan_contract(t):
    rules = {
        "unknown_field": contracts.unknown_keys("props", ["k"]),
        "wrong_type": F.get_json_object("props", "$.k").try_cast("bigint").isNull(),
        "out_of_range": ~(F.col("value") >= 1),
        "unknown_enum": ~F.col("event_type").isin("signup", "purchase", "view", "click"),
    }
    out = contracts.split_valid(t.events, rules)
    return out.select("event_id", "status", S.joined(F.col("reasons")).alias("reasons"))


@query("""SELECT o_orderkey, sha256(CAST(to_json([CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), o_orderpriority]) AS VARCHAR)) AS digest FROM {orders}""")
def content_digest(t):
    return t.orders.select("o_orderkey", S.identity_hash(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderpriority")).alias("digest"))


@query("""SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN 'digest_mismatch' WHEN doc_id % 89 = 0 THEN 'size_mismatch' ELSE 'verified' END AS status, strlen(text) AS byte_size FROM {documents}""")
def verified_read(t):
    stored = t.documents.select("doc_id", F.col("text").cast("binary").alias("payload"), F.when(F.col("doc_id") % 97 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2(F.col("text"), 256)).alias("sha256"), (F.octet_length("text") + F.when(F.col("doc_id") % 89 == 0, 1).otherwise(0)).alias("size"))
    return contracts.verify_payload(stored, "payload", "sha256", "size").select("doc_id", "status", F.octet_length("payload").cast("long").alias("byte_size"))


@query("""SELECT evidence_id, candidate_id, method_class, status FROM {b_evidence_record}
WHERE method_class IN ('1-URGENT', '2-HIGH') AND status = 'success' AND candidate_id IN (SELECT c_custkey FROM {customer} WHERE c_acctbal > 5000)""")
def evidence_lookup(t):
    wanted = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("candidate_id"))
    keys = t.b_evidence_record.where(F.col("method_class").isin("1-URGENT", "2-HIGH") & (F.col("status") == "success"))
    return keys.join(wanted, "candidate_id", "left_semi").select("evidence_id", "candidate_id", "method_class", "status")


@query("""SELECT candidate_id, role_id, cond_year, CASE WHEN count(DISTINCT unit) = 1 THEN floor(avg(value) * 10000 + 0.5) / 10000 END AS mean_value, count(value) AS n_values,
       CASE WHEN count(DISTINCT unit) = 1 THEN min(unit) END AS unit, array_to_string(list_sort(list(DISTINCT validator_id)), ';') AS sources, CASE WHEN count(DISTINCT unit) > 1 THEN 'mixed_units' END AS warning,
       CASE WHEN count(DISTINCT unit) = 1 THEN floor(max(upper_bound - lower_bound) * 10000 + 0.5) / 10000 END AS max_uncertainty, bool_or(value > 2000) AS any_out_of_domain
FROM {b_observation} GROUP BY candidate_id, role_id, cond_year""")
def property_aggregate(t):
    rows = t.b_observation.withColumn("width", F.col("upper_bound") - F.col("lower_bound")).withColumn("far", F.col("value") > 2000)
    out = E.property_aggregate(rows, ["candidate_id", "role_id", "cond_year"], "value", "unit", "validator_id", "width", "far")
    return out.withColumn("mean_value", S.rounded(F.col("mean_value"))).withColumn("max_uncertainty", S.rounded(F.col("max_uncertainty"))).withColumn("sources", S.joined(F.col("sources")))


@query("""SELECT l_partkey AS candidate_id, l_suppkey AS expert_id, min(l_tax) AS value, min(l_linestatus) AS unit FROM {lineitem} GROUP BY 1, 2 HAVING count(DISTINCT (l_tax, l_linestatus)) = 1""")
def unambiguous_properties(t):
    rows = t.lineitem.select(F.col("l_partkey").alias("candidate_id"), F.col("l_suppkey").alias("expert_id"), F.col("l_tax").alias("value"), F.col("l_linestatus").alias("unit"))
    return E.unambiguous(rows, ["candidate_id", "expert_id"])


@query("""SELECT candidate_id, floor(max(CASE WHEN experts >= 2 AND u1 = u2 THEN least(1.0, (hi - lo) / greatest(abs(lo), abs(hi), 1e-12)) END) * 10000 + 0.5) / 10000 AS disagreement,
count(CASE WHEN experts >= 2 AND u1 = u2 THEN 1 END) AS n_compared FROM (
SELECT candidate_id, property_name, min(value) lo, max(value) hi, count(DISTINCT expert_id) experts, min(unit) u1, max(unit) u2 FROM {b_property} GROUP BY 1, 2) GROUP BY 1""")
def expert_disagreement(t):
    return E.expert_disagreement(t.b_property, "candidate_id").withColumn("disagreement", S.rounded(F.col("disagreement")))


@query("""WITH p AS (SELECT * FROM {b_property}),
d AS (SELECT candidate_id, max(CASE WHEN e >= 2 AND u1 = u2 THEN least(1.0, (hi - lo) / greatest(abs(lo), abs(hi), 1e-12)) END) AS dis FROM (
 SELECT candidate_id, property_name, min(value) lo, max(value) hi, count(DISTINCT expert_id) e, min(unit) u1, max(unit) u2 FROM p WHERE property_name <> 'energy' GROUP BY 1, 2) GROUP BY 1),
u AS (SELECT candidate_id, min(CASE WHEN property_name = 'max_force' THEN -abs(value - 0.05) ELSE CASE WHEN value BETWEEN 0.02 AND 0.06 THEN 1.0 ELSE -least(abs(value - 0.02), abs(value - 0.06)) END END) AS worst FROM p WHERE property_name <> 'energy' GROUP BY 1),
c AS (SELECT candidate_id, count(DISTINCT expert_id) AS n_experts, count(DISTINCT property_name) AS n_properties FROM p GROUP BY 1)
SELECT c.candidate_id, n_experts, n_properties, floor(worst * 10000 + 0.5) / 10000 AS worst_utility, floor(dis * 10000 + 0.5) / 10000 AS disagreement FROM c LEFT JOIN d USING (candidate_id) LEFT JOIN u USING (candidate_id)""")
def controller_state(t):
    rows = t.b_property
    is_force = F.col("property_name") == "max_force"
    worth = S.controller_utility(F.col("value"), F.when(is_force, "target").otherwise("range"), F.lit(0.05), F.lit(0.02), F.lit(0.06))
    worth = F.when(F.col("property_name") != "energy", worth)
    counts = rows.groupBy("candidate_id").agg(F.countDistinct("expert_id").alias("n_experts"), F.countDistinct("property_name").alias("n_properties"), F.min(worth).alias("w"))
    spread = E.expert_disagreement(rows, "candidate_id", exclude=("energy",))
    return counts.join(spread, "candidate_id", "left").select("candidate_id", "n_experts", "n_properties", S.rounded(F.col("w")).alias("worst_utility"), S.rounded(F.col("disagreement")).alias("disagreement"))


@query("""SELECT candidate_id, expert_id, property_name, floor((CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 1.0 END) * 10000 + 0.5) / 10000 AS normalized FROM (
SELECT r.*, min(value) OVER w AS lo, max(value) OVER w AS hi FROM (SELECT b.*, CASE WHEN property_name = 'energy' THEN p_brand END AS scope FROM {b_property} b JOIN {part} ON p_partkey = candidate_id) r
WINDOW w AS (PARTITION BY property_name, expert_id, scope))""")
def minmax_norm(t):
    rows = t.b_property.join(t.part.select(F.col("p_partkey").alias("candidate_id"), "p_brand"), "candidate_id")
    rows = rows.withColumn("scope", F.when(F.col("property_name") == "energy", F.col("p_brand")))
    out = E.min_max(rows, "value", ["property_name", "expert_id", "scope"])
    return out.select("candidate_id", "expert_id", "property_name", S.rounded(F.col("normalized")).alias("normalized"))


@query("""WITH n AS (SELECT candidate_id, property_name, CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 1.0 END AS nv FROM (
SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM {b_property} WINDOW w AS (PARTITION BY property_name, expert_id))),
m AS (SELECT candidate_id, property_name, min(nv) AS worst, CASE property_name WHEN 'energy' THEN 2.0 ELSE 1.0 END AS weight FROM n GROUP BY 1, 2)
SELECT candidate_id, CASE WHEN count(worst) = 3 THEN floor(sum(weight * worst) / sum(weight) * 10000 + 0.5) / 10000 END AS goal_score FROM m GROUP BY 1""")
def goal_score(t):
    rows = E.min_max(t.b_property, "value", ["property_name", "expert_id"])
    return E.goal_score(rows, t.spark.sql(WEIGHTS), "candidate_id").withColumn("goal_score", S.rounded(F.col("goal_score")))


@query("""WITH c AS (SELECT * FROM (VALUES ('c_energy', 'energy'), ('c_force', 'max_force'), ('c_stress', 'stress')) v(constraint_id, property_name)),
s AS (SELECT p_partkey AS candidate_id, constraint_id, count(b.value) AS n, min(unit) u1, max(unit) u2,
 bool_and(CASE c.property_name WHEN 'energy' THEN value BETWEEN 900 AND 1900 WHEN 'max_force' THEN value <= 0.1 ELSE value > 0.02 END) AS ok
 FROM {part} CROSS JOIN c LEFT JOIN {b_property} b ON b.candidate_id = p_partkey AND b.property_name = c.property_name GROUP BY 1, 2)
SELECT candidate_id, coalesce(string_agg(CASE WHEN n = 0 THEN 'missing:' WHEN u1 <> u2 THEN 'mixed_units:' WHEN NOT ok THEN 'violated:' END || constraint_id, ';' ORDER BY CASE WHEN n = 0 THEN 'missing:' WHEN u1 <> u2 THEN 'mixed_units:' WHEN NOT ok THEN 'violated:' END || constraint_id), '') AS reasons FROM s GROUP BY 1""")
def hard_constraints(t):
    everyone = t.part.select(F.col("p_partkey").alias("candidate_id"))
    out = E.hard_constraints(t.b_property, t.spark.sql(LIMITS), "candidate_id", everyone)
    return out.select("candidate_id", S.joined(F.col("reasons")).alias("reasons"))


@query("""SELECT label, CAST(position - 1 AS INT) AS position, floor(avg(CAST(x AS DOUBLE)) * 10000 + 0.5) / 10000 AS mean, count(*) AS n FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS position FROM {embeddings}) GROUP BY 1, 2""")
def mean_vector(t):
    return E.mean_vector(t.embeddings, "label", "embedding").withColumn("mean", S.rounded(F.col("mean")))


@query("""SELECT p_partkey, d AS direction, CASE WHEN v < 5 OR v > 45 THEN NULL WHEN d = 'maximize' THEN v WHEN d = 'minimize' THEN -v WHEN d = 'target' THEN -abs(v - 25.0) ELSE 1.0 END AS selector,
CASE WHEN v < 5 OR v > 45 THEN 'bound_violated' END AS reason,
CASE d WHEN 'maximize' THEN v WHEN 'minimize' THEN -v WHEN 'target' THEN -abs(v - 25.0) WHEN 'range' THEN -greatest(5 - v, v - 45, 0.0) END AS raw,
CASE d WHEN 'maximize' THEN v WHEN 'minimize' THEN -v WHEN 'target' THEN -abs(v - 25.0) WHEN 'range' THEN CASE WHEN v BETWEEN 5 AND 45 THEN 1.0 ELSE -least(abs(v - 5), abs(v - 45)) END ELSE CASE WHEN v BETWEEN 5 AND 45 AND v = 25 THEN 1.0 ELSE 0.0 END END AS controller
FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS v, ['maximize', 'minimize', 'target', 'range', 'satisfy'][CAST(p_partkey % 5 AS INT) + 1] AS d FROM {part})""")
def utilities(t):
    rows = t.part.select("p_partkey", F.col("p_size").cast("double").alias("v"), F.get(F.array(*map(F.lit, ("maximize", "minimize", "target", "range", "satisfy"))), (F.col("p_partkey") % 5).cast("int")).alias("direction"))
    given = (F.col("v"), F.col("direction"), F.lit(25.0), F.lit(5.0), F.lit(45.0))
    picked = S.selector_utility(*given)
    return rows.select("p_partkey", "direction", picked["utility"].alias("selector"), picked["reason"].alias("reason"), S.goal_utility(*given).alias("raw"), S.controller_utility(*given).alias("controller"))


@query("""WITH a AS (SELECT l_partkey AS candidate_id, floor(avg(l_quantity) * 10000 + 0.5) / 10000 AS again, count(*) AS n FROM {lineitem} GROUP BY 1),
s AS (SELECT candidate_id, CASE WHEN candidate_id % 10 = 3 THEN again + 1 ELSE again END AS stored, n FROM a WHERE candidate_id % 7 <> 0)
SELECT a.candidate_id, CASE WHEN s.candidate_id IS NULL THEN 'missing' WHEN stored = again AND s.n = a.n THEN 'reconciled' ELSE 'mismatch' END AS status FROM a LEFT JOIN s USING (candidate_id)""")
def aggregate_reconcile(t):
    again = t.lineitem.groupBy(F.col("l_partkey").alias("candidate_id")).agg(S.rounded(F.avg("l_quantity")).alias("again"), F.count("*").alias("n"))
    stored = again.where("candidate_id % 7 <> 0").select("candidate_id", F.expr("if(candidate_id % 10 = 3, again + 1, again)").alias("stored"), F.col("n").alias("m"))
    status = F.when(F.col("m").isNull(), "missing").when((F.col("stored") == F.col("again")) & (F.col("m") == F.col("n")), "reconciled").otherwise("mismatch")
    return again.join(stored, "candidate_id", "left").select("candidate_id", status.alias("status"))


STATES = """SELECT b.candidate_id, b.expert_id, b.property_name, b.value, b.unit, CASE WHEN f.force >= 0.095 THEN 'partial' ELSE 'success' END AS status
FROM {b_property} b JOIN (SELECT candidate_id, expert_id, max(max_force) AS force FROM {b_prediction} GROUP BY 1, 2) f ON f.candidate_id = b.candidate_id AND f.expert_id = b.expert_id"""


@query(f"""WITH s AS ({STATES}), good AS (SELECT * FROM s WHERE status = 'success'), util AS (SELECT candidate_id, min(CASE WHEN property_name = 'max_force' THEN -abs(value - 0.05)
  WHEN property_name = 'stress' THEN CASE WHEN value BETWEEN 0.02 AND 0.06 THEN 1.0 ELSE -least(abs(value - 0.02), abs(value - 0.06)) END END) AS worst FROM good GROUP BY 1),
d AS (SELECT candidate_id, max(CASE WHEN e >= 2 AND u1 = u2 THEN least(1.0, (hi - lo) / greatest(abs(hi), abs(lo), 1e-12)) ELSE 0 END) AS dis FROM (
  SELECT candidate_id, property_name, min(value) lo, max(value) hi, count(DISTINCT expert_id) e, min(unit) u1, max(unit) u2 FROM good WHERE property_name <> 'energy' GROUP BY 1, 2) GROUP BY 1),
x AS (SELECT candidate_id, expert_id, bool_or(status = 'success') AS ok FROM s GROUP BY 1, 2),
n AS (SELECT p_partkey AS candidate_id, count(CASE WHEN ok THEN 1 END) AS good, count(CASE WHEN NOT coalesce(ok, false) THEN 1 END) AS bad, count(ok) AS seen
  FROM (SELECT p_partkey, unnest(CASE WHEN p_size > 40 THEN ['e0', 'e1', 'e9'] ELSE ['e0', 'e1'] END) AS expert_id FROM {{part}}) a LEFT JOIN x ON x.candidate_id = a.p_partkey AND x.expert_id = a.expert_id GROUP BY 1)
SELECT candidate_id, CASE WHEN seen > 0 THEN CAST(p_size AS DOUBLE) END AS cycle, CASE WHEN seen > 0 THEN CAST(good AS DOUBLE) END AS n_successful, CASE WHEN seen > 0 THEN CAST(bad AS DOUBLE) END AS n_unsuccessful,
  CASE WHEN seen > 0 THEN floor(coalesce(worst, 0) * 10000 + 0.5) / 10000 END AS worst_utility, CASE WHEN seen > 0 THEN floor(coalesce(dis, 0) * 10000 + 0.5) / 10000 END AS disagreement,
  CASE WHEN seen > 0 THEN CASE WHEN p_retailprice > 1000 THEN 1.0 ELSE 0.0 END END AS improved, CASE WHEN seen > 0 THEN p_size / 50.0 END AS collapse_rate, CASE WHEN seen > 0 THEN 0.5 END AS alpha,
  CASE WHEN seen = 0 THEN 'no_primary_feature' END AS reason
FROM n JOIN {{part}} ON p_partkey = candidate_id LEFT JOIN util USING (candidate_id) LEFT JOIN d USING (candidate_id)""")
def control_vector(t):
    """All eight control values of parts; predictions with large forces are partial, and large parts await a third expert."""
    s = t.spark.sql(STATES, b_property=t.b_property, b_prediction=t.b_prediction)
    is_force = F.col("property_name") == "max_force"
    worth = S.controller_utility(F.col("value"), F.when(is_force, "target").otherwise("range"), F.lit(0.05), F.lit(0.02), F.lit(0.06))
    features = s.withColumn("utility", F.when(F.col("property_name") != "energy", worth))
    expected = F.when(F.col("p_size") > 40, F.array(*map(F.lit, ("e0", "e1", "e9")))).otherwise(F.array(F.lit("e0"), F.lit("e1")))
    requests = t.part.select(F.col("p_partkey").alias("candidate_id"), F.col("p_size").alias("cycle"), expected.alias("expected"), F.lit(None).cast("array<string>").alias("failed"),
                             (F.col("p_retailprice") - 1000).alias("previous_improvement"), (F.col("p_size") / 50.0).alias("collapse_rate"), F.lit(0.5).alias("alpha"))
    spread = E.expert_disagreement(s.where("status = 'success'"), "candidate_id", exclude=("energy",))
    out = E.control_vector(requests, features, "utility", spread)
    return out.withColumns({c: S.rounded(F.col(c)) for c in ("worst_utility", "disagreement")})
