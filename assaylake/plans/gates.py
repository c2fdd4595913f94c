"""Validation gates, claim ladders and immutable tables over orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import scalars as S
from assaylake.operators import assessment
from assaylake.operators import decision as O
from assaylake.plans.registry import query
from assaylake.sources import contracts

REQ = """req AS (SELECT candidate_id, method_class, count(CASE WHEN meets_criterion THEN 1 END) AS n_for, count(CASE WHEN NOT meets_criterion THEN 1 END) AS n_against, count(DISTINCT CASE WHEN meets_criterion THEN source_id END) AS n_sources
FROM {b_evidence_record} WHERE status IN ('success', 'partial') GROUP BY 1, 2),
dec AS (SELECT *, CASE WHEN n_for > 0 AND n_against > 0 THEN 'conflict' WHEN n_for >= 1 AND n_sources >= 1 THEN 'passed' WHEN n_against > 0 THEN 'failed' ELSE 'insufficient' END AS decision FROM req)"""
LEVEL = "CAST(substr(method_class, 1, 1) AS BIGINT)"


def requirements(t):
    usable = t.b_evidence_record.where(F.col("status").isin("success", "partial"))
    return O.requirement_decision(usable, ["candidate_id", "method_class"], "meets_criterion", "source_id", 1, 1)


@query(f"WITH {REQ} SELECT candidate_id, method_class, n_for, n_against, n_sources, decision FROM dec")
def requirement_decision(t):
    return requirements(t)


@query(f"WITH {REQ} SELECT candidate_id, CASE WHEN bool_or(decision IN ('conflict', 'insufficient')) THEN 'insufficient' WHEN bool_or(decision = 'failed') THEN 'failed' ELSE 'passed' END AS gate FROM dec GROUP BY 1")
def gate_decision(t):
    return O.gate_decision(requirements(t), ["candidate_id"])


@query(f"""WITH {REQ}, g AS (SELECT candidate_id, {LEVEL} AS level, CASE decision WHEN 'conflict' THEN 'insufficient' ELSE decision END AS gate FROM dec),
u AS (SELECT *, min(CASE WHEN gate = 'passed' THEN 1 ELSE 0 END) OVER (PARTITION BY candidate_id ORDER BY level ROWS UNBOUNDED PRECEDING) AS ok FROM g)
SELECT candidate_id, coalesce(max(CASE WHEN ok = 1 THEN level END), 0) AS claim_level, CASE WHEN bool_or(gate = 'failed') THEN 'rejected' WHEN coalesce(max(CASE WHEN ok = 1 THEN level END), 0) > 0 THEN 'supported' ELSE 'unproven' END AS status FROM u GROUP BY 1""")
def claim_ladder(t):
    gates = O.gate_decision(requirements(t).withColumn("level", F.substring("method_class", 1, 1).cast("long")), ["candidate_id", "level"])
    return O.claim_ladder(gates, "candidate_id")


@query("""SELECT e.l_orderkey, e.l_linenumber, e.l_partkey, CASE WHEN o.o_orderkey IS NULL THEN 'unknown_candidate' WHEN version <> o.o_custkey % 3 THEN 'stale_version' ELSE 'ok' END AS status
FROM (SELECT l_orderkey + CASE WHEN l_partkey % 101 = 0 THEN 100000000 ELSE 0 END AS ref, l_orderkey, l_linenumber, l_partkey, l_suppkey % 3 AS version FROM {lineitem}) e LEFT JOIN {orders} o ON o.o_orderkey = ref""")
def fk_audit(t):
    ref = F.col("l_orderkey") + F.when(F.col("l_partkey") % 101 == 0, 100000000).otherwise(0)
    rows = t.lineitem.select(ref.alias("ref"), "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 3).alias("version"))
    known = t.orders.select(F.col("o_orderkey").alias("ref"), (F.col("o_custkey") % 3).alias("current"))
    out = rows.join(known, "ref", "left")
    status = F.when(F.col("current").isNull(), "unknown_candidate").when(F.col("version") != F.col("current"), "stale_version").otherwise("ok")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", status.alias("status"))


@query("""SELECT c.c_custkey AS child, CASE WHEN max(CASE WHEN p.c_custkey IS NULL THEN 1 ELSE 0 END) = 1 THEN 'missing_parent' WHEN c.c_custkey % 9 <= max(p.c_custkey % 9) THEN 'version_not_advanced' ELSE 'ok' END AS status
FROM (SELECT c_custkey, unnest([c_custkey - 1, c_custkey * 2]) AS parent FROM {customer}) c LEFT JOIN {customer} p ON p.c_custkey = parent GROUP BY c.c_custkey""")
def lineage_audit(t):
    links = t.customer.select(F.col("c_custkey").alias("child"), F.explode(F.array(F.col("c_custkey") - 1, F.col("c_custkey") * 2)).alias("parent"))
    known = t.customer.select(F.col("c_custkey").alias("parent"), (F.col("c_custkey") % 9).alias("version"))
    out = links.join(known, "parent", "left").groupBy("child").agg(F.max(F.col("version").isNull().cast("int")).alias("missing"), F.max("version").alias("latest"))
    status = F.when(F.col("missing") == 1, "missing_parent").when(F.col("child") % 9 <= F.col("latest"), "version_not_advanced").otherwise("ok")
    return out.select("child", status.alias("status"))


@query("""WITH old AS (SELECT o_orderkey, md5(CAST(o_custkey AS VARCHAR)) AS digest FROM {orders} WHERE o_orderkey % 3 <> 0), inc AS (SELECT o_orderkey, md5(CAST(o_custkey + CASE WHEN o_orderkey % 10 = 1 THEN 1 ELSE 0 END AS VARCHAR)) AS digest FROM {orders} WHERE o_orderkey % 2 = 1 UNION ALL SELECT o_orderkey, 'again' FROM {orders} WHERE o_orderkey % 21 = 0 AND o_orderkey % 2 = 1)
SELECT i.o_orderkey, CASE WHEN lo <> hi THEN 'conflict' WHEN old.digest IS NULL THEN 'insert' WHEN old.digest = lo THEN 'unchanged' ELSE 'conflict' END AS outcome FROM (SELECT o_orderkey, min(digest) AS lo, max(digest) AS hi FROM inc GROUP BY 1) i LEFT JOIN old USING (o_orderkey)""")
def immutable_upsert(t):
    digest = lambda x: F.md5(x.cast("string")).alias("digest")
    old = t.orders.where("o_orderkey % 3 <> 0").select("o_orderkey", digest(F.col("o_custkey")))
    new = t.orders.where("o_orderkey % 2 = 1").select("o_orderkey", digest(F.col("o_custkey") + F.when(F.col("o_orderkey") % 10 == 1, 1).otherwise(0)))
    again = t.orders.where("o_orderkey % 21 = 0 and o_orderkey % 2 = 1").select("o_orderkey", F.lit("again").alias("digest"))
    return contracts.immutable_upsert(old, new.unionByName(again), "o_orderkey", "digest")


@query("""SELECT r.l_orderkey, r.l_linenumber, r.l_partkey, c.o_totalprice AS cached, c.o_orderkey IS NOT NULL AS hit FROM (SELECT l_orderkey, l_linenumber, l_partkey FROM {lineitem} WHERE l_returnflag = 'R') r LEFT JOIN (SELECT * FROM {orders} WHERE o_orderstatus = 'F') c ON c.o_orderkey = r.l_orderkey""")
def cache_antijoin(t):
    asked = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_partkey")
    cache = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("cached"))
    hits, misses = contracts.cache_split(asked, cache, "key")
    both = hits.withColumn("hit", F.lit(True)).unionByName(misses.withColumn("hit", F.lit(False)), allowMissingColumns=True)
    return both.withColumnRenamed("key", "l_orderkey")


@query("SELECT count(DISTINCT user_id) AS candidates, count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS experimental, count(CASE WHEN event_type = 'error' THEN 1 END) AS failed_calls, CAST(date_trunc('day', ts) AS VARCHAR)[1:10] AS day FROM {events} GROUP BY 4")
def history_summary(t):
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.countDistinct("user_id").alias("candidates"), F.countDistinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("experimental"), F.count_if(F.col("event_type") == "error").alias("failed_calls"))


@query("""WITH p AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 3 > 0 THEN year(o_orderdate) * 12 + month(o_orderdate) END AS plan FROM {orders}), m AS (SELECT o_custkey, max(plan) AS last FROM p GROUP BY 1)
SELECT o_orderkey, o_custkey FROM p JOIN m USING (o_custkey) WHERE last IS NULL OR plan = last""")
def latest_plan(t):
    """Orders of each customer's latest plan; a customer without a plan has all of them."""
    plan = F.when(F.col("o_custkey") % 3 > 0, F.year("o_orderdate") * 12 + F.month("o_orderdate"))
    return contracts.latest_plan(t.orders.select("o_orderkey", "o_custkey", plan.alias("plan")), ["o_custkey"], "plan").drop("plan")


@query("SELECT p_partkey, expert_id, coalesce(status, 'failed') AS status FROM (SELECT p_partkey, unnest(['e0', 'e1']) AS expert_id FROM {part}) r LEFT JOIN (SELECT candidate_id, expert_id, 'success' AS status FROM {b_prediction}) s ON s.candidate_id = p_partkey AND s.expert_id = r.expert_id".replace("SELECT p_partkey, expert_id", "SELECT p_partkey, r.expert_id"))
def normalised_rows(t):
    asked = t.part.select("p_partkey", F.explode(F.array(F.lit("e0"), F.lit("e1"))).alias("expert_id"))
    got = t.b_prediction.select(F.col("candidate_id").alias("p_partkey"), "expert_id", F.lit("success").alias("status"))
    return asked.join(got, ["p_partkey", "expert_id"], "left").select("p_partkey", "expert_id", F.coalesce("status", F.lit("failed")).alias("status"))


@query("""WITH r AS (SELECT source, lang IN ('en', 'fr') AND n_chars >= 50 AND (n_chars < 400 OR doc_id % 2 = 0) AND source <> 'src3' AS ok FROM {documents})
SELECT source, count(CASE WHEN ok THEN 1 END) AS n_valid, count(CASE WHEN NOT coalesce(ok, false) THEN 1 END) AS n_invalid FROM r GROUP BY 1""")
def structured_evidence(t):
    """Documents as evidence rows under a contract for each source but src3: two record types, three fields."""
    filled = F.array_compact(F.array(F.lit("title"), F.when(F.col("n_chars") >= 50, "abstract"), F.when((F.col("n_chars") < 400) | (F.col("doc_id") % 2 == 0), "provenance")))
    rows = t.documents.select("source", F.col("lang").alias("record_type"), filled.alias("keys"))
    terms = t.documents.select("source").distinct().where("source <> 'src3'")
    terms = terms.withColumn("allowed_types", F.array(F.lit("en"), F.lit("fr"))).withColumn("required", F.array(F.lit("abstract"), F.lit("provenance")))
    return contracts.structured_evidence(rows, terms)[1]


@query("""SELECT 'claims' AS "table", count(*) AS n_rows FROM {labels} UNION ALL SELECT 'records', count(DISTINCT doc_id % 100000) FROM {documents}""")
def index_manifest(t):
    """An index of records after an upsert of the same records with newer rows, and of claims."""
    old = t.documents.select((F.col("doc_id") % 100000).alias("record_id"), F.col("doc_id").alias("version"))
    index = contracts.upsert_index(old, old.withColumn("version", F.col("version") + 1), "record_id", "version")
    return contracts.index_manifest(records=index, claims=t.labels)


#: Orders as evidence records and their lines as reported properties.
RECORDS = """SELECT o_orderkey AS record_id, CASE WHEN o_totalprice > 5000 THEN o_custkey END AS candidate_id, o_orderpriority AS tool_name,
  CASE WHEN o_orderstatus = 'P' THEN 'experimental' ELSE 'computational' END AS evidence_kind, o_totalprice > 150000 AS verified,
  CASE WHEN o_totalprice > 420000 THEN 'failed' WHEN o_totalprice > 300000 THEN 'partial' ELSE 'success' END AS status,
  CASE WHEN o_orderpriority < '2' THEN 'machine_learning' ELSE 'simulation' END AS method_class,
  CASE WHEN o_orderstatus = 'P' AND o_totalprice > 200000 THEN 'experimental' WHEN year(o_orderdate) < 1996 THEN 'low' WHEN year(o_orderdate) < 1998 THEN 'medium' ELSE 'high' END AS fidelity,
  o_totalprice > 60000 AS energy_ok, o_totalprice < 390000 AS force_ok, month(o_orderdate) AS m FROM {orders}"""
FACTS = f"""rec AS ({RECORDS}), prop AS (SELECT l_orderkey AS record_id,
  bool_or(named AND l_discount > 0.085) AS outside, bool_or(named AND l_returnflag = 'R' AND l_tax > 0.075) AS flagged,
  bool_or(named AND l_tax = 0) AS unsure, bool_or(named AND (l_discount > 0.085 OR l_linestatus <> 'F')) AS uncalibrated
  FROM (SELECT *, p_type IN ('SMALL', 'ECONOMY') AS named FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey) GROUP BY 1),
f AS (SELECT rec.*, coalesce(outside, false) AS outside, coalesce(flagged, false) AS flagged, coalesce(unsure, false) AS unsure, coalesce(uncalibrated, false) AS uncalibrated,
  fidelity IN ('medium', 'high') AS careful, method_class = 'machine_learning' AS learned FROM rec LEFT JOIN prop USING (record_id))"""


@query(f"""WITH {FACTS} SELECT record_id, 'computed' AS requirement_id, array_to_string(list_sort(list_filter([
  CASE WHEN candidate_id IS NULL THEN 'candidate_missing' END, CASE WHEN evidence_kind <> 'computational' THEN 'kind_mismatch' END,
  CASE WHEN status = 'failed' THEN 'status_not_accepted' END, CASE WHEN tool_name = '5-LOW' THEN 'tool_not_allowed' END,
  CASE WHEN careful AND m = 12 THEN 'parameters_hash_missing' END, CASE WHEN careful AND NOT (energy_ok AND force_ok) THEN 'not_converged' END,
  CASE WHEN careful AND m = 11 THEN 'revision_missing' END, CASE WHEN learned AND m <= 2 THEN 'model_metadata_missing' END, CASE WHEN m = 7 THEN 'disqualifying_flag' END,
  CASE WHEN outside THEN 'property_out_of_domain' END, CASE WHEN flagged THEN 'property_flag' END, CASE WHEN careful AND unsure THEN 'property_without_uncertainty' END,
  CASE WHEN learned AND uncalibrated THEN 'property_not_calibrated' END, CASE WHEN fidelity = 'low' THEN 'fidelity_too_low' END], lambda x: x IS NOT NULL)), ';') AS reasons FROM f
UNION ALL SELECT record_id, 'measured', array_to_string(list_sort(list_filter([
  CASE WHEN candidate_id IS NULL THEN 'candidate_missing' END, CASE WHEN evidence_kind <> 'experimental' THEN 'kind_mismatch' END, CASE WHEN NOT verified THEN 'experiment_not_verified' END,
  CASE WHEN status <> 'success' THEN 'status_not_accepted' END, CASE WHEN fidelity <> 'experimental' THEN 'experimental_fidelity_missing' END], lambda x: x IS NOT NULL)), ';') FROM f""")
def evidence_compatibility(t):
    """Orders as records against a computational and an experimental requirement; all reasons of each pair."""
    lines = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    flags = F.when((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.075), F.array(F.lit("OUT_OF_DOMAIN"))).otherwise(F.array(F.lit("checked")))
    one = F.struct(
        F.lower("p_type").alias("name"), (F.col("l_discount") <= 0.085).alias("in_domain"), flags.alias("quality_flags"), F.lit(True).alias("numeric"), F.nullif("l_tax", F.lit(0.0)).alias("uncertainty"),
        F.lit(None).cast("double").alias("low"), F.lit(1.0).alias("high"), F.when(F.col("l_linestatus") == "F", "fit").alias("calibration"),
    )
    properties = lines.select(F.col("l_orderkey").alias("record_id"), one.alias("p")).groupBy("record_id").agg(F.collect_set("p").alias("properties"))  # an order's few lines
    model = F.struct(F.when(F.col("m") != 1, F.lit("net")).alias("name"), F.lit("1").alias("version"), F.when(F.col("m") != 2, F.array(F.lit("d1"))).alias("dataset_versions"), F.lit(True).alias("in_domain"), F.lit("conformal").alias("calibration"))
    made = {
        "gate_id": F.lit("g"), "operation": F.lit("relax"), "parameters_hash": F.when(F.col("m") != 12, "h"), "code_revision": F.when(F.col("m") != 11, "r"), "model": model,
        "convergence": F.create_map(F.lit("energy"), "energy_ok", F.lit("force"), "force_ok"), "quality_flags": F.when(F.col("m") == 7, F.array(F.lit("Unresolved_Conflict"))),
    }
    records = t.spark.sql(RECORDS, orders=t.orders).withColumns(made).join(properties, "record_id", "left")
    tools = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
    wanted = t.spark.createDataFrame([
        ("computed", "g", "computational", ["success", "partial"], tools, None, [], ["Small", "Economy"], "medium"),
        ("measured", "g", "experimental", ["success"], None, ["relax"], None, None, "experimental"),
    ], "requirement_id string, gate_id string, evidence_kind string, statuses array<string>, tools array<string>, operations array<string>, method_classes array<string>, property_names array<string>, minimum_fidelity string")
    return assessment.compatible_evidence(records, wanted).withColumn("reasons", S.joined(F.col("reasons")))
