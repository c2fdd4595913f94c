"""Routing, permission and rounds over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import rules as R
from assaylake.functions import scalars as S
from assaylake.operators import routing as O
from assaylake.plans.claims import case
from assaylake.plans.registry import query


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'battery' END AS explicit, CASE o_orderkey % 3 WHEN 0 THEN 'battery' WHEN 1 THEN 'catalysis' ELSE 'general_inorganic' END AS tf,
  CASE o_orderkey % 3 WHEN 2 THEN 'auto-default' ELSE CASE WHEN o_custkey % 5 = 0 THEN 'auto-ambiguous' ELSE 'auto-keyword' END END AS tm,
  CASE WHEN o_custkey % 4 < 3 THEN CASE WHEN o_custkey % 4 = 0 THEN 'battery' ELSE 'catalysis' END END AS mf, CASE WHEN o_custkey % 7 > 0 THEN 0.5 + (o_custkey % 7) / 14.0 END AS mc, o_custkey % 13 = 0 AS nc FROM {orders}),
m AS (SELECT *, CASE WHEN explicit IS NOT NULL THEN 'explicit' WHEN mc IS NULL THEN tm WHEN nc OR mf IS NULL OR mc < 0.7 THEN 'auto-model-conflict' WHEN tm <> 'auto-keyword' THEN 'auto-model' WHEN tf = mf THEN 'auto-consensus' ELSE 'auto-model-conflict' END AS mode FROM r)
SELECT o_orderkey, mode, CASE mode WHEN 'explicit' THEN explicit WHEN 'auto-model-conflict' THEN 'general_inorganic' WHEN 'auto-model' THEN mf WHEN 'auto-consensus' THEN mf ELSE tf END AS field,
       CASE mode WHEN 'explicit' THEN 'high' WHEN 'auto-model-conflict' THEN 'low' WHEN 'auto-model' THEN CASE WHEN mc >= 0.85 THEN 'high' ELSE 'medium' END WHEN 'auto-consensus' THEN CASE WHEN mc >= 0.85 THEN 'high' ELSE 'medium' END END AS confidence,
       mode IN ('auto-model-conflict', 'auto-ambiguous') AS requires_choice FROM m""")
def field_resolution(t):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = t.orders.select(
        "o_orderkey",
        F.when(key % 11 == 0, "battery").alias("explicit"),
        case("o_orderkey", 3, "battery", "catalysis", "general_inorganic").alias("term_field"),
        F.when(key % 3 == 2, "auto-default").when(cust % 5 == 0, "auto-ambiguous").otherwise("auto-keyword").alias("term_mode"),
        F.when(cust % 4 == 0, "battery").when(cust % 4 < 3, "catalysis").alias("model_field"),
        F.when(cust % 7 > 0, 0.5 + (cust % 7) / 14.0).alias("model_confidence"),
        (cust % 13 == 0).alias("needs_clarification"),
    )
    return O.resolve_field(rows).select("o_orderkey", "mode", "field", "confidence", "requires_choice")


ROLES = [("legal", ["mit license", "apache"], False, ["country"]), ("contact", ["all rights"], False, ["email", "name"]), ("other", ["zzz"], True, [])]


@query(r"""WITH q AS (SELECT doc_id, lower(text) AS t, doc_id % 10 AS k FROM {documents}),
h AS (SELECT doc_id, k, regexp_matches(t, '(^|[^a-z0-9])(mit license|apache)([^a-z0-9]|$)') AS legal, regexp_matches(t, '(^|[^a-z0-9])all rights([^a-z0-9]|$)') AS contact FROM q),
r AS (SELECT doc_id, k, CASE WHEN k = 0 THEN 'explicit' WHEN k = 1 THEN 'model' WHEN coalesce(legal OR contact, false) THEN 'alias' ELSE 'subtype' END AS origin, coalesce(legal, false) AS legal, coalesce(contact, false) AS contact FROM h),
p AS (SELECT doc_id, k, origin, unnest(CASE origin WHEN 'explicit' THEN ['contact'] WHEN 'model' THEN ['legal', 'other'] WHEN 'alias' THEN list_filter([CASE WHEN legal THEN 'legal' END, CASE WHEN contact THEN 'contact' END], lambda x: x IS NOT NULL) ELSE ['other'] END) AS role_id FROM r)
SELECT doc_id AS question_id, role_id, origin, CASE role_id WHEN 'legal' THEN 'country' WHEN 'contact' THEN CASE WHEN k % 2 = 0 THEN 'name' ELSE 'email,name' END ELSE '' END AS missing_context FROM p""")
def role_match(t):
    roles = t.spark.createDataFrame(ROLES, "role_id string, aliases array<string>, subtype boolean, required array<string>")
    none = F.array().cast("array<string>")
    asked = t.documents.select(
        F.col("doc_id").alias("question_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.when(F.col("doc_id") % 10 == 0, F.array(F.lit("contact"))).otherwise(none).alias("explicit"),
        F.when(F.col("doc_id") % 10 < 2, F.array(F.lit("legal"), F.lit("other"))).otherwise(none).alias("model"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("email"))).otherwise(none).alias("context"),
    )
    return O.match_roles(asked, roles).withColumn("missing_context", F.array_join("missing_context", ","))


@query("""WITH k AS (SELECT p_partkey, p_type, unnest(CASE p_partkey % 3 WHEN 0 THEN ['cif', 'formula'] WHEN 1 THEN ['smiles'] ELSE ['formula'] END) AS kind FROM {part}),
r AS (SELECT s_suppkey, 'm' || CAST(s_suppkey % 2 AS VARCHAR) AS modality, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CASE WHEN s_suppkey % 3 = 1 THEN 'ECONOMY' ELSE 'STANDARD' END END AS type, unnest(CASE s_suppkey % 4 WHEN 0 THEN ['cif'] WHEN 1 THEN ['smiles', 'cif'] WHEN 2 THEN ['formula', 'cif'] ELSE ['fasta'] END) AS kind FROM {supplier})
SELECT DISTINCT p_partkey AS candidate_id, s_suppkey AS expert_id, modality, 'space' || modality AS feature_space FROM k JOIN r USING (kind) WHERE type IS NULL OR type = p_type""")
def expert_routes(t):
    candidates = t.part.select(F.col("p_partkey").alias("candidate_id"), F.col("p_type").alias("candidate_type"), case("p_partkey", 3, ["cif", "formula"], ["smiles"], ["formula"]).alias("kinds"))
    modality = F.concat(F.lit("m"), (F.col("s_suppkey") % 2).cast("string"))
    types = F.when(F.col("s_suppkey") % 3 == 0, F.array().cast("array<string>")).when(F.col("s_suppkey") % 3 == 1, F.array(F.lit("ECONOMY"))).otherwise(F.array(F.lit("STANDARD")))
    routes = t.supplier.select(F.col("s_suppkey").alias("expert_id"), modality.alias("modality"), F.concat(F.lit("space"), modality).alias("feature_space"), types.alias("types"), case("s_suppkey", 4, ["cif"], ["smiles", "cif"], ["formula", "cif"], ["fasta"]).alias("kinds"))
    return O.expert_routes(candidates, routes)


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'field_choice_pending' END, CASE WHEN o_orderkey % 7 = 0 THEN 'clarification_required' END,
  CASE WHEN o_orderkey % 3 = 0 THEN 'missing_context:use' END, CASE o_orderkey % 4 WHEN 0 THEN 'missing_conditions:pressure,time' WHEN 1 THEN 'missing_conditions:time' END], lambda x: x IS NOT NULL), ';') AS blockers FROM {orders}""")
def comparison_blockers(t):
    none = F.array().cast("array<string>")
    pressure = F.when(F.col("o_orderkey") % 4 == 0, " ").otherwise("1 GPa")
    time = F.when(F.col("o_orderkey") % 4 >= 2, "2 h")
    rows = t.orders.select(
        "o_orderkey", (F.col("o_orderkey") % 5 == 0).alias("requires_choice"),
        F.when(F.col("o_orderkey") % 7 == 0, "needs-clarification").otherwise("roles").alias("mode"),
        F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("use"))).otherwise(none).alias("missing_context"),
        F.array(*map(F.lit, ("temperature", "pressure", "time", "pressure"))).alias("required_conditions"),
        F.create_map(F.lit("temperature"), F.lit("300"), F.lit("pressure"), pressure, F.lit("time"), time).alias("target"),
    )
    return O.comparison_blockers(rows).select("o_orderkey", S.joined(F.col("blockers")).alias("blockers"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'verified' WHEN 1 THEN 'differs_from_input' WHEN 2 THEN 'key_not_allowed' WHEN 3 THEN 'verified' WHEN 4 THEN 'not_in_question' ELSE 'verified' END AS verdict FROM {orders}""")
def extracted_context(t):
    rows = t.orders.select(
        "o_orderkey", F.concat(F.lit("Which at 1300 K, "), F.col("o_orderpriority"), F.lit("?")).alias("question"),
        case("o_orderkey", 6, "x", "x", "1300", "1300.0", "300", "").alias("_v"), F.col("o_orderpriority").alias("_p"),
        case("o_orderkey", 6, "x", "y", "", "").alias("_g"), (F.col("o_orderkey") % 6 != 2).alias("allowed"),
    )
    rows = rows.withColumn("value", F.when(F.col("_v") == "", F.lower("_p")).otherwise(F.col("_v"))).withColumn("given", F.when(F.col("_g") != "", F.col("_g")))
    return O.extracted_context(rows).select("o_orderkey", "verdict")


REASONS = """list_filter([CASE WHEN k = 1 AND f <> 'other' THEN 'condition_missing' END, CASE WHEN k = 2 THEN 'convergence_missing' END, CASE WHEN k = 3 THEN 'exit_code' END,
  CASE WHEN f = 'other' THEN NULL WHEN l_discount > 0.05 THEN 'gate_not_passed' END, CASE WHEN k = 4 AND f <> 'other' THEN 'method' END, CASE WHEN f = 'other' THEN 'no_policy' END,
  CASE WHEN l_linestatus = 'O' AND k = 5 THEN 'not_completed' END, CASE WHEN k = 6 THEN 'output_missing' END, CASE WHEN k = 7 AND f <> 'other' THEN 'unit' END], lambda x: x IS NOT NULL)"""
RECEIPTS = """r AS (SELECT *, (l_orderkey + l_linenumber) % 11 AS k, CASE WHEN l_returnflag = 'R' THEN 'other' ELSE 'battery' END AS f FROM {lineitem})"""


def receipts(t):
    rows = t.lineitem.withColumn("k", (F.col("l_orderkey") + F.col("l_linenumber")) % 11)
    none = F.array().cast("array<string>")
    rows = rows.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(F.col("l_extendedprice") * 100 + 0.5)).alias("receipt_id"), "l_partkey", "l_quantity", "l_discount", "k", "l_returnflag",
        F.when(F.col("l_returnflag") == "R", "other").otherwise("battery").alias("field"), F.lit("capacity").alias("property_name"), F.lit("cycler").alias("validator_id"), F.lit("v2").alias("policy_version"),
        F.when(F.col("k") == 7, "Ah").otherwise("mAh/g").alias("unit"), F.when(F.col("k") == 4, "guess").otherwise("galvanostatic").alias("method_id"),
        F.when(F.col("k") == 1, none).otherwise(F.array(F.lit("temperature"))).alias("condition_keys"),
        F.when((F.col("l_linestatus") == "O") & (F.col("k") == 5), "running").otherwise("completed").alias("execution_status"),
        F.when(F.col("k") == 3, 1).otherwise(0).alias("exit_code"), F.lit("success").alias("parser_status"), F.lit(True).alias("qc_passed"), F.lit(1).alias("n_outputs"),
        F.when(F.col("k") == 2, 0).otherwise(1).alias("n_convergence"), F.when(F.col("k") != 6, F.sha2(F.col("l_orderkey").cast("string"), 256)).alias("output_sha256"),
    )
    gate = lambda name, status: F.struct(F.lit(name).alias("gate"), status.alias("status"))
    gates = rows.select("receipt_id", F.explode(F.array(gate("baseline", F.lit("passed")), gate("drift", F.when(F.col("l_discount") > 0.05, "failed").otherwise("passed")))).alias("g")).select("receipt_id", "g.*")
    policies = t.spark.createDataFrame([("battery", "capacity", "cycler", "v2", "mAh/g", ["galvanostatic"], ["temperature"], ["baseline", "drift"])], "field string, property_name string, validator_id string, policy_version string, unit string, methods array<string>, required_conditions array<string>, required_gates array<string>")
    return rows, O.usable_receipts(rows, policies, gates)


@query(f"""WITH {RECEIPTS} SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS receipt_id, array_to_string({REASONS}, ';') AS reasons, len({REASONS}) = 0 AS usable FROM r""")
def usable_receipts(t):
    return receipts(t)[1].withColumn("reasons", S.joined(F.col("reasons")))


@query(f"""WITH {RECEIPTS}, o AS (SELECT l_partkey, l_quantity, f, len({REASONS}) = 0 AND l_orderkey % 9 <> 0 AS ok FROM r)
SELECT l_partkey AS candidate_id, count(CASE WHEN ok THEN 1 END) AS n_accepted, count(CASE WHEN NOT ok THEN 1 END) AS n_rejected,
       CASE WHEN count(CASE WHEN ok THEN 1 END) = 0 THEN 'unknown' WHEN count(DISTINCT CASE WHEN ok THEN l_quantity END) > 1 THEN 'conflicting' ELSE 'available' END AS status,
       CASE WHEN count(DISTINCT CASE WHEN ok THEN l_quantity END) = 1 THEN CAST(min(CASE WHEN ok THEN l_quantity END) AS DOUBLE) END AS value FROM o WHERE f = 'battery' GROUP BY 1""")
def field_results(t):
    rows, usable = receipts(t)
    observations = rows.select("receipt_id", F.col("l_partkey").alias("candidate_id"), "field", "property_name", "validator_id", "unit", (F.split("receipt_id", ":")[0].cast("long") % 9 != 0).alias("conditions_match"), F.col("l_quantity").cast("double").alias("value"))
    profiles = t.spark.createDataFrame([("battery", "capacity", ["cycler"], "mAh/g")], "field string, property_name string, validators array<string>, unit string")
    return O.field_results(observations, usable, profiles).select("candidate_id", "n_accepted", "n_rejected", "status", "value")


@query("""WITH b AS (SELECT o_orderkey, o_custkey, o_orderdate, (SELECT count(*) FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey) AS n FROM {orders} o),
c AS (SELECT l_orderkey, bool_or(l_discount > 0.09) AS stale, bool_or(l_linenumber = 2 AND l_orderkey % 4 = 0) AS uncited, bool_or(l_returnflag = 'R') AS typed, bool_or(l_partkey = l_orderkey) AS self FROM {lineitem} GROUP BY 1)
SELECT o_orderkey AS batch_id, array_to_string(list_filter([CASE WHEN n <> 4 THEN 'count_differs' END, CASE WHEN stale THEN 'hash_stale' END, CASE WHEN uncited THEN 'parent_not_cited' END,
  CASE WHEN o_orderkey % 10 = 0 THEN 'provenance_differs' END, CASE WHEN typed THEN 'type_outside_goal' END, CASE WHEN self THEN 'version_not_advanced' END], lambda x: x IS NOT NULL), ';') AS violations
FROM b LEFT JOIN c ON l_orderkey = o_orderkey""")
def batch_audit(t):
    parents = t.orders.select(F.col("o_orderkey").alias("parent_id"), F.lit(1).alias("version"), F.md5(F.col("o_orderkey").cast("string")).alias("ref_hash"))
    batches = t.orders.select(
        F.col("o_orderkey").alias("batch_id"), F.col("o_orderkey").alias("parent_id"), F.lit(4).alias("wanted"), F.array(F.lit("N"), F.lit("A")).alias("types"), F.lit("m").alias("domain"),
        F.lit("g:1:7").alias("config"), F.when(F.col("o_orderkey") % 10 == 0, "g:1:8").otherwise("g:1:7").alias("provenance"),
    )
    ref = F.md5(F.col("l_orderkey").cast("string"))
    children = t.lineitem.select(
        F.col("l_orderkey").alias("batch_id"), F.col("l_partkey").alias("candidate_id"), F.lit(1).alias("version"), F.lit("h").alias("content_hash"), F.when(F.col("l_discount") > 0.09, "old").otherwise("h").alias("stated_hash"),
        F.when((F.col("l_linenumber") == 2) & (F.col("l_orderkey") % 4 == 0), F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), ref)).alias("cites"), F.array(F.col("l_orderkey")).alias("parent_ids"),
        F.col("l_returnflag").alias("candidate_type"), F.lit("m").alias("domain"),
    )
    return O.batch_violations(batches, children, parents).withColumn("violations", S.joined(F.col("violations")))


@query("""WITH c AS (SELECT l_partkey, count(*) AS n_checks, last(CAST(l_quantity AS DOUBLE) ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_suppkey) FILTER (l_linenumber <> 3) AS effect FROM {lineitem} WHERE l_partkey % 5 <> 0 GROUP BY 1)
SELECT p_partkey AS candidate_id, coalesce(n_checks, 0) AS n_checks, floor(coalesce(abs(p_size - effect), 0.5) * 10000 + 0.5) / 10000 AS disagreement FROM {part} LEFT JOIN c ON l_partkey = p_partkey""")
def cross_checks(t):
    rows = t.part.select(F.col("p_partkey").alias("candidate_id"), F.col("p_size").cast("double").alias("expression_change"), F.lit(0.5).alias("disagreement"))
    effect = F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("double"))
    checks = t.lineitem.where("l_partkey % 5 <> 0").select(F.col("l_partkey").alias("candidate_id"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey").alias("position"), effect.alias("effect"))
    return O.cross_checks(rows, checks).select("candidate_id", "n_checks", S.rounded(F.col("disagreement")).alias("disagreement"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber = 1 AS own, l_returnflag = 'R' AS failed, CASE WHEN l_linenumber = 1 OR l_discount > 0.03 THEN 'p' END AS name, CAST(l_quantity AS DOUBLE) AS v FROM {lineitem}),
u AS (SELECT l_orderkey, bool_or(NOT own) AS mixed, avg(v) FILTER (own) AS mean FROM f WHERE NOT failed AND name IS NOT NULL GROUP BY 1)
SELECT o_orderkey AS snapshot_id, 'p' AS property_name, CASE WHEN coalesce(mixed, false) THEN mean ELSE CAST(o_totalprice AS DOUBLE) END AS value, coalesce(mixed, false) AS recomputed
FROM {orders} LEFT JOIN u ON l_orderkey = o_orderkey WHERE NOT coalesce(mixed, false) OR mean IS NOT NULL""")
def primary_properties(t):
    own = F.col("l_linenumber") == 1
    features = t.lineitem.select(F.col("l_orderkey").alias("snapshot_id"), own.alias("is_primary"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("success").alias("status"), F.when(own | (F.col("l_discount") > 0.03), "p").alias("property_name"), F.col("l_quantity").cast("double").alias("value"))
    stored = t.orders.select(F.col("o_orderkey").alias("snapshot_id"), F.lit("p").alias("property_name"), F.col("o_totalprice").cast("double").alias("value"))
    return O.primary_properties(features, stored, ["snapshot_id"])


def _replayed(k: int, last: int) -> str:
    """SQL that takes round after round, each without what its branch took before."""
    taken = lambda n: " UNION ALL ".join(f"SELECT branch, candidate_id FROM take{i}" for i in range(n)) or "SELECT branch, candidate_id FROM pool WHERE false"
    rounds = [
        f"take{n} AS MATERIALIZED (SELECT {n} AS round, branch, row_number() OVER (PARTITION BY branch ORDER BY score DESC, candidate_id) AS slot, candidate_id FROM pool p "
        f"WHERE round_index <= {n} AND NOT EXISTS (SELECT 1 FROM ({taken(n)}) x WHERE x.branch = p.branch AND x.candidate_id = p.candidate_id) QUALIFY slot <= {k})"
        for n in range(last + 1)
    ]
    return f"""WITH log AS (SELECT p_partkey % 6 AS round_index, p_partkey AS candidate_id, p_size, p_retailprice,
    row_number() OVER (PARTITION BY p_name, p_type, p_size ORDER BY p_partkey % 6, p_partkey) AS n FROM {{part}} WHERE p_partkey % 9 <> 0),
pool AS MATERIALIZED (SELECT round_index, candidate_id, 'target' AS branch, -abs(p_size - 25)::DOUBLE AS score FROM log WHERE n = 1
  UNION ALL SELECT round_index, candidate_id, 'stability', -p_retailprice FROM log WHERE n = 1
  UNION ALL SELECT round_index, candidate_id, 'novelty', p_retailprice FROM log WHERE n = 1 AND p_size > 10),
{", ".join(rounds)}
SELECT CAST(round AS BIGINT) AS round, branch, slot, candidate_id FROM ({" UNION ALL ".join(f"SELECT * FROM take{n}" for n in range(last + 1))})"""


@query(_replayed(8, 5))
def replay_rounds(t):
    """Three branches over the parts as an evaluated log of six rounds; a part's identity is its name and type."""
    log = t.part.select((F.col("p_partkey") % 6).alias("round_index"), F.col("p_partkey").alias("candidate_id"), F.concat_ws("|", "p_name", "p_type", F.col("p_size").cast("string")).alias("identity"), (F.col("p_partkey") % 9 != 0).alias("eligible"), "p_size", "p_retailprice")
    scores = {"target": -F.abs(F.col("p_size") - 25), "stability": -F.col("p_retailprice"), "novelty": F.when(F.col("p_size") > 10, F.col("p_retailprice"))}
    return O.replay_rounds(log, scores, 8, 5)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN p_size / 100.0 ELSE CASE WHEN n = 0 THEN prior WHEN 2 * stable < n THEN 0.0 ELSE coalesce(prior, CASE WHEN p_size >= 25 THEN 0.03 WHEN p_size % 2 = 0 THEN 0.0 ELSE 0.05 END) END END AS target
FROM (SELECT p_partkey, p_size, p_partkey % 4 AS n, p_partkey % 3 AS stable, CASE p_partkey % 7 WHEN 0 THEN 0.0 WHEN 1 THEN 0.08 WHEN 2 THEN 0.05 END AS prior FROM {part})""")
def hull_target(t):
    key, size = F.col("p_partkey"), F.col("p_size")
    branch = case("p_partkey", 7, "stability", "novelty", "pareto", "none")
    target = R.hull_target(F.when(key % 10 == 0, size / 100.0), key % 4, key % 3, size / 100.0, F.when(size % 2 == 0, 0.1), branch)
    return t.part.select("p_partkey", target.alias("target"))


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 1 AND p_partkey % 5 = 0 THEN 'atoms_too_close' END, CASE WHEN p_partkey % 7 = 0 THEN 'occupancy_above_one' END, CASE WHEN p_partkey % 11 = 0 THEN 'volume_not_positive' END,
  CASE WHEN p_partkey % 11 = 0 OR p_partkey % 13 = 0 THEN 'volume_per_atom_out_of_range' END], lambda x: x IS NOT NULL), ';') AS reasons FROM {part}""")
def geometry_gate(t):
    key = F.col("p_partkey")
    volume = F.when(key % 11 == 0, -1.0).when(key % 13 == 0, F.col("p_size") * 0.01).otherwise(F.col("p_size") * 10.0)
    nearest = F.when(key % 10 == 0, 0.3).when(key % 5 != 0, 2.0)
    occupancies = F.array(F.lit(1.0), F.when(key % 7 == 0, 1.2).otherwise(0.5))
    return t.part.select("p_partkey", S.joined(R.geometry_reasons(volume, F.col("p_size"), nearest, occupancies)).alias("reasons"))


@query("""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'not_an_object' WHEN 2 THEN 'other_keys' WHEN 3 THEN 'lengths_differ' WHEN 4 THEN 'duplicate_gene' WHEN 5 THEN 'unknown_semantics' ELSE 'invalid_gene' END AS error,
       CASE WHEN doc_id % 7 = 0 THEN 'TP53=' || CAST(CAST(n_chars AS DECIMAL(20,1)) AS VARCHAR) || ';GAPDH=8.5' END AS rows FROM {documents}""")
def cell_expression(t):
    """A cell's genes and values as JSON, from each document's length; six of seven cases break a rule."""
    genes = case("doc_id", 7, '["TP53", " GAPDH "]', "", '["TP53", "GAPDH"]', '["TP53"]', '["TP53", "TP53 "]', '["TP53", "GAPDH"]', '["TP53", " "]')
    body = F.concat(F.lit('{"genes": '), genes, F.lit(', "values": ['), F.col("n_chars").cast("string"), F.lit('.0, 8.5], "value_semantics": "'), case("doc_id", 7, *["raw_counts"] * 5, "counts", "raw_counts"), F.lit('"'), F.when(F.col("doc_id") % 7 == 2, ', "more": 1}').otherwise("}"))
    read = R.cell_expression(F.when(F.col("doc_id") % 7 == 1, "[1]").otherwise(body))
    rows = t.documents.select("doc_id", read.alias("c"))
    text = F.array_join(F.transform("c.rows", lambda x: F.concat_ws("=", x["gene"], x["value"].cast("decimal(20,1)").cast("string"))), ";")
    return rows.select("doc_id", "c.error", text.alias("rows"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' ELSE 'structural_collapse:overlap' END || CASE WHEN p_partkey % 4 = 2 THEN ';structural_collapse:void' ELSE '' END AS collapse,
       CASE WHEN p_partkey % 3 = 0 THEN 'attested-crystal-hash:' || sha256(CAST(p_partkey AS VARCHAR)) END AS identity,
       p_partkey % 5 <> 0 AS representation_valid, p_partkey % 6 > 1 AS lineage_valid, p_partkey % 7 = 0 AS content_hash_valid FROM {part}""")
def candidate_rules(t):
    key, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    reasons = case("p_partkey", 4, ["expert_failed"], ["structural_collapse:overlap", "structural_collapse:overlap"], ["structural_collapse:void", "out_of_domain", "structural_collapse:overlap"], ["structural_collapse:overlap"])
    digest = F.sha2(text, 256)
    receipt = F.struct(F.when(key % 3 == 1, F.lit("other")).otherwise(digest).alias("digest"), F.when(key % 3 == 2, "other-form").otherwise(R.CANONICAL_FORM).alias("form"))
    parents = F.when(key % 6 == 0, F.array(key)).when(key % 6 == 1, F.array(key + 1, key + 1)).otherwise(F.array(key + 1, key + 2))
    values = F.when(key % 10 == 0, F.array().cast("array<string>")).when(key % 5 == 0, F.array(F.lit("x"), F.lit(" "))).otherwise(F.array(F.lit("x")))
    rules = R.common_rules(key, values, parents, F.when(key % 7 == 0, text).when(key % 7 == 1, F.lit("x")), text)
    return t.part.select("p_partkey", S.joined(R.collapse_reasons(reasons)).alias("collapse"), R.attested_key(digest, F.array(receipt)).alias("identity"), rules.alias("r")).select("p_partkey", "collapse", "identity", "r.*")


SHAPE = "CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END"


@query(f"""SELECT p_partkey, sha256(CAST(to_json(['3', CAST({SHAPE} AS VARCHAR), CASE {SHAPE} WHEN 0 THEN CAST(p_size AS VARCHAR) || ',8,64' WHEN 1 THEN '8,64' ELSE '64' END]) AS VARCHAR)) AS contract FROM {{part}}""")
def shape_contract(t):
    role = case("p_partkey", 4, "pooled", "atom_embedding", "hamiltonian", "global")
    entities = (F.col("p_partkey") % 4 == 0) & (F.col("p_partkey") % 3 == 0)
    return t.part.select("p_partkey", R.shape_contract(role, F.array(F.col("p_size").cast("int"), F.lit(8), F.lit(64)), entities).alias("contract"))


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS grp, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 50 END AS rank, o_totalprice AS c FROM {orders})
SELECT o_orderkey, row_number() OVER (ORDER BY grp NULLS LAST, rank NULLS LAST, c DESC, o_orderkey) AS place FROM r""")
def display_order(t):
    from assaylake.operators.screening import global_rank

    scored = F.col("o_orderkey") % 3 > 0
    rows = t.orders.select("o_orderkey", F.when(scored, F.col("o_orderpriority")).alias("group"), F.when(scored, F.col("o_custkey") % 50).alias("r"), F.col("o_totalprice").alias("c"))
    return global_rank(rows, R.display_order(F.col("group"), F.col("r"), F.col("c"), F.col("o_orderkey")), "place").select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("""SELECT p_partkey, CASE WHEN k = 1 THEN 'no_formula' WHEN k = 2 THEN 'unknown_element' END AS warning, k = 0 AS formula_validity, CASE WHEN k = 0 THEN 3 END AS element_count, CASE WHEN k = 0 THEN CAST(p_size + 3 AS DOUBLE) END AS atom_count,
       CASE WHEN k = 0 THEN 'H,O,Fe' END AS elements FROM (SELECT p_partkey, p_size, p_partkey % 3 AS k FROM {part})""")
def composition_rules(t):
    from assaylake.operators.chemistry import composition_rules

    k = F.col("p_partkey") % 3
    formula = F.when(k == 0, F.concat(F.lit("Fe(OH)"), F.lit("O"), F.col("p_size").cast("string"))).when(k == 2, "Qq2")
    return composition_rules(t.part.withColumn("formula", formula), "p_partkey", "formula")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'key' || CAST(p_size AS VARCHAR) WHEN 1 THEN 'Fe2O3' WHEN 2 THEN 'FeO' ELSE 'NaCl' END AS scope FROM {part}""")
def composition_scope(t):
    from assaylake.operators.chemistry import composition_scope

    k = F.col("p_partkey") % 4
    item = lambda kind, canonical, value: F.struct(F.lit(kind).alias("kind"), F.lit(canonical).alias("canonical"), F.lit(value).alias("value"))
    none = F.array().cast("array<struct<kind:string,canonical:boolean,value:string>>")
    shown = F.when(k <= 2, F.array(item("cif", True, "x"), item("formula", False, "Fe1"), item("formula", True, "Fe O"))).otherwise(none)
    scope = composition_scope(F.when(k == 0, F.concat(F.lit("key "), F.col("p_size").cast("string"))), F.when(k <= 1, "Fe2O3").otherwise(" "), shown, F.array(F.lit("NaCl"), F.lit("KCl")))
    return t.part.select("p_partkey", scope.alias("scope"))
