"""Two-model screening over parts: pairs, relative energies, risk, fronts, crowding, priority, portfolio."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import scalars as S
from assaylake.operators import assessment
from assaylake.operators import screening as O
from assaylake.plans.registry import query
from assaylake.session import materialize

AXES = ["e0_energy", "e1_energy", "e0_force", "e1_force"]
ALIGNED = "CASE WHEN composition_key LIKE '%5' AND candidate_id % 13 = 0 THEN NULL ELSE composition_key END"
REL = f"""rel AS (SELECT *, CASE WHEN pool_size < 2 OR missing > 0 THEN 'unknown' ELSE 'available' END AS status,
  array_to_string(list_filter([CASE WHEN missing > 0 THEN 'energy_pair_alignment_missing' END, CASE WHEN pool_size < 2 THEN 'singleton_composition_pool' END], lambda x: x IS NOT NULL), ';') AS reasons FROM (
  SELECT candidate_id, composition_key, count(*) OVER w AS pool_size, sum(CASE WHEN {ALIGNED} IS NULL THEN 1 ELSE 0 END) OVER w AS missing,
  abs((e0_energy - min(e0_energy) OVER w) - (e1_energy - min(e1_energy) OVER w)) AS d,
  abs(rank() OVER (PARTITION BY composition_key ORDER BY e0_energy) - rank() OVER (PARTITION BY composition_key ORDER BY e1_energy)) AS r
  FROM {{b_screening}} WINDOW w AS (PARTITION BY composition_key)))"""
RISK = f"""{REL}, risk AS (SELECT s.*, rel.status, CASE WHEN rel.status = 'unknown' OR d >= 300 OR r >= 30 OR abs(e0_force - e1_force) >= 0.03 OR abs(e0_stress - e1_stress) >= 0.03 THEN 'high'
  WHEN d >= 100 OR r >= 10 OR abs(e0_force - e1_force) >= 0.01 OR abs(e0_stress - e1_stress) >= 0.01 THEN 'medium' ELSE 'low' END AS risk FROM {{b_screening}} s JOIN rel USING (candidate_id))"""
DOM = " AND ".join(f"a.{x} <= b.{x}" for x in AXES) + " AND (" + " OR ".join(f"a.{x} < b.{x}" for x in AXES) + ")"
FRONTS = f"""chain(candidate_id, front) AS (SELECT candidate_id, 1 FROM {{b_screening}} UNION SELECT b.candidate_id, c.front + 1 FROM chain c JOIN {{b_screening}} a ON a.candidate_id = c.candidate_id JOIN {{b_screening}} b ON a.composition_key = b.composition_key AND {DOM}),
fronts AS (SELECT candidate_id, CAST(max(front) AS BIGINT) AS front FROM chain GROUP BY 1)"""
CROWD = "crowd AS (SELECT candidate_id, n <= 2 OR " + " OR ".join(f"({x}_v AND ({x}_b IS NULL OR {x}_a IS NULL))" for x in AXES) + " AS boundary, CASE WHEN n <= 2 THEN 0.0 ELSE " + " + ".join(f"CASE WHEN {x}_v AND {x}_b IS NOT NULL AND {x}_a IS NOT NULL THEN ({x}_a - {x}_b) / {x}_s ELSE 0.0 END" for x in AXES) + " END AS crowding FROM (SELECT candidate_id, count(*) OVER (PARTITION BY composition_key, front) AS n, " + ", ".join(f"lag({x}) OVER (PARTITION BY composition_key, front ORDER BY {x}, candidate_id) AS {x}_b, lead({x}) OVER (PARTITION BY composition_key, front ORDER BY {x}, candidate_id) AS {x}_a, max({x}) OVER (PARTITION BY composition_key, front) - min({x}) OVER (PARTITION BY composition_key, front) AS {x}_s, max({x}) OVER (PARTITION BY composition_key, front) - min({x}) OVER (PARTITION BY composition_key, front) > 1e-15 AS {x}_v" for x in AXES) + " FROM {b_screening} JOIN fronts USING (candidate_id)))"
RANKED = f"""{RISK}, {CROWD}, ranked AS (SELECT candidate_id, composition_key, front, risk, e0_force > 0 AND (greatest(e0_force, e1_force) <= 0.095 OR risk = 'high') AS eligible, risk = 'high' AS escalate,
  row_number() OVER (ORDER BY greatest(e0_force, e1_force) > 0.095, front, NOT boundary, -floor(crowding * 1e9 + 0.5), greatest(e0_force, e1_force), CASE risk WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, composition_key, candidate_id) AS rank
  FROM risk JOIN fronts USING (candidate_id) JOIN crowd USING (candidate_id))"""
ALL_RANKED = f"WITH RECURSIVE {FRONTS}, {RANKED}"


def relative(t, screening=None):
    rows = (t.b_screening if screening is None else screening).withColumn("alignment_id", F.expr(ALIGNED))
    return O.relative_energy(rows, "candidate_id", "composition_key", "e0_energy", "e1_energy", "alignment_id")


def risks(t, screening=None):
    screening = t.b_screening if screening is None else screening
    rows = screening.join(relative(t, screening).drop("composition_key", "reasons"), "candidate_id")
    gap = lambda a: F.abs(F.col(f"e0_{a}") - F.col(f"e1_{a}"))
    measures = {"energy": (F.col("energy_difference"), 100.0, 300.0), "rank": (F.col("rank_difference"), 10, 30), "force": (gap("force"), 0.01, 0.03), "stress": (gap("stress"), 0.01, 0.03)}
    return rows.withColumn("verdict", O.risk_class(measures, {"relative_energy_unavailable": F.col("status") == "unknown"}))


def ranked(t):
    screening = materialize(t.b_screening, "screening")  # two aggregates of the lines, read three times below
    rows = risks(t, screening).select("candidate_id", "composition_key", *AXES, F.col("verdict.risk").alias("risk"), F.col("verdict.escalate").alias("escalate"))
    fronts = O.pareto_fronts(screening, "candidate_id", "composition_key", AXES)
    rows = O.crowding(rows.join(fronts, "candidate_id"), "candidate_id", ["composition_key", "front"], AXES)
    force = F.greatest("e0_force", "e1_force")
    rows = rows.withColumn("eligible", (F.col("e0_force") > 0) & ((force <= 0.095) | F.col("escalate")))
    order = [force > 0.095, F.col("front"), ~F.col("boundary"), -F.floor(F.col("crowding") * 1e9 + 0.5), force, F.array_position(F.array(*map(F.lit, ("low", "medium", "high"))), F.col("risk")), F.col("composition_key"), F.col("candidate_id")]
    return O.global_rank(rows, order)


@query("""SELECT p_partkey AS candidate_id, CASE WHEN n1 = 1 AND n2 = 1 THEN v1 END AS first_value, CASE WHEN n1 = 1 AND n2 = 1 THEN v2 END AS second_value,
array_to_string(list_filter([CASE WHEN n1 <> 1 THEN 'first_not_exactly_one' END, CASE WHEN n2 <> 1 THEN 'second_not_exactly_one' END], lambda x: x IS NOT NULL), ';') AS reasons FROM (
SELECT p_partkey, count(CASE WHEN expert_id = 'e0' THEN 1 END) n1, count(CASE WHEN expert_id = 'e1' THEN 1 END) n2, max(CASE WHEN expert_id = 'e0' THEN energy END) v1, max(CASE WHEN expert_id = 'e1' THEN energy END) v2
FROM {part} LEFT JOIN {b_prediction} ON candidate_id = p_partkey GROUP BY 1)""")
def pair_align(t):
    rows = t.part.select(F.col("p_partkey").alias("candidate_id")).join(t.b_prediction, "candidate_id", "left")
    rows = rows.withColumn("expert_id", F.coalesce("expert_id", F.lit("none")))
    return O.pair_experts(rows, "candidate_id", "energy", "e0", "e1").withColumn("reasons", S.joined(F.col("reasons")))


@query(f"WITH {REL} SELECT candidate_id, composition_key, pool_size, reasons, status, CASE WHEN status = 'available' THEN floor(d * 10000 + 0.5) / 10000 END AS energy_difference, CASE WHEN status = 'available' THEN CAST(r AS BIGINT) END AS rank_difference, status = 'unknown' AS escalate FROM rel")
def relative_energy(t):
    return relative(t).withColumn("energy_difference", S.rounded(F.col("energy_difference"))).withColumn("reasons", S.joined(F.col("reasons")))


@query(f"WITH {RISK} SELECT candidate_id, risk, risk = 'high' AS escalate, CASE WHEN status = 'unknown' THEN 'relative_energy_unavailable' ELSE '' END AS reasons FROM risk")
def risk_class(t):
    return risks(t).select("candidate_id", "verdict.risk", "verdict.escalate", S.joined(F.col("verdict.reasons")).alias("reasons"))


@query("""SELECT candidate_id, expert_id, array_to_string(list_sort(list_filter([CASE WHEN max_force > 0.09 THEN 'force_above_limit' END, CASE WHEN stress > 0.05 THEN 'stress_above_limit' END, CASE WHEN energy > 1800 THEN 'energy_not_converged' END], lambda x: x IS NOT NULL)), ';') AS failures, NOT (max_force > 0.09 OR stress > 0.05 OR energy > 1800) AS passed FROM {b_prediction}""")
def relax_gate(t):
    why = S.reasons(force_above_limit=F.col("max_force") > 0.09, stress_above_limit=F.col("stress") > 0.05, energy_not_converged=F.col("energy") > 1800)
    return t.b_prediction.select("candidate_id", "expert_id", S.joined(why).alias("failures"), (F.size(why) == 0).alias("passed"))


@query(f"WITH RECURSIVE {FRONTS} SELECT candidate_id, front FROM fronts")
def pareto_fronts(t):
    return O.pareto_fronts(t.b_screening, "candidate_id", "composition_key", AXES)


@query(f"""WITH RECURSIVE chain(candidate_id, front) AS (
  SELECT candidate_id, 1 FROM {{b_screening}}
  UNION SELECT b.candidate_id, c.front + 1 FROM chain c
  JOIN {{b_screening}} a ON a.candidate_id = c.candidate_id JOIN {{b_screening}} b ON {DOM})
SELECT candidate_id, CAST(max(front) AS BIGINT) AS front FROM chain GROUP BY 1""")
def pool_fronts(t):
    """Fronts of all candidates as one pool."""
    return O.pareto_fronts(t.b_screening.withColumn("pool", F.lit("all")), "candidate_id", "pool", AXES)


@query(f"WITH RECURSIVE {FRONTS}, {CROWD} SELECT candidate_id, boundary, floor(crowding * 10000 + 0.5) / 10000 AS crowding FROM crowd")
def crowding(t):
    fronts = O.pareto_fronts(t.b_screening, "candidate_id", "composition_key", AXES)
    out = O.crowding(t.b_screening.join(fronts, "candidate_id"), "candidate_id", ["composition_key", "front"], AXES)
    return out.select("candidate_id", "boundary", S.rounded(F.col("crowding")).alias("crowding"))


@query(f"{ALL_RANKED} SELECT candidate_id, composition_key, front, risk, eligible, escalate, rank FROM ranked")
def priority_rank(t):
    return ranked(t).select("candidate_id", "composition_key", "front", "risk", "eligible", "escalate", "rank")


@query(f"""{ALL_RANKED}, tier AS (SELECT *, CASE WHEN rank = min(rank) OVER (PARTITION BY composition_key) THEN 0 ELSE 1 END AS tier FROM ranked WHERE eligible),
chosen AS (SELECT candidate_id, escalate, row_number() OVER (ORDER BY tier, rank) AS slot FROM tier QUALIFY slot <= 5),
extra AS (SELECT candidate_id, least(5, (SELECT count(*) FROM chosen) + 1) AS slot FROM tier WHERE escalate AND NOT (SELECT coalesce(bool_or(escalate), false) FROM chosen) ORDER BY rank LIMIT 1)
SELECT candidate_id, slot FROM chosen WHERE slot NOT IN (SELECT slot FROM extra) UNION ALL SELECT candidate_id, slot FROM extra""")
def portfolio(t):
    return O.portfolio(ranked(t), "candidate_id", "composition_key", 5)


@query(f"""{ALL_RANKED} SELECT p_partkey AS candidate_id, CASE WHEN r.candidate_id IS NULL THEN 'unknown' WHEN NOT eligible THEN 'invalid_geometry' ELSE 'complete' END AS status, coalesce(escalate, true) AS escalate FROM {{part}} LEFT JOIN ranked r ON r.candidate_id = p_partkey""")
def screening_receipt(t):
    parts = t.part.select(F.col("p_partkey").alias("candidate_id"))
    out = parts.join(ranked(t), "candidate_id", "left")
    status = F.when(F.col("rank").isNull(), "unknown").when(~F.col("eligible"), "invalid_geometry").otherwise("complete")
    return out.select("candidate_id", status.alias("status"), F.coalesce("escalate", F.lit(True)).alias("escalate"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, floor(sqrt(a*a + b*b + c*c + 2*(d*d + a*a + b*b)) * 10000 + 0.5) / 10000 AS frobenius FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS a, l_discount AS b, l_tax AS c, l_discount * 2 AS d FROM {lineitem})""")
def stress_norm(t):
    c = {k: F.col(k) for k in ("l_quantity", "l_discount", "l_tax")}
    norm = S.frobenius_stress(c["l_quantity"], c["l_discount"], c["l_tax"], c["l_discount"] * 2, c["l_quantity"], c["l_discount"])
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", S.rounded(norm).alias("frobenius"))


@query("""WITH p AS (SELECT a.vec_id, list_zip(a.embedding, b.embedding) AS z FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = a.vec_id + 1),
s AS (SELECT vec_id, list_transform(range(0, 21), lambda i: list_sum(list_transform(range(1, 4), lambda k: (CAST(z[3*i+k][1] AS DOUBLE) - CAST(z[3*i+k][2] AS DOUBLE)) * (CAST(z[3*i+k][1] AS DOUBLE) - CAST(z[3*i+k][2] AS DOUBLE))))) AS q FROM p)
SELECT vec_id, floor(sqrt(list_sum(q) / 63) * 10000 + 0.5) / 10000 AS component, floor(sqrt(list_sum(q) / 21) * 10000 + 0.5) / 10000 AS vector, floor(sqrt(list_max(q)) * 10000 + 0.5) / 10000 AS largest FROM s""")
def force_metrics(t):
    atoms = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.transform(F.slice("embedding", i * 3 + 1, 3), lambda x: x.cast("double")))
    rows = t.embeddings.select("vec_id", atoms.alias("f"))
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("f").alias("g")), "vec_id")
    made = {"component": S.component_rmse, "vector": S.vector_rms, "largest": S.largest_vector_gap}
    return pairs.select("vec_id", *[S.rounded(f(F.col("f"), F.col("g"))).alias(n) for n, f in made.items()])


LIMITS = {"force": 0.07, "distance": 3.0, "volume_change": 0.2, "stress": 0.06}


@query("""SELECT p_partkey, CAST(n AS BIGINT) AS n_lines, array_to_string(list_sort(list_filter([CASE WHEN NOT coalesce(n >= 20, false) THEN 'optimizer_not_converged' END, CASE WHEN coalesce(force > 0.07, true) THEN 'final_force_above_target' END,
  CASE WHEN coalesce(distance < 3, true) THEN 'minimum_distance_below_safety_threshold' END, CASE WHEN coalesce(abs(change) > 0.2, true) THEN 'volume_change_above_allowed_limit' END, CASE WHEN stress IS NULL THEN 'final_stress_unavailable' END,
  CASE WHEN stress > 0.06 THEN 'final_stress_above_allowed_limit' END, CASE WHEN p_size = 13 THEN 'relaxed_atom_count_changed' END, CASE WHEN p_retailprice <= 901 THEN 'invalid_relaxed_geometry' END], lambda x: x IS NOT NULL)), ';') AS failures
FROM (SELECT p_partkey, p_size, p_retailprice, n, force, distance, (p_size - 25) / 50.0 AS change, CASE WHEN p_size < 45 THEN stress END AS stress FROM {part} LEFT JOIN (
  SELECT l_partkey, count(*) AS n, max(l_discount) AS force, min(l_quantity) AS distance, max(l_tax) AS stress FROM {lineitem} GROUP BY 1) ON l_partkey = p_partkey)""")
def relaxation_gate(t):
    """The whole strict gate on parts: convergence, force, distance, volume, stress, atoms and geometry."""
    ends = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.max("l_discount").alias("force"), F.min("l_quantity").alias("distance"), F.max("l_tax").alias("stress"))
    rows = t.part.join(ends, "p_partkey", "left")
    why = assessment.relaxation_failures(F.col("n") >= 20, F.col("force"), F.col("distance"), (F.col("p_size") - 25) / 50.0, F.when(F.col("p_size") < 45, F.col("stress")), F.col("p_size") != 13, F.col("p_retailprice") > 901, LIMITS)
    return rows.select("p_partkey", F.col("n").alias("n_lines"), S.joined(why).alias("failures"))
