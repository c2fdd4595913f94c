"""Branch selection and calibration over parts, suppliers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import scalars as S
from assaylake.operators import calibration, exploration
from assaylake.operators import evidence as E
from assaylake.operators import selection as O
from assaylake.plans.registry import query
from assaylake.session import materialize

POOL = """pool AS (SELECT p_partkey AS candidate_id, p_brand AS scope, -floor(p_retailprice * 100 + 0.5) / 100 AS price, CAST(p_size AS DOUBLE) AS size, p_type AS kind FROM {part})"""
NORM = """norm AS (SELECT b.candidate_id, expert_id, property_name, p_brand AS scope, CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 1.0 END AS nv FROM (
SELECT b.*, p_brand, min(value) OVER w AS lo, max(value) OVER w AS hi FROM {b_property} b JOIN {part} ON p_partkey = candidate_id WINDOW w AS (PARTITION BY property_name, expert_id)) b)"""
DIS = f"""{NORM}, sp AS (SELECT candidate_id, scope, property_name, max(nv) - min(nv) AS span, count(DISTINCT expert_id) AS e FROM norm GROUP BY 1, 2, 3),
pan AS (SELECT scope, count(DISTINCT candidate_id) AS members FROM sp WHERE property_name = 'energy' GROUP BY 1),
dis AS (SELECT candidate_id, max(CASE WHEN e >= 2 AND NOT (property_name = 'energy' AND coalesce(members, 0) < 2) THEN span END) AS score, max(CASE WHEN e < 2 THEN 1 ELSE 0 END) AS single FROM sp LEFT JOIN pan USING (scope) GROUP BY 1)"""
BRANCH = f"""{DIS}, src AS (SELECT p_partkey AS candidate_id, p_type AS kind, -p_retailprice AS stability, -abs(p_size - 25.0) AS target FROM {{part}}),
br AS (SELECT 'stability' AS branch, kind, candidate_id, stability AS score FROM src UNION ALL SELECT 'target', kind, candidate_id, target FROM src UNION ALL SELECT 'disagreement', kind, d.candidate_id, score FROM dis d JOIN src USING (candidate_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY kind, branch ORDER BY score DESC NULLS LAST, candidate_id) AS rank FROM br QUALIFY rank <= 8)"""


def pool(t):
    price = -F.floor(F.col("p_retailprice") * 100 + 0.5) / 100
    return t.part.select(F.col("p_partkey").alias("candidate_id"), F.col("p_brand").alias("scope"), price.alias("price"), F.col("p_size").cast("double").alias("size"), F.col("p_type").alias("kind"))


def normalised(t):
    rows = t.b_property.join(t.part.select(F.col("p_partkey").alias("candidate_id"), F.col("p_brand").alias("scope")), "candidate_id")
    return E.min_max(rows, "value", ["property_name", "expert_id"])


def branches(t):
    src = t.part.select(F.col("p_partkey").alias("candidate_id"), F.col("p_type").alias("kind"), (-F.col("p_retailprice")).alias("stability"), (-F.abs(F.col("p_size") - 25.0)).alias("target"))
    apart = O.selector_disagreement(normalised(t), "candidate_id", "scope", "energy").select("candidate_id", F.col("score").alias("disagreement"))
    wide = src.join(apart, "candidate_id")
    plain = src.unpivot(["kind", "candidate_id"], ["stability", "target"], "branch", "score")
    rows = plain.unionByName(wide.select("kind", "candidate_id", F.lit("disagreement").alias("branch"), F.col("disagreement").alias("score")))
    return O.top_k(rows, ["kind", "branch"], [F.col("score").desc_nulls_last(), F.col("candidate_id")], 8)


@query("""SELECT p_partkey AS candidate_id, array_to_string(r, ';') AS reasons, len(r) = 0 AS eligible FROM (SELECT p_partkey, list_sort(list_filter([CASE WHEN n IS NULL THEN 'missing_evidence' END, CASE WHEN n < 2 THEN 'missing_evaluator' END, CASE WHEN p_size > 45 THEN 'out_of_domain' END, CASE WHEN worst > 0.09 THEN 'constraint_violated' END], lambda x: x IS NOT NULL)) AS r
FROM {part} LEFT JOIN (SELECT candidate_id, count(DISTINCT expert_id) AS n, max(max_force) AS worst FROM {b_prediction} GROUP BY 1) ON candidate_id = p_partkey)""")
def eligibility(t):
    seen = t.b_prediction.groupBy("candidate_id").agg(F.countDistinct("expert_id").alias("n"), F.max("max_force").alias("worst"))
    rows = t.part.select(F.col("p_partkey").alias("candidate_id"), "p_size").join(seen, "candidate_id", "left")
    out = E.eligibility(rows, "candidate_id", missing_evidence=F.col("n").isNull(), missing_evaluator=F.col("n") < 2, out_of_domain=F.col("p_size") > 45, constraint_violated=F.col("worst") > 0.09)
    return out.select("candidate_id", S.joined(F.col("reasons")).alias("reasons"), "eligible")


@query("SELECT candidate_id FROM {b_property} GROUP BY 1 HAVING count(DISTINCT (expert_id, property_name)) = (SELECT count(DISTINCT (expert_id, property_name)) FROM {b_property})")
def common_dimensions(t):
    return O.common_dimensions(t.b_property, "candidate_id", ["expert_id", "property_name"])


@query(f"""WITH {POOL} SELECT candidate_id FROM pool a WHERE NOT EXISTS (SELECT 1 FROM pool b WHERE b.candidate_id <> a.candidate_id AND CASE WHEN a.scope = b.scope THEN b.size >= a.size AND b.price >= a.price AND (b.size > a.size OR b.price > a.price) ELSE b.size > a.size END)""")
def first_front(t):
    return O.first_front(pool(t).select("candidate_id", "scope", "size", "price"), "candidate_id", ["size"], ["price"], "scope").select("candidate_id")


@query(f"""WITH {POOL}, p AS (SELECT candidate_id, kind, scope, size / 50 AS x, price / 2000 AS y FROM pool) SELECT a.candidate_id, floor(coalesce(min(greatest(abs(a.x - b.x), abs(a.y - b.y))), 1.0) * 10000 + 0.5) / 10000 AS diversity FROM p a LEFT JOIN p b ON a.scope = b.scope AND a.candidate_id <> b.candidate_id GROUP BY 1""")
def diversity_nn(t):
    rows = pool(t).select("candidate_id", "scope", (F.col("size") / 50).alias("x"), (F.col("price") / 2000).alias("y"))
    return O.nearest_distance(rows, "candidate_id", "scope", ["x", "y"]).withColumn("diversity", S.rounded(F.col("diversity")))


@query(f"WITH {DIS} SELECT candidate_id, floor(score * 10000 + 0.5) / 10000 AS score, CASE WHEN score IS NULL AND single = 1 THEN 'single_expert' ELSE '' END AS reasons FROM dis")
def selector_disagreement(t):
    out = O.selector_disagreement(normalised(t), "candidate_id", "scope", "energy")
    return out.select("candidate_id", S.rounded(F.col("score")).alias("score"), S.joined(F.col("reasons")).alias("reasons"))


@query(f"WITH {BRANCH} SELECT kind, branch, candidate_id, rank FROM top")
def branch_topk(t):
    return branches(t).select("kind", "branch", "candidate_id", "rank")


@query(f"""WITH {DIS}, d AS (SELECT p_type AS kind, candidate_id, score FROM dis JOIN {{part}} ON p_partkey = candidate_id),
k AS (SELECT kind, candidate_id, row_number() OVER (PARTITION BY kind ORDER BY score DESC, candidate_id) AS rank FROM d WHERE score >= 0.5 QUALIFY rank <= 4),
u AS (SELECT kind, min(candidate_id) AS candidate_id FROM d WHERE score IS NULL GROUP BY 1),
s AS (SELECT u.kind, u.candidate_id, least(coalesce(n, 0) + 1, 4) AS rank FROM u LEFT JOIN (SELECT kind, count(*) AS n FROM k GROUP BY 1) USING (kind))
SELECT kind, candidate_id, rank FROM k WHERE (kind, rank) NOT IN (SELECT (kind, rank) FROM s) UNION ALL SELECT * FROM s""")
def disagreement_topk(t):
    rows = O.selector_disagreement(normalised(t), "candidate_id", "scope", "energy").join(t.part.select(F.col("p_partkey").alias("candidate_id"), F.col("p_type").alias("kind")), "candidate_id")
    return O.disagreement_top_k(rows, "candidate_id", "kind", 0.5, 4)


@query(f"""WITH {DIS}, {POOL}, near AS (SELECT a.candidate_id, floor(coalesce(min(greatest(abs(a.size - b.size) / 50, abs(a.price - b.price) / 2000)), 1.0) * 1000 + 0.5) / 1000 AS diversity
  FROM pool a LEFT JOIN pool b ON a.scope = b.scope AND a.candidate_id <> b.candidate_id GROUP BY 1),
front AS (SELECT candidate_id FROM pool a WHERE NOT EXISTS (SELECT 1 FROM pool b WHERE b.candidate_id <> a.candidate_id
  AND CASE WHEN a.scope = b.scope THEN b.size >= a.size AND b.price >= a.price AND (b.size > a.size OR b.price > a.price) ELSE b.size > a.size END)),
facts AS (SELECT p.candidate_id, kind, CASE WHEN kind <> 'ECONOMY' THEN price END AS stability, -abs(size - 25) AS target, diversity, floor(score * 1000 + 0.5) / 1000 AS disagreement,
  p.candidate_id IN (SELECT candidate_id FROM front) AS pareto FROM pool p JOIN near USING (candidate_id) LEFT JOIN dis USING (candidate_id)),
plain AS (SELECT kind, 'stability' AS branch, candidate_id, stability AS score FROM facts UNION ALL SELECT kind, 'target', candidate_id, target FROM facts
  UNION ALL SELECT kind, 'diversity', candidate_id, diversity FROM facts UNION ALL SELECT kind, 'pareto', candidate_id, target FROM facts WHERE pareto),
best AS (SELECT *, row_number() OVER (PARTITION BY kind, branch ORDER BY score DESC, candidate_id) AS rank FROM plain WHERE score IS NOT NULL QUALIFY rank <= 4),
stand AS (SELECT kind, 'stability' AS branch, candidate_id FROM facts WHERE kind IN (SELECT kind FROM facts GROUP BY 1 HAVING count(stability) = 0)
  QUALIFY row_number() OVER (PARTITION BY kind ORDER BY pareto DESC, target DESC NULLS LAST, candidate_id) = 1),
k AS (SELECT kind, candidate_id, disagreement AS score, row_number() OVER (PARTITION BY kind ORDER BY disagreement DESC, candidate_id) AS rank FROM facts WHERE disagreement >= 0.5 QUALIFY rank <= 4),
u AS (SELECT kind, min(candidate_id) AS candidate_id FROM facts WHERE disagreement IS NULL GROUP BY 1),
s AS (SELECT u.kind, u.candidate_id, NULL::DOUBLE AS score, least(coalesce(n, 0) + 1, 4) AS rank FROM u LEFT JOIN (SELECT kind, count(*) AS n FROM k GROUP BY 1) USING (kind))
SELECT kind, branch, rank, candidate_id, score, NULL AS reason FROM best
UNION ALL SELECT kind, branch, 1, candidate_id, NULL, '{exploration.FALLBACK}' FROM stand
UNION ALL SELECT kind, 'disagreement', rank, candidate_id, score, NULL FROM k WHERE (kind, rank) NOT IN (SELECT (kind, rank) FROM s)
UNION ALL SELECT kind, 'disagreement', rank, candidate_id, score, 'disagreement_unknown' FROM s""")
def exploration_branches(t):
    """Parents of each kind of part by five branches; the kind ECONOMY has no stability evidence."""
    thousandths = lambda c: S.rounded(F.col(c), 3).alias(c)
    rows = pool(t)
    near = O.nearest_distance(rows.select("candidate_id", "scope", (F.col("size") / 50).alias("x"), (F.col("price") / 2000).alias("y")), "candidate_id", "scope", ["x", "y"]).select("candidate_id", thousandths("diversity"))
    front = O.first_front(rows.select("candidate_id", "scope", "size", "price"), "candidate_id", ["size"], ["price"], "scope").select("candidate_id", F.lit(True).alias("pareto"))
    apart = O.selector_disagreement(normalised(t), "candidate_id", "scope", "energy").select("candidate_id", S.rounded(F.col("score"), 3).alias("disagreement"))
    facts = rows.join(near, "candidate_id").join(front, "candidate_id", "left").join(apart, "candidate_id", "left")
    facts = facts.withColumn("stability", F.when(F.col("kind") != "ECONOMY", F.col("price"))).withColumn("target", -F.abs(F.col("size") - 25))
    return exploration.explore(facts, "candidate_id", "kind", 4, 0.5)


@query(f"""WITH {BRANCH}, f AS (SELECT candidate_id, least(1.0, coalesce(sum(CASE WHEN score IS NOT NULL THEN CASE branch WHEN 'disagreement' THEN 0.25 ELSE 1.0 END / (20 + rank) END), 0) / (3.95 / 21)) AS fused, count(*) AS n_branches FROM top GROUP BY 1)
SELECT candidate_id, floor(fused * 10000 + 0.5) / 10000 AS fused, n_branches FROM f""")
def rrf_rank(t):
    return O.rank_fusion(branches(t), "candidate_id").withColumn("fused", S.rounded(F.col("fused")))


@query("""SELECT o_custkey, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate, o_orderkey, o_totalprice, conflict FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC) AS r, count(DISTINCT o_totalprice) OVER (PARTITION BY o_custkey, o_orderdate) > 1 AS conflict FROM {orders}) WHERE r = 1""".replace("CAST(o_orderdate AS TIMESTAMP) AS o_orderdate", "strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate"))
def latest_record(t):
    rows = t.orders.select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderkey", "o_totalprice")
    return O.latest_record(rows, "o_custkey", ["o_orderdate"], "o_totalprice")


@query("SELECT DISTINCT l_partkey, l_suppkey, sha256(CAST(to_json([CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)]) AS VARCHAR)) AS ref FROM {lineitem}")
def unique_refs(t):
    return t.lineitem.select("l_partkey", "l_suppkey").distinct().withColumn("ref", S.identity_hash(F.col("l_partkey"), F.col("l_suppkey")))


@query("""SELECT user_id, array_to_string(list_sort(list_filter(['signup', 'purchase', 'error'], lambda x: NOT list_contains(have, x))), ';') AS missing FROM (SELECT user_id, list(DISTINCT event_type) AS have FROM {events} GROUP BY 1)""")
def required_missing(t):
    have = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("have"))
    required = F.array(*map(F.lit, ("signup", "purchase", "error")))
    return have.select("user_id", S.joined(F.array_sort(F.array_except(required, "have"))).alias("missing"))


@query(f"""WITH {BRANCH}, c AS (SELECT candidate_id, CASE branch WHEN 'stability' THEN 1 WHEN 'target' THEN 2 ELSE 3 END AS tier, rank, md5(p_brand || p_type) AS digest FROM top JOIN {{part}} ON p_partkey = candidate_id),
d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY digest ORDER BY tier, rank, candidate_id) = 1) SELECT candidate_id, CAST(tier AS INT) AS tier, rank, digest FROM d ORDER BY tier, rank, candidate_id LIMIT 25""")
def shortlist(t):
    tier = F.when(F.col("branch") == "stability", 1).when(F.col("branch") == "target", 2).otherwise(3)
    rows = branches(t).join(t.part.select(F.col("p_partkey").alias("candidate_id"), F.md5(F.concat("p_brand", "p_type")).alias("digest")), "candidate_id")
    return O.shortlist(rows.select("candidate_id", tier.alias("tier"), "rank", "digest"), "candidate_id", "digest", 25)


QUANT = """q AS (SELECT scope_id, n, CAST(ceil((n + 1) * CAST(0.9 AS DOUBLE) - 1e-12) AS BIGINT) AS k FROM (SELECT scope_id, count(*) AS n FROM {b_calibration} GROUP BY 1)),
o AS (SELECT scope_id, score, row_number() OVER (PARTITION BY scope_id ORDER BY score) AS r FROM {b_calibration})"""


@query(f"WITH {QUANT} SELECT q.scope_id, n, k AS rank, score AS quantile, CASE WHEN k > n THEN 'calibration_set_too_small' END AS reason FROM q LEFT JOIN o ON o.scope_id = q.scope_id AND r = k")
def conformal_quantile(t):
    return O.conformal_quantile(t.b_calibration, "scope_id", "score", 0.1)


@query(f"""WITH {QUANT} SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE floor((o_totalprice - score) * 10000 + 0.5) / 10000 END AS lower_bound, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE floor((o_totalprice + score) * 10000 + 0.5) / 10000 END AS upper_bound,
CASE WHEN o_custkey % 11 = 0 THEN 'weight_revision_mismatch' ELSE '' END AS reasons FROM {{orders}} JOIN q ON q.scope_id = o_orderpriority JOIN o ON o.scope_id = q.scope_id AND r = k""")
def conformal_interval(t):
    artifact = O.conformal_quantile(t.b_calibration, "scope_id", "score", 0.1)
    rows = t.orders.join(artifact, F.col("o_orderpriority") == F.col("scope_id"), "left")
    why = S.reasons(scope_missing=F.col("scope_id").isNull(), quantile_missing=F.col("quantile").isNull(), weight_revision_mismatch=F.col("o_custkey") % 11 == 0)
    of = lambda x: F.when(F.size(why) == 0, S.rounded(x))
    return rows.select("o_orderkey", of(F.col("o_totalprice") - F.col("quantile")).alias("lower_bound"), of(F.col("o_totalprice") + F.col("quantile")).alias("upper_bound"), S.joined(why).alias("reasons"))


@query("""WITH cal AS (SELECT * FROM {b_calibration} WHERE sample_id % 5 <> 0), q AS (SELECT scope_id, CAST(ceil((count(*) + 1) * CAST(0.9 AS DOUBLE) - 1e-12) AS BIGINT) AS k FROM cal GROUP BY 1),
o AS (SELECT scope_id, score, row_number() OVER (PARTITION BY scope_id ORDER BY score) AS r FROM cal), v AS (SELECT q.scope_id, score AS quantile FROM q JOIN o ON o.scope_id = q.scope_id AND r = k)
SELECT scope_id, count(*) AS n_held_out, floor(avg(CASE WHEN score <= quantile THEN 1.0 ELSE 0.0 END) * 10000 + 0.5) / 10000 AS coverage FROM {b_calibration} JOIN v USING (scope_id) WHERE sample_id % 5 = 0 GROUP BY 1""")
def coverage(t):
    scores = t.b_calibration
    artifact = O.conformal_quantile(scores.where("sample_id % 5 <> 0"), "scope_id", "score", 0.1)
    held = scores.where("sample_id % 5 = 0").join(artifact.select("scope_id", "quantile"), "scope_id")
    return held.groupBy("scope_id").agg(F.count("*").alias("n_held_out"), S.rounded(F.avg((F.col("score") <= F.col("quantile")).cast("double"))).alias("coverage"))


#: A calibration run per priority, status and year of orders; what it may be used for is what its large orders held.
CALIBRATED = """b_order AS (
  SELECT o_orderkey, o_orderpriority AS scope_id, o_orderstatus AS revisions, CAST(year(o_orderdate) AS STRING) AS method, o_totalprice,
    {words} AS elements, {types} AS composition
  FROM {{orders}} JOIN {{lineitem}} ON l_orderkey = o_orderkey JOIN {{part}} ON p_partkey = l_partkey
  GROUP BY o_orderkey, o_orderpriority, o_orderstatus, year(o_orderdate), o_totalprice),
scored AS (SELECT b.*, s.score FROM b_order b JOIN {{b_calibration}} s ON s.sample_id = b.o_orderkey),
sized AS (SELECT scope_id, revisions, method, count(*) AS n, CAST(ceil((count(*) + 1) * CAST(0.9 AS DOUBLE) - 1e-12) AS BIGINT) AS k FROM scored GROUP BY 1, 2, 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY scope_id, revisions, method ORDER BY score) AS r FROM scored),
quantiles AS (SELECT s.scope_id, s.revisions, s.method, p.score AS quantile FROM sized s JOIN placed p
  ON p.scope_id = s.scope_id AND p.revisions = s.revisions AND p.method = s.method AND p.r = s.k),
artifacts AS (
  SELECT q.scope_id || '|' || q.revisions || '|' || q.method AS artifact_id, q.scope_id, q.revisions, q.method, q.quantile, a.allowed_elements, a.allowed_compositions
  FROM quantiles q JOIN (
    SELECT scope_id, revisions, method, {all_words} AS allowed_elements, {all_types} AS allowed_compositions
    FROM (SELECT *, {one_word} AS word FROM b_order WHERE o_totalprice > 480000) e GROUP BY 1, 2, 3) a
  ON a.scope_id = q.scope_id AND a.revisions = q.revisions AND a.method = q.method
  WHERE q.method <> '1996')"""
IN_DUCK = CALIBRATED.format(
    words="list_sort(list_distinct(flatten(list(string_split(p_name, ' ')))))", types="min(p_type)", all_words="list_distinct(list(word))", all_types="list_distinct(list(composition))", one_word="unnest(elements)",
)
IN_SPARK = CALIBRATED.format(
    words="array_sort(array_distinct(flatten(collect_list(split(p_name, ' ')))))", types="min(p_type)", all_words="collect_set(word)", all_types="collect_set(composition)", one_word="explode(elements)",
)


@query(f"""WITH {IN_DUCK}, hits AS (
  SELECT o.o_orderkey, min(a.artifact_id) AS artifact_id FROM b_order o JOIN artifacts a ON a.scope_id = o.scope_id AND a.revisions = o.revisions
    AND a.method = o.method AND list_has_all(a.allowed_elements, o.elements) AND list_contains(a.allowed_compositions, o.composition) GROUP BY 1),
checks AS (SELECT o.*, EXISTS (SELECT 1 FROM artifacts a WHERE a.scope_id = o.scope_id AND list_has_all(a.allowed_elements, o.elements)) AS inside,
  EXISTS (SELECT 1 FROM artifacts a WHERE a.scope_id = o.scope_id AND list_contains(a.allowed_compositions, o.composition)) AS listed,
  EXISTS (SELECT 1 FROM artifacts a WHERE a.scope_id = o.scope_id AND a.revisions = o.revisions) AS revised,
  EXISTS (SELECT 1 FROM artifacts a WHERE a.scope_id = o.scope_id AND a.method = o.method) AS methodical FROM b_order o)
SELECT c.o_orderkey AS candidate_id, h.artifact_id, floor((c.o_totalprice - a.quantile) * 10000 + 0.5) / 10000 AS lower_bound, floor((c.o_totalprice + a.quantile) * 10000 + 0.5) / 10000 AS upper_bound,
  CASE WHEN h.artifact_id IS NOT NULL THEN '' WHEN inside AND listed AND revised AND methodical THEN 'no_single_artifact' ELSE array_to_string(list_sort(list_filter([
    CASE WHEN NOT inside THEN 'chemistry_elements_out_of_scope' END, CASE WHEN NOT listed THEN 'reduced_composition_out_of_scope' END,
    CASE WHEN NOT revised THEN 'expert_weight_revision_mismatch' END, CASE WHEN NOT methodical THEN 'dft_method_mismatch' END], lambda x: x IS NOT NULL)), ';') END AS reasons
FROM checks c LEFT JOIN hits h USING (o_orderkey) LEFT JOIN artifacts a USING (artifact_id)""")
def calibration_scope(t):
    """Orders as requests: calibrated if one run of their priority, status and year covers all words and the type of their parts."""
    needed = {n: getattr(t, n) for n in ("orders", "lineitem", "part", "b_calibration")}
    same = {"reference_hash": F.lit("h"), "proxy_name": F.lit("price"), "unit": F.lit("USD")}
    orders = materialize(t.spark.sql(f"WITH {IN_SPARK} SELECT * FROM b_order", **needed), "orders")  # a join of three tables, read four times below
    runs = f"b_order AS (SELECT * FROM {{b_order}}), {IN_SPARK[IN_SPARK.index('scored AS'):]}"
    artifacts = t.spark.sql(f"WITH {runs} SELECT * FROM artifacts", b_order=orders, **needed).withColumns({**same, "coverage": F.lit(None).cast("double")})
    asked = orders.withColumns({**same, "candidate_id": F.col("o_orderkey"), "value": F.col("o_totalprice")})
    found = calibration.assess_proxies(asked, artifacts)
    return found.select("candidate_id", "artifact_id", S.rounded(F.col("lower_bound")).alias("lower_bound"), S.rounded(F.col("upper_bound")).alias("upper_bound"), S.joined(F.col("reasons")).alias("reasons"))
