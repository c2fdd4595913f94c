"""A/B arms and distances over orders, documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import scalars as S
from assaylake.operators import pairing
from assaylake.plans.registry import query

TERMS = {"legal": ["rights", "license", "gnu"], "web": ["mit", "apache"], "contact": ["reserved", "version"]}


@query("""SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.pair_slot, b.pair_slot) AS pair_slot, a.config = b.config AND a.pair_id IS NOT NULL AND b.pair_id IS NOT NULL AS paired,
CASE WHEN a.pair_id IS NULL THEN 'off_missing' WHEN b.pair_id IS NULL THEN 'on_missing' WHEN a.config <> b.config THEN 'config_differs' END AS reason, CASE WHEN a.config = b.config THEN floor((a.value - b.value) * 100 + 0.5) / 100 END AS improvement
FROM (SELECT * FROM {b_pair} WHERE arm = 'off') a FULL JOIN (SELECT * FROM {b_pair} WHERE arm = 'on') b ON a.pair_id = b.pair_id AND a.pair_slot = b.pair_slot""")
def paired_delta(t):
    arm = lambda a, p: t.b_pair.where(F.col("arm") == a).select("pair_id", "pair_slot", F.col("value").alias(f"{p}v"), F.col("config").alias(f"{p}c"))
    both = arm("off", "a").join(arm("on", "b"), ["pair_id", "pair_slot"], "full")
    why = F.when(F.col("ac").isNull(), "off_missing").when(F.col("bc").isNull(), "on_missing").when(F.col("ac") != F.col("bc"), "config_differs")
    gain = S.signed_improvement(F.col("av"), F.col("bv"), F.lit("minimize"), *[F.lit(None).cast("double")] * 3)
    return both.select("pair_id", "pair_slot", why.isNull().alias("paired"), why.alias("reason"), F.when(why.isNull(), S.rounded(gain, 2)).alias("improvement"))


@query("""WITH c AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n FROM {orders} GROUP BY 1, 2), f AS (SELECT p, s, n / sum(n) OVER (PARTITION BY p) AS f FROM c),
k AS (SELECT a.p AS pa, b.p AS pb, s.s FROM (SELECT DISTINCT p FROM c) a JOIN (SELECT DISTINCT p FROM c) b ON a.p < b.p CROSS JOIN (SELECT DISTINCT s FROM c) s),
x AS (SELECT pa, pb, coalesce(fa.f, 0.0) AS u, coalesce(fb.f, 0.0) AS v FROM k LEFT JOIN f fa ON fa.p = pa AND fa.s = k.s LEFT JOIN f fb ON fb.p = pb AND fb.s = k.s)
SELECT pa AS a, pb AS b, floor(sum(abs(u - v)) / 2 * 10000 + 0.5) / 10000 AS total_variation, floor(sum(CASE WHEN u > 0 THEN u * log2(2 * u / (u + v)) ELSE 0 END + CASE WHEN v > 0 THEN v * log2(2 * v / (u + v)) ELSE 0 END) / 2 * 10000 + 0.5) / 10000 AS jensen_shannon FROM x GROUP BY 1, 2""")
def tv_js_divergence(t):
    counts = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").cast("double").alias("n"))
    maps = counts.groupBy("o_orderpriority").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m")).select("o_orderpriority", S.fractions(F.col("m")).alias("f"))
    side = lambda n: maps.select(F.col("o_orderpriority").alias(n), F.col("f").alias(f"f{n}"))
    pairs = side("a").join(side("b"), F.col("a") < F.col("b"))  # a row a priority
    return pairs.select("a", "b", S.rounded(S.total_variation(F.col("fa"), F.col("fb"))).alias("total_variation"), S.rounded(S.jensen_shannon(F.col("fa"), F.col("fb"))).alias("jensen_shannon"))


@query("""SELECT a.p_partkey, floor(levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) * 10000 + 0.5) / 10000 AS distance FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 1""")
def edit_distance(t):
    after = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return t.part.join(after, "p_partkey").select("p_partkey", S.rounded(S.sequence_distance(F.col("p_name"), F.col("other"))).alias("distance"))


@query("""WITH k AS (SELECT o_custkey, o_orderpriority AS kind, array_to_string(list_sort(list(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END) FILTER (o_orderkey % 2 = 0)), ',') AS a, array_to_string(list_sort(list(o_orderstatus) FILTER (o_orderkey % 2 = 1)), ',') AS b FROM {orders} GROUP BY 1, 2)
SELECT o_custkey, array_to_string(list_sort(list(kind) FILTER (coalesce(a, '') <> coalesce(b, ''))), ';') AS changed FROM k GROUP BY 1 HAVING count(CASE WHEN coalesce(a, '') <> coalesce(b, '') THEN 1 END) > 0""")
def kinds_changed(t):
    of = lambda r: F.array_sort(F.collect_list(F.when(F.col("o_orderkey") % 2 == r, F.col("o_orderstatus"))))
    kinds = t.orders.groupBy("o_custkey", F.col("o_orderpriority").alias("kind")).agg(of(0).alias("a"), of(1).alias("b"))
    return kinds.where("a <> b").groupBy("o_custkey").agg(S.joined(F.array_sort(F.collect_list("kind"))).alias("changed"))


WEIGHTS = {"gnu": 4, "apache": 3, "rights": 2}
TERM_ROWS = [(field, term, WEIGHTS.get(term, 1)) for field, terms in TERMS.items() for term in terms]
TERM_SQL = "(VALUES " + ", ".join(f"('{f}', '{w}', {n})" for f, w, n in TERM_ROWS) + ") v(field, term, weight)"


@query(f"""WITH m AS (SELECT doc_id, field, weight FROM {{documents}} JOIN {TERM_SQL} ON regexp_matches(lower(text), '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)')),
s AS (SELECT doc_id, field, sum(weight) AS score FROM m GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS next FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, field))
SELECT doc_id, CASE WHEN score = next THEN 'general' ELSE field END AS field, CAST(score AS BIGINT) AS score, score = coalesce(next, 0) AS ambiguous,
       CASE WHEN score = next THEN 'low' WHEN score >= 6 AND score >= coalesce(next, 0) + 3 THEN 'high' ELSE 'medium' END AS confidence FROM r WHERE k = 1""")
def term_route(t):
    from pyspark.sql import Window

    from assaylake.functions.sizes import dictionary

    terms = t.spark.createDataFrame(TERM_ROWS, "field string, term string, weight long")
    hits = t.documents.select("doc_id", F.lower("text").alias("text")).join(dictionary(terms), S.mentions(F.col("text"), F.col("term")))
    scores = hits.groupBy("doc_id", "field").agg(F.sum("weight").alias("score"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "field")
    best = scores.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).where("k = 1")
    tie = F.coalesce(F.col("score") == F.col("next"), F.lit(False))
    confidence = F.when(tie, "low").when((F.col("score") >= 6) & (F.col("score") >= F.coalesce("next", F.lit(0)) + 3), "high").otherwise("medium")
    return best.select("doc_id", F.when(tie, "general").otherwise(F.col("field")).alias("field"), "score", tie.alias("ambiguous"), confidence.alias("confidence"))


@query("""SELECT p_partkey AS parent, round(x, 2) AS control FROM (SELECT p_partkey, unnest([0.5, 0.4, 0.6, 0.5 + p_size / 100.0]) AS x FROM {part}) GROUP BY 1, 2""".replace("round(x, 2)", "floor(least(0.9, x) * 100 + 0.5) / 100"))
def control_sweep(t):
    points = F.array(F.lit(0.5), F.lit(0.4), F.lit(0.6), 0.5 + F.col("p_size") / 100.0)
    return t.part.select(F.col("p_partkey").alias("parent"), F.explode(points).alias("x")).select("parent", S.rounded(F.least(F.lit(0.9), F.col("x")), 2).alias("control")).distinct()


@query("""SELECT o_orderkey, CAST('0x' || substr(sha256(CAST(to_json(['7', CAST(o_orderkey AS VARCHAR), o_orderpriority]) AS VARCHAR)), 1, 8) AS BIGINT) AS seed FROM {orders}""")
def sampling_seed(t):
    return t.orders.select("o_orderkey", S.sampling_seed(F.lit(7), F.col("o_orderkey"), F.col("o_orderpriority")).alias("seed"))


#: A customer's first three orders of either parity as the slots of a paired run; the customer's row stands for both runs.
SLOTS = """SELECT pair_id, arm, pair_slot, candidate_id, value, CASE WHEN value > 490000 THEN 'other' ELSE 'seed' END AS batch_seed,
  pair_slot + CASE WHEN value < 6000 THEN 1 ELSE 0 END AS stream_position FROM {b_pair} WHERE pair_slot < 3"""
RUNS = """SELECT c_custkey AS pair_id, arm, CAST(3 AS BIGINT) AS n_candidates, 'seed' AS seed,
  CASE WHEN c_acctbal < -900 THEN NULL WHEN c_acctbal > 9800 AND arm = 'on' THEN 'changed' ELSE 'h' || c_nationkey END AS runtime_hash FROM {customer} CROSS JOIN (SELECT 'off' AS arm UNION ALL SELECT 'on') a"""
PAIRED = f"""slots AS ({SLOTS}), runs AS ({RUNS}), r AS (SELECT pair_id, bool_or(runtime_hash IS NULL) AS unattested, count(DISTINCT runtime_hash) > 1 AS differs FROM runs GROUP BY 1),
h AS (SELECT pair_id, count(CASE WHEN arm = 'off' THEN 1 END) AS n_off, count(CASE WHEN arm = 'on' THEN 1 END) AS n_on, bool_or(arm = 'off' AND batch_seed <> 'seed') AS w_off, bool_or(arm = 'on' AND batch_seed <> 'seed') AS w_on FROM slots GROUP BY 1),
m AS (SELECT pair_id, bool_or(n = 1) AS alone, bool_or(lo <> hi) AS moved FROM (SELECT pair_id, pair_slot, count(*) AS n, min(stream_position) AS lo, max(stream_position) AS hi FROM slots GROUP BY 1, 2) GROUP BY 1),
audit AS (SELECT r.pair_id, array_to_string(list_sort(list_filter([
  CASE WHEN coalesce(n_off, 0) <> 3 THEN 'off_slots_missing_or_repeated' END, CASE WHEN coalesce(n_on, 0) <> 3 THEN 'on_slots_missing_or_repeated' END, CASE WHEN w_off THEN 'off_wrong_batch_seed' END, CASE WHEN w_on THEN 'on_wrong_batch_seed' END,
  CASE WHEN unattested THEN 'runtime_not_attested' END, CASE WHEN differs THEN 'runtime_differs' END, CASE WHEN alone THEN 'slot_sets_differ' END, CASE WHEN moved THEN 'stream_positions_differ' END], lambda x: x IS NOT NULL)), ';') AS reasons
  FROM r LEFT JOIN h USING (pair_id) LEFT JOIN m USING (pair_id))"""


def paired_runs(t):
    customer = t.customer
    return t.spark.sql(RUNS, customer=customer), t.spark.sql(SLOTS, b_pair=t.b_pair)


@query(f"WITH {PAIRED} SELECT pair_id, reasons FROM audit")
def pair_audit(t):
    return pairing.audit_pairs(*paired_runs(t)).withColumn("reasons", S.joined(F.col("reasons")))


@query(f"""WITH {PAIRED}, kinds AS (SELECT l_orderkey AS candidate_id, p_type, count(*) AS n FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey GROUP BY 1, 2),
shares AS (SELECT candidate_id, p_type, n / sum(n) OVER (PARTITION BY candidate_id) AS f FROM kinds),
good AS (SELECT a.pair_id, a.pair_slot, a.candidate_id AS x, b.candidate_id AS y, a.value AS u, b.value AS v FROM slots a JOIN slots b ON a.pair_id = b.pair_id AND a.pair_slot = b.pair_slot AND a.arm = 'off' AND b.arm = 'on' JOIN audit d ON d.pair_id = a.pair_id AND d.reasons = ''),
gaps AS (SELECT x, y, sum(abs(coalesce(f, 0) - coalesce(g, 0))) / 2 AS tv, count(CASE WHEN f IS NULL OR g IS NULL THEN 1 END) AS changed FROM
  (SELECT x, y, k.p_type, (SELECT f FROM shares s WHERE s.candidate_id = x AND s.p_type = k.p_type) AS f, (SELECT f FROM shares s WHERE s.candidate_id = y AND s.p_type = k.p_type) AS g
   FROM good JOIN kinds k ON k.candidate_id = x OR k.candidate_id = y GROUP BY ALL) GROUP BY 1, 2)
SELECT pair_id, pair_slot, x AS off_candidate, y AS on_candidate, floor((u - v) * 100 + 0.5) / 100 AS improvement,
  CASE WHEN EXISTS (SELECT 1 FROM kinds WHERE candidate_id = x) AND EXISTS (SELECT 1 FROM kinds WHERE candidate_id = y) THEN floor(tv * 10000 + 0.5) / 10000 END AS total_variation,
  CASE WHEN EXISTS (SELECT 1 FROM kinds WHERE candidate_id = x) AND EXISTS (SELECT 1 FROM kinds WHERE candidate_id = y) THEN changed END AS kinds_changed
FROM good LEFT JOIN gaps USING (x, y)""")
def pair_comparison(t):
    """Slots of sound pairs: a lower price is an improvement; the orders' part types as distributions and as sets."""
    kinds = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("l_orderkey").alias("candidate_id"), "p_type").agg(F.count("*").cast("double").alias("n"))
    shares = kinds.groupBy("candidate_id").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "n"))).alias("m")).select("candidate_id", S.fractions(F.col("m")).alias("shares"))  # the few types there are
    runs, slots = paired_runs(t)
    none = [F.lit(None).cast("double")] * 3
    deltas = {
        "improvement": lambda off, on: S.rounded(S.signed_improvement(off("value"), on("value"), F.lit("minimize"), *none), 2),
        "total_variation": lambda off, on: S.rounded(S.total_variation(off("shares"), on("shares"))),
        "kinds_changed": lambda off, on: F.size(F.array_except(F.map_keys(off("shares")), F.map_keys(on("shares")))) + F.size(F.array_except(F.map_keys(on("shares")), F.map_keys(off("shares")))),
    }
    return pairing.compare_pairs(runs, slots.join(shares, "candidate_id", "left"), deltas)
