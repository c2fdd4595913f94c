"""Identity and novelty over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import scalars as S
from assaylake.operators import lattice, leaders
from assaylake.operators import novelty as O
from assaylake.plans.registry import query

EXT = r"""ext AS (
  SELECT d.doc_id, d.source AS provider, e.record_id IS NOT NULL AS matched
  FROM (SELECT doc_id, source, trim(regexp_replace(lower(text), '[ \t\n\v\f\r]+', ' ', 'g')) AS probe FROM {documents}) d
  LEFT JOIN (SELECT trim(regexp_replace(lower(text), '[ \t\n\v\f\r]+', ' ', 'g')) AS probe, min(item_id) AS record_id FROM {benchmark} GROUP BY 1) e USING (probe)),
st AS (SELECT doc_id, provider, CASE WHEN substr(provider, 4) IN ('7', '13') THEN 'unknown' WHEN matched THEN 'match' ELSE 'no_match' END AS status FROM ext)"""


def external(t):
    """Identity with a record of the snapshot: the fingerprints of both whole texts in normal form agree."""
    whole = F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256)
    probes = t.documents.select("doc_id", F.col("source").alias("provider"), whole.alias("probe"))
    hits = t.benchmark.select(F.col("item_id").alias("record_id"), whole.alias("probe")).groupBy("probe").agg(F.min("record_id").alias("record_id"))
    rows = probes.join(hits, "probe", "left").withColumn("matched", F.col("record_id").isNotNull())
    complete = t.documents.select(F.col("source").alias("provider")).distinct().withColumn("complete", ~F.substring("provider", 4, 9).isin("7", "13"))
    return O.snapshot_status(rows, complete, "doc_id")


@query("SELECT doc_id, min(doc_id) OVER w AS first, count(*) OVER w AS copies, doc_id <> min(doc_id) OVER w AS duplicate FROM {documents} WINDOW w AS (PARTITION BY text)")
def batch_dup(t):
    return O.batch_duplicates(t.documents.withColumn("fingerprint", F.sha2("text", 256)), "doc_id", "fingerprint")


@query("SELECT d.doc_id, coalesce(n, 0) AS n_matches, m AS matched_id FROM (SELECT * FROM {documents} WHERE doc_id % 2 = 0) d LEFT JOIN (SELECT text, count(*) AS n, min(doc_id) AS m FROM {documents} WHERE doc_id % 2 = 1 GROUP BY 1) h USING (text)")
def history_match(t):
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("fingerprint"))
    history = rows.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "history_id")
    return O.history_matches(rows.where("doc_id % 2 = 0"), history, "fingerprint").select("doc_id", "n_matches", "matched_id")


@query(f"WITH {EXT} SELECT doc_id, provider, status FROM st")
def external_match(t):
    return external(t)


@query(f"""WITH {EXT}, stages AS (SELECT doc_id, status FROM st UNION ALL SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY text) > 1 THEN 'match' ELSE 'no_match' END FROM {{documents}})
SELECT doc_id, CASE WHEN bool_or(status = 'match') THEN 'match' WHEN bool_and(status = 'no_match') THEN 'no_match' ELSE 'unknown' END AS status FROM stages GROUP BY 1""")
def novelty_status(t):
    batch = O.batch_duplicates(t.documents.withColumn("fingerprint", F.sha2("text", 256)), "doc_id", "fingerprint")
    batch = batch.select("doc_id", F.when(F.col("copies") > 1, "match").otherwise("no_match").alias("status"))
    return O.status_algebra(external(t).select("doc_id", "status").unionByName(batch), ["doc_id"])


@query(f"""WITH {EXT}, base AS (SELECT doc_id AS candidate_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS slot FROM {{documents}} QUALIFY slot <= 5),
best AS (SELECT s.doc_id FROM st s JOIN {{documents}} d USING (doc_id) WHERE status = 'no_match' AND lang = 'es' ORDER BY n_chars DESC, doc_id LIMIT 1),
extra AS (SELECT doc_id AS candidate_id, 5 AS slot FROM best WHERE doc_id NOT IN (SELECT candidate_id FROM base))
SELECT candidate_id, slot, false AS reserved FROM base WHERE slot NOT IN (SELECT slot FROM extra) UNION ALL SELECT candidate_id, slot, true FROM extra""")
def reserve_slot(t):
    from pyspark.sql import Window

    top = t.documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(5)
    base = top.select(F.col("doc_id").alias("candidate_id"), F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).cast("long").alias("slot"))
    rank = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").alias("d"))
    pool = external(t).join(t.documents.where("lang = 'es'").select("doc_id", "n_chars"), "doc_id").select(F.col("doc_id").alias("candidate_id"), "status", rank.alias("rank"))
    return O.reserve_slot(base, pool, 5)


#: A component under 0.0004 counts as not measured.
MEASURED = "list_transform(embedding, lambda x: CASE WHEN abs(x) >= 0.0004 THEN CAST(x AS DOUBLE) END)"
LEAD = f"""r AS (SELECT label, vec_id, {MEASURED} AS v, len(list_filter({MEASURED}, lambda x: x IS NULL)) = 0 AS known,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM {{embeddings}}),
g(label, n, vec_id, leads, leader, unsure) AS (
  SELECT DISTINCT label, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS STRUCT(id BIGINT, v DOUBLE[], known BOOLEAN)[]), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]) FROM r
  UNION ALL
  SELECT label, n, vec_id, CASE WHEN joined IS NULL THEN list_append(leads, {{'id': vec_id, 'v': v, 'known': known}}) ELSE leads END, coalesce(joined, vec_id),
    list_transform(list_filter(near, lambda l: NOT (l.known AND known) AND (joined IS NULL OR l.id < joined)), lambda l: l.id)
  FROM (SELECT *, list_filter(near, lambda l: l.known AND known)[1].id AS joined FROM (
    SELECT r.*, g.leads, list_filter(g.leads, lambda l: len(list_filter(list_zip(l.v, r.v), lambda z: abs(z[1] - z[2]) > 0.35)) = 0) AS near
    FROM g JOIN r ON r.label = g.label AND r.n = g.n + 1)))"""


def led(t):
    measured = F.transform("embedding", lambda x: F.when(F.abs(x) >= 0.0004, x.cast("double")))
    return leaders.leader_groups(t.embeddings.select("label", "vec_id", measured.alias("v")), "label", "vec_id", "v", 0.35)


@query(f"WITH RECURSIVE {LEAD} SELECT vec_id, leader FROM g WHERE n > 0")
def leader_groups(t):
    return led(t)[0]


@query(f"WITH RECURSIVE {LEAD} SELECT unnest(unsure) AS leader, vec_id FROM g WHERE n > 0")
def ambiguous_pairs(t):
    return led(t)[1]


@query("""SELECT lang, count(*) AS raw, count(CASE WHEN n_chars >= 50 THEN 1 END) AS parsed, count(DISTINCT CASE WHEN n_chars >= 50 THEN text END) AS exact_unique, count(CASE WHEN n_chars BETWEEN 50 AND 5000 THEN 1 END) AS within_limits FROM {documents} GROUP BY 1""")
def funnel(t):
    ok = F.col("n_chars") >= 50
    return t.documents.groupBy("lang").agg(F.count("*").alias("raw"), F.count_if(ok).alias("parsed"), F.countDistinct(F.when(ok, F.sha2("text", 256))).alias("exact_unique"), F.count_if(ok & (F.col("n_chars") <= 5000)).alias("within_limits"))


RELATION = """CASE WHEN v <= 0.03 AND l <= 0.02 AND g <= 1 THEN 'strict' WHEN l <= 0.2 AND g <= 5 AND v <= 0.03 THEN 'ambiguous' WHEN l <= 0.2 AND g <= 5 THEN 'scaled' ELSE 'distinct' END"""
PAIRS = """{part} a JOIN {part} b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey,
LATERAL (SELECT abs(a.p_retailprice - b.p_retailprice) / ((a.p_retailprice + b.p_retailprice) / 2) AS v, abs(a.p_size - b.p_size) / 50.0 AS l, CAST(abs(a.p_size - b.p_size) AS DOUBLE) AS g) x"""


NEAR_BLOCK = 2048  # rows of one brand, type and size that a task meets with


def near_pairs(items, key, *more):
    """Pairs of items (p_brand, p_type, p_size, p_retailprice and more) of one brand and type that aren't distinct.

    An angle gap of at most 5 bounds them, so an item meets the items of its own size, if their keys are
    greater, and of the next five; each pair is made once. A size with many items is met in blocks.
    """
    cell = ["p_brand", "p_type", "p_size"]
    blocks = items.groupBy(*cell).agg(F.ceil(F.count("*") / F.lit(NEAR_BLOCK)).cast("int").alias("_blocks"))
    side = lambda n: [key.alias(n), F.col("p_retailprice").alias(f"v{n}"), *[F.col(c).alias(f"{c}_{n}") for c in more]]
    left = items.select("p_brand", "p_type", F.col("p_size").alias("_size"), *side("a")).withColumn("p_size", F.explode(F.sequence("_size", F.col("_size") + 5))).join(blocks, cell)
    left = left.withColumn("_block", F.pmod(F.xxhash64("a"), F.col("_blocks")).cast("int")).drop("_blocks")
    right = items.join(blocks, cell).select(*cell, *side("b"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    parts, on = 8 * items.sparkSession.sparkContext.defaultParallelism, [*cell, "_block"]
    pairs = left.repartition(parts, *on).join(right.repartition(parts, *on), on).where((F.col("_size") < F.col("p_size")) | (F.col("a") < F.col("b")))
    gap = F.col("p_size") - F.col("_size")
    return pairs.withColumn("relation", related(F.col("va"), F.col("vb"), gap)).where("relation <> 'distinct'")


def related(one, other, gap):
    """Relation of two parts by their prices as volumes and the gap of their sizes as that of lattice and angle."""
    return O.pair_relation(F.abs(one - other) / ((one + other) / 2), gap / 50.0, gap.cast("double"))


@query(f"SELECT a.p_partkey AS a, b.p_partkey AS b, {RELATION} AS relation FROM {PAIRS} WHERE {RELATION} <> 'distinct'")
def pair_relation(t):
    return near_pairs(t.part, F.col("p_partkey")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "relation")


@query(f"SELECT a.p_brand, a.p_type, {RELATION} AS relation, count(*) AS n_pairs FROM {PAIRS} GROUP BY 1, 2, 3")
def pair_counts(t):
    """All pairs of a brand and type by relation, from counts of parts of one size and price; distinct pairs are counted, not made."""
    by = ["p_brand", "p_type"]
    parts = t.part.dropna(subset=by)
    classes = parts.groupBy(*by, "p_size", "p_retailprice").agg(F.count("*").alias("n"))
    # A struct orders a missing price too.
    across = near_pairs(classes, F.struct("p_retailprice"), "n").select(*by, "relation", (F.col("n_a") * F.col("n_b")).alias("n"))
    price = F.col("p_retailprice")
    within = classes.where("n > 1").select(*by, related(price, price, F.col("p_size") - F.col("p_size")).alias("relation"), F.expr("n * (n - 1) div 2").alias("n")).where("relation <> 'distinct'")
    near = across.unionByName(within).groupBy(*by, "relation").agg(F.sum("n").alias("n_pairs"))
    of = near.groupBy(*by).agg(F.sum("n_pairs").alias("near"))
    every = parts.groupBy(*by).agg(F.expr("count(*) * (count(*) - 1) div 2").alias("n"))
    far = every.join(of, by, "left").select(*by, F.lit("distinct").alias("relation"), (F.col("n") - F.coalesce("near", F.lit(0))).alias("n_pairs"))
    return near.unionByName(far.where("n_pairs > 0"))


#: Parts as cells, by extremes and counts of their lines; parts of the largest size lack an angle, small ones share all.
CELLS = """SELECT p_partkey AS cell_id, p_brand AS formula, floor(p_retailprice / 100) AS a, 5 + floor(max(l_discount) * 100 + 0.5) AS b,
  5 + min(l_quantity) AS c, CASE WHEN p_size < 48 THEN 60 + floor(max(l_tax) * 500 + 0.5) END AS alpha, 60 + floor(min(l_tax) * 500 + 0.5) AS beta,
  90 + floor(min(l_discount) * 100 + 0.5) AS gamma, floor(p_retailprice / 100) * 10 * (5 + min(l_quantity)) / 4 AS volume
FROM {part} JOIN {lineitem} ON l_partkey = p_partkey GROUP BY p_partkey, p_brand, p_retailprice, p_size"""
SAME = " AND ".join(f"x.{c} IS NOT DISTINCT FROM y.{c}" for c in ("formula", *lattice.PARAMETERS))


@query(f"""WITH cells AS ({CELLS}), named AS (SELECT x.*, (SELECT min(y.cell_id) FROM cells y WHERE {SAME}) AS class FROM cells x),
pairs AS (SELECT least(l.class, r.class) AS "left", greatest(l.class, r.class) AS "right", {lattice.relation_sql("l.", "r.")} AS relation
  FROM named l JOIN named r ON l.formula = r.formula AND l.cell_id < r.cell_id)
SELECT "left", "right", relation, count(*) AS n_pairs FROM pairs WHERE relation <> 'distinct' GROUP BY ALL""")
def lattice_relation(t):
    """Related pairs of parts of a brand by six lattice parameters and the volume of an atom."""
    cells = t.spark.sql(CELLS, part=t.part, lineitem=t.lineitem)
    return lattice.near_lattices(cells, "cell_id", "formula")[1]


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 45 THEN 'size:too_many_atoms' WHEN l_returnflag = 'R' THEN 'domain:element_not_allowed' WHEN l_discount > 0.08 THEN 'condition:system_mismatch' END AS rejection FROM {lineitem}""")
def output_contract(t):
    why = F.when(F.col("l_quantity") > 45, "size:too_many_atoms").when(F.col("l_returnflag") == "R", "domain:element_not_allowed").when(F.col("l_discount") > 0.08, "condition:system_mismatch")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", why.alias("rejection"))
