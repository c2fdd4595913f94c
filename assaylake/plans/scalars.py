"""Remaining scalar functions over the tables: units, formulas, variants, dates, identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import scalars as S
from assaylake.operators import chemistry as C
from assaylake.plans.registry import query

UNIT = "CASE l_linenumber % 5 WHEN 0 THEN 'nm' WHEN 1 THEN 'pm' WHEN 2 THEN ' Bohr ' WHEN 3 THEN 'furlong' END"
FACTOR = "CASE l_linenumber % 5 WHEN 0 THEN 10.0 WHEN 1 THEN 0.01 WHEN 2 THEN 0.529177210903 END"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, floor(l_quantity * {FACTOR} * 10000 + 0.5) / 10000 AS angstrom, CASE WHEN {FACTOR} IS NULL THEN 'unit_unknown' END AS reason FROM {{lineitem}}")
def unit_convert(t):
    factor = S.unit_factor(F.expr(UNIT), S.LENGTH_UNITS)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", S.rounded(F.col("l_quantity") * factor).alias("angstrom"), F.when(factor.isNull(), "unit_unknown").alias("reason"))


@query("""WITH f AS (SELECT p_partkey, p_size AS a, p_partkey % 4 + 1 AS b, p_partkey % 10 AS k FROM {part})
SELECT p_partkey, CASE k WHEN 0 THEN 'unbalanced_brackets' WHEN 1 THEN 'unknown_element' WHEN 2 THEN 'misplaced_or_zero_amount' WHEN 3 THEN 'unknown_character' END AS error,
       CASE WHEN k > 3 THEN 'H,O,Fe' END AS elements,
       CASE WHEN k > 3 THEN CAST(a + 2 * b AS DOUBLE) END AS oxygen, CASE WHEN k > 3 THEN CAST(b AS DOUBLE) END AS iron,
       CASE WHEN k > 3 THEN 'Fe-H-O' END AS chemical_system,
       CASE WHEN k > 3 THEN (SELECT string_agg(e || CASE WHEN n // g = 1 THEN '' ELSE CAST(n // g AS VARCHAR) END, '' ORDER BY e)
                             FROM (SELECT gcd(gcd(2, CAST(b AS BIGINT)), CAST(a + 2 * b AS BIGINT)) AS g) d,
                                  (SELECT unnest(['Fe', 'H', 'O']) AS e, unnest([CAST(b AS BIGINT), 2, CAST(a + 2 * b AS BIGINT)]) AS n) m) END AS reduced
FROM f""")
def formula_elements(t):
    """Formulas O<size>(FeO2)<b>H2, a tenth each with an open bracket, no element, a zero amount and another sign."""
    b = (F.col("p_partkey") % 4 + 1).cast("string")
    kind = F.col("p_partkey") % 10
    tail = F.when(kind == 0, "").when(kind == 1, "Xx)").when(kind == 2, "0)").when(kind == 3, "-)").otherwise(")")
    text = F.concat(F.lit("O"), F.col("p_size").cast("string"), F.lit("(FeO2"), tail, b, F.lit("H2"))
    text = F.when(kind == 2, F.concat(F.lit("O0"), text)).otherwise(text)
    out = C.formula_elements(t.part.withColumn("formula", text), "p_partkey", "formula")
    counts = F.col("counts")
    return out.select(
        "p_partkey", "error", F.array_join(F.map_keys(counts), ",").alias("elements"), counts["O"].alias("oxygen"), counts["Fe"].alias("iron"),
        C.chemical_system(F.map_keys(counts), 2).alias("chemical_system"), C.reduced_formula(counts).alias("reduced"),
    )


@query("""WITH p AS (SELECT a.vec_id, a.label, list_zip(a.embedding, b.embedding) AS z FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = a.vec_id + 1), d AS (SELECT vec_id, label, list_sum(list_transform(z, lambda x: abs(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)))) / 64 AS delta FROM p)
SELECT vec_id, floor(delta * 10000 + 0.5) / 10000 AS delta, floor((delta * (1 - 0.5 * (label / 10.0)) + 0.2 * 0.5 - 0.1 * (vec_id % 3)) * 10000 + 0.5) / 10000 AS priority FROM d""")
def variant_rank(t):
    track = F.transform("embedding", lambda x: x.cast("double"))
    rows = t.embeddings.select("vec_id", "label", track.alias("r"))
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("r").alias("a")), "vec_id").withColumn("delta", S.track_delta(F.col("r"), F.col("a")))
    priority = S.variant_priority(F.array("delta", F.lit(None).cast("double")), F.col("label") / 10.0, F.lit(0.5), (F.col("vec_id") % 3).cast("double"))
    return pairs.select("vec_id", S.rounded(F.col("delta")).alias("delta"), S.rounded(priority).alias("priority"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-01') ELSE strftime(o_orderdate, '%Y-01-01') END AS parsed FROM {orders}""")
def partial_dates(t):
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy-MM")).when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyy")).otherwise(F.concat(F.lit("in "), F.date_format("o_orderdate", "yyyy"), F.lit(" or so")))
    return t.orders.select("o_orderkey", F.date_format(S.partial_date(text), "yyyy-MM-dd").alias("parsed"))


@query("""SELECT o_orderkey, '10.1000/ab' || CAST(o_orderkey AS VARCHAR) AS doi FROM {orders}""")
def doi_normal(t):
    prefix = F.get(F.array(*map(F.lit, ("https://doi.org/", "doi: ", " http://dx.doi.org/", ""))), (F.col("o_orderkey") % 4).cast("int"))
    return t.orders.select("o_orderkey", S.normal_doi(F.concat(prefix, F.lit("10.1000/AB"), F.col("o_orderkey").cast("string"))).alias("doi"))


# Property names and the direction that each suggests.
NAMES = {"Ionic_Conductivity": "maximize", "energy_above_hull": "minimize", "formation_energy": "user_defined", "zt": "maximize", "max_force": "minimize", "yield_loss": "maximize", "stress": "user_defined", "contact resistance": "minimize"}


@query(f"""SELECT p_partkey, [{", ".join(f"'{d}'" for d in NAMES.values())}][CAST(p_partkey % {len(NAMES)} AS BIGINT) + 1] AS direction,
       CAST(CAST(p_size AS BIGINT) AS VARCHAR) AS canonical, p_type IS NULL OR trim(p_type) = '' AS missing FROM {{part}}""")
def text_rules(t):
    name = F.get(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % len(NAMES)).cast("int"))
    return t.part.select("p_partkey", S.direction_of(name).alias("direction"), S.canonical_number(F.col("p_size").cast("double").cast("string")).alias("canonical"), S.is_missing(F.col("p_type")).alias("missing"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(lower(CASE WHEN text IS NOT NULL THEN 'A-b__C  ' || source || '!d' END), '[\s_-]+', ' ', 'g'))) AS routed, md5('a-b__c ' || lower(source) || '!d') AS spaced, md5('a b__c ' || lower(source) || ' d') AS worded FROM {documents}""".replace("\\\\", "\\"))
def text_forms(t):
    raw = F.concat(F.lit("A-b__C  "), F.col("source"), F.lit("!d"))
    rows = t.documents.select("doc_id", F.when(F.col("text").isNotNull(), raw).alias("r"), raw.alias("raw"))
    return rows.select("doc_id", F.md5(S.routing_text(F.col("r"))).alias("routed"), F.md5(S.spaced_text(F.col("raw"))).alias("spaced"), F.md5(S.word_text(F.col("raw"))).alias("worded"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, floor(l_quantity * CASE l_linenumber % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.1 WHEN 2 THEN 0.001 END * 10000 + 0.5) / 10000 AS gigapascal,
       floor(l_quantity * CASE l_linenumber % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.001 END * 10000 + 0.5) / 10000 AS ev_atom FROM {lineitem}""")
def stress_energy_units(t):
    stress = S.unit_factor(F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'GPa' WHEN 1 THEN ' kbar' WHEN 2 THEN 'MPa' ELSE 'psi' END"), S.STRESS_UNITS)
    energy = S.unit_factor(F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'eV/atom' WHEN 1 THEN 'meV/atom' ELSE 'eV' END"), S.ENERGY_UNITS)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", S.rounded(F.col("l_quantity") * stress).alias("gigapascal"), S.rounded(F.col("l_quantity") * energy).alias("ev_atom"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ACGTNN' WHEN 1 THEN 'ACGT' END AS sequence, p_partkey % 3 <> 0 AS empty_list FROM {part}""")
def fasta_check(t):
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, ">one\nacgt\nNN\n").when(k == 1, "ac gt").when(k == 2, ">a\nACGT\n>b\nACGT").otherwise("ACGU1")
    items = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit(1))).when(F.col("p_partkey") % 3 == 1, F.array().cast("array<int>"))
    return t.part.select("p_partkey", S.fasta_sequence(text, "ACGTN").alias("sequence"), S.is_empty(items).alias("empty_list"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN floor(sqrt(14.0 * p_size * p_size) * 10000 + 0.5) / 10000 END AS stress, CASE WHEN p_partkey % 5 <> 0 THEN floor(sqrt(3.0) * p_size * 10000 + 0.5) / 10000 END AS lattice FROM {part}""")
def structure_checks(t):
    n, zero = F.col("p_size").cast("double"), F.lit(0.0)
    stated = F.when(F.col("p_partkey") % 2 == 0, F.sqrt(14 * n * n)).otherwise(F.sqrt(14 * n * n) + 1e-6 * (1 + n))
    cube = lambda e: F.array(F.array(e, zero, zero), F.array(zero, e, zero), F.array(zero, zero, e))
    other = F.when(F.col("p_partkey") % 5 == 0, F.array(F.array(n, zero, zero))).otherwise(cube(2 * n))
    return t.part.select("p_partkey", S.rounded(S.checked_stress(stated, n, 2 * n, 3 * n, zero, zero, zero)).alias("stress"), S.rounded(S.lattice_distance(cube(n), other)).alias("lattice"))
