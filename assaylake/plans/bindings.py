"""Views that bind the star-schema tables to the entities of the evidence operators.

The same SELECT text serves Spark and DuckDB. Names in braces are tables or other views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "b_prediction": """
SELECT l_partkey AS candidate_id, CASE WHEN l_suppkey % 2 = 0 THEN 'e0' ELSE 'e1' END AS expert_id,
       floor(avg(l_extendedprice / l_quantity) * 10000 + 0.5) / 10000 AS energy,
       max(l_discount) AS max_force, floor(avg(l_tax) * 1000000 + 0.5) / 1000000 AS stress
FROM {lineitem} GROUP BY 1, 2""",
    "b_screening": """
SELECT p.p_partkey AS candidate_id, p.p_brand AS composition_key, a.energy AS e0_energy, b.energy AS e1_energy,
       a.max_force AS e0_force, b.max_force AS e1_force, a.stress AS e0_stress, b.stress AS e1_stress
FROM {part} p JOIN {b_prediction} a ON a.candidate_id = p.p_partkey AND a.expert_id = 'e0'
            JOIN {b_prediction} b ON b.candidate_id = p.p_partkey AND b.expert_id = 'e1'""",
    "b_property": """
SELECT candidate_id, expert_id, 'energy' AS property_name, energy AS value, 'eV' AS unit FROM {b_prediction}
UNION ALL SELECT candidate_id, expert_id, 'max_force', max_force, 'eV/A' FROM {b_prediction}
UNION ALL SELECT candidate_id, expert_id, 'stress', stress, CASE WHEN candidate_id % 50 = 0 AND expert_id = 'e1' THEN 'kbar' ELSE 'GPa' END FROM {b_prediction}""",
    "b_observation": """
SELECT l_orderkey, l_linenumber, l_partkey AS candidate_id, p_type AS role_id,
       l_returnflag AS validator_id, l_linestatus AS unit, CAST(year(l_shipdate) AS BIGINT) AS cond_year,
       floor(l_extendedprice / l_quantity * 10000 + 0.5) / 10000 AS value,
       floor(l_extendedprice / l_quantity * (CAST(1 AS DOUBLE) - l_discount) * 10000 + 0.5) / 10000 AS lower_bound,
       floor(l_extendedprice / l_quantity * (CAST(1 AS DOUBLE) + l_tax) * 10000 + 0.5) / 10000 AS upper_bound
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey""",
    "b_case": "SELECT l_orderkey AS candidate_id, role_id, validator_id, cond_year, value, lower_bound, upper_bound FROM {b_observation}",
    "b_calibration": """
SELECT o_orderpriority AS scope_id, o_orderkey AS sample_id,
       floor(abs(o_totalprice - net) / o_totalprice * 1000000 + 0.5) / 1000000 AS score
FROM {orders} JOIN (SELECT l_orderkey, sum(l_extendedprice * (CAST(1 AS DOUBLE) - l_discount)) AS net
                  FROM {lineitem} GROUP BY l_orderkey) n ON n.l_orderkey = o_orderkey""",
    "b_record": """
SELECT doc_id AS record_id, source AS provider, lang, lower(trim(split_part(text, chr(10), 1))) AS title, text AS abstract,
       CAST(2000 + doc_id % 20 AS INT) AS publication_year
FROM {documents}""",
    "b_claim": """
SELECT d.doc_id AS claim_id, d.source AS subject, 'reported_in' AS predicate, d.lang AS object,
       CASE WHEN l.doc_id IS NULL THEN 'uncertain' WHEN l.toxic = 1 THEN 'contradicts'
            WHEN l.quality = 1 THEN 'supports' ELSE 'null' END AS polarity, d.n_chars AS n_chars
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id""",
    "b_scheduler_obs": """
SELECT user_id AS branch_id, event_id, ts,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS round_index,
       CASE WHEN event_type = 'purchase' THEN value WHEN event_type = 'signup' THEN -value
            ELSE CAST(0 AS DOUBLE) END AS objective_improvement,
       CASE WHEN event_type = 'error' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS structural_collapse_rate
FROM {events}""",
    "b_pair": """
SELECT o_custkey AS pair_id, CASE WHEN o_orderkey % 2 = 0 THEN 'off' ELSE 'on' END AS arm,
       CAST(row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS pair_slot,
       o_orderkey AS candidate_id, o_totalprice AS value, o_orderpriority AS config
FROM {orders}""",
    "b_evidence_record": """
SELECT o_orderkey AS evidence_id, o_custkey AS candidate_id, o_orderpriority AS method_class,
       CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'partial' ELSE 'failed' END AS status,
       CAST(year(o_orderdate) AS BIGINT) AS source_id, o_totalprice AS value, o_totalprice > 200000 AS meets_criterion
FROM {orders}""",
}


def _used(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, or a binding view over its tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in _used(VIEWS[name])})


def duck(sql: str) -> str:
    """A query over {names} as DuckDB SQL, with the views that it needs in front."""
    needed: list[str] = []

    def need(text: str) -> None:
        for n in _used(text):
            if n in VIEWS and n not in needed:
                need(VIEWS[n])
                needed.append(n)

    need(sql)
    bare = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    views = ",\n".join(f"{n} AS ({bare(VIEWS[n])})" for n in needed)
    body = bare(sql).strip()
    if not views:
        return body
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return f"{head}{views},\n{body[len(head):]}"
    return f"WITH {views}\n{body}"
