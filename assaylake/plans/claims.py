"""Claims and their sources over documents, parts and labels: cases by number, so that the SQL says what each must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import rules as R
from assaylake.functions import scalars as S
from assaylake.operators import claims as O
from assaylake.plans.registry import query

SENTENCE = "LiFePO4 was prepared at 450 K in air."


def case(column: str, n: int, *values):
    """The value of a number's remainder: cases beyond the values take the last."""
    rest = F.col(column) % n
    out = F.lit(values[-1]) if not isinstance(values[-1], list) else F.array(*map(F.lit, values[-1]))
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(rest == i, F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v))).otherwise(out)
    return out


@query("""SELECT doc_id AS claim_id, text IS NOT NULL AND doc_id % 8 IN (0, 5) AS grounded FROM {documents}""")
def grounded_claims(t):
    """Claims on each document with a synthesis sentence added; cases 0 and 5 are grounded, each other breaks one rule."""
    records = t.documents.select(F.col("doc_id").alias("record_id"), F.concat("text", F.lit(f"\n{SENTENCE}")).alias("abstract"))
    claims = t.documents.select(
        F.col("doc_id").alias("claim_id"), F.col("doc_id").alias("record_id"),
        case("doc_id", 8, "supports", "uncertain", "supports").alias("polarity"),
        F.when(F.col("doc_id") % 8 == 2, "LiFePO4 was never prepared at 450 K.").when(F.col("doc_id") % 8 == 0, "LiFePO4  was prepared\nat 450 K").otherwise(SENTENCE).alias("support_text"),
        case("doc_id", 8, "successful_target", "successful_target", "successful_target", "failed_no_target", "successful_target", "Successful_Target ", "successful_target", "melted").alias("outcome"),
        case("doc_id", 8, ["LiFePO4"], ["LiFePO4"], ["LiFePO4"], ["LiFePO4"], ["NaCl", " "], ["Li-O"], ["LiFePO4"]).alias("compositions"),
        case("doc_id", 8, ["450", "2 h"], ["450"], ["450"], ["450"], ["450"], ["in air"], ["900", " "], ["450"]).alias("conditions"),
    )
    return O.grounded_claims(claims, records).select("claim_id", "grounded")


@query("""SELECT doc_id AS record_id, CASE doc_id % 8 WHEN 0 THEN 'Fe2O3' WHEN 1 THEN 'Fe-O' WHEN 2 THEN 'Fe2O3' END AS subject,
       CASE doc_id % 8 WHEN 0 THEN 'was_explicitly_synthesized_under' WHEN 1 THEN 'was_not_obtained_under' WHEN 2 THEN 'has_reported_synthesis_window' END AS predicate,
       CASE doc_id % 8 WHEN 0 THEN 'supports' WHEN 1 THEN 'contradicts' WHEN 2 THEN 'supports' END AS claim_polarity,
       CASE doc_id % 8 WHEN 3 THEN 'unknown_record_type' WHEN 4 THEN 'outcome_differs' WHEN 5 THEN 'composition_missing' WHEN 6 THEN 'conditions_missing' WHEN 7 THEN 'polarity_differs' END AS reason
FROM {documents}""")
def structured_claims(t):
    k = "doc_id"
    rows = t.documents.select(
        F.col(k).alias("record_id"), F.col("source").alias("title"),
        case(k, 8, "synthesis_success", "synthesis_failure", "composition_window", "review", "synthesis_success").alias("record_type"),
        case(k, 8, " Success", "failed", "window", "success", "partial", "successful_target").alias("outcome"),
        case(k, 8, "positive", "Negative", "", "supports", "", "", "", "contradicts").alias("polarity"),
        case(k, 8, "Fe2O3", " ", "Fe2O3", "Fe2O3", "Fe2O3", "", "Fe2O3").alias("composition"),
        case(k, 8, "Fe-O", "Fe-O", "", "", "", " ", "").alias("chemical_system"),
        (F.col(k) % 8 != 6).alias("has_conditions"),
    )
    return O.structured_claims(rows)


@query(r"""WITH names AS (SELECT item_id AS candidate_id, lower(trim(split_part(text, ' ', 1) || CASE WHEN item_id % 3 = 0 THEN '' ELSE ' ' || split_part(text, ' ', 2) END)) AS name FROM {benchmark}),
texts AS (SELECT doc_id AS claim_id, lower(text) AS text FROM {documents})
SELECT DISTINCT candidate_id, claim_id FROM names JOIN texts ON contains(text, name)
AND regexp_matches(text, '(^|[^a-z0-9])' || regexp_replace(name, '([.^$|?*+()])', '\\\1', 'g') || '([^a-z0-9]|$)') WHERE length(name) >= 2 AND regexp_matches(name, '[a-z0-9]')""")
def candidate_mentions(t):
    """Documents that hold the first word, or the first two words, of a benchmark passage."""
    words = F.split("text", " ")
    name = F.concat(words[0], F.when(F.col("item_id") % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.coalesce(F.get(words, F.lit(1)), F.lit("")))))
    return O.candidate_mentions(t.benchmark.select(F.col("item_id").alias("candidate_id"), name.alias("name")), t.documents.select(F.col("doc_id").alias("claim_id"), "text"))


@query("""WITH c AS (SELECT p_brand, p_partkey % 3 AS k, p_size FROM {part})
SELECT p_brand, array_to_string(list_sort(list_distinct(flatten(list(CASE k WHEN 0 THEN ['Fe', 'O'] WHEN 1 THEN ['K', 'Li', 'O'] ELSE ['Na'] END)))), ',') AS elements,
       coalesce(array_to_string(list_sort(list_distinct(list(CASE k WHEN 0 THEN 'Fe-O' WHEN 1 THEN 'Li-O' END) FILTER (k < 2))), ','), '') AS systems,
       CASE WHEN count(DISTINCT CASE WHEN k < 2 THEN k END) = 1 THEN CASE max(CASE WHEN k < 2 THEN k END) WHEN 0 THEN 'Fe-O' ELSE 'Li-O' END END AS chemical_system,
       coalesce(array_to_string(list_sort(list_distinct(list('Mg') FILTER (k = 2))), ','), '') AS dopants,
       coalesce(array_to_string(list_sort(list_distinct(list(p_size + 0.5) FILTER (k = 0))), ','), '') AS pressures,
       coalesce(array_to_string(list_sort(list_distinct(list(CAST(CASE k WHEN 1 THEN p_size ELSE 300 END AS DOUBLE)) FILTER (k > 0))), ','), '') AS temperatures
FROM c GROUP BY p_brand""")
def material_hints(t):
    """Three kinds of claims a part; what texts say of pressure and temperature counts like the qualifiers."""
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    claims = t.part.select(
        "p_brand",
        F.when(k == 0, F.concat(F.lit("Fe2O3 at "), size, F.lit(".5 gpa"))).when(k == 1, F.concat(F.lit("heated to "), size, F.lit(" K, not 7 k"))).otherwise("pure Na").alias("subject"),
        F.lit("a study").alias("object"),
        F.when(k == 1, F.array(F.lit("LiFePO4"), F.lit(None).cast("string"))).alias("formulas"),
        F.when(k == 2, " Mg ").otherwise(" ").alias("dopant"),
        F.lit(None).cast("double").alias("pressure_gpa"), F.when(k == 2, 300.0).alias("temperature_k"),
    )
    out = O.material_hints(claims, "p_brand")
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("p_brand", text("elements"), text("systems"), "chemical_system", text("dopants"), text("pressures"), text("temperatures"))


@query("""SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_name)), ',') AS seed_entities,
       array_to_string(CASE WHEN bool_or(p_partkey % 40 = 0) THEN ['kinase'] ELSE list_sort(list(DISTINCT p_type)) END, ',') AS target_contexts,
       array_to_string(list_sort(list_distinct(list_concat(list('inhibits'), coalesce(list('binds') FILTER (p_partkey % 5 = 0), [])))), ',') AS mechanisms,
       coalesce(array_to_string(list_sort(list(DISTINCT 'C' || CAST(p_size AS VARCHAR)) FILTER (p_size % 10 = 0)), ','), '') AS scaffolds FROM {part} GROUP BY 1""")
def medicinal_hints(t):
    some = lambda cond, v: F.when(cond, v).otherwise(F.lit(" "))
    claims = t.part.select(
        "p_brand", F.col("p_name").alias("subject"), F.lit("inhibits").alias("predicate"), F.col("p_type").alias("object"),
        some(F.col("p_partkey") % 40 == 0, F.lit("kinase")).alias("target"), some(F.col("p_partkey") % 5 == 0, F.lit("binds")).alias("mechanism"),
        F.when(F.col("p_size") % 10 == 0, F.concat(F.lit("C"), F.col("p_size").cast("string"))).alias("scaffold"),
    )
    out = O.medicinal_hints(claims, "p_brand")
    return out.select("p_brand", *[F.array_join(c, ",").alias(c) for c in ("seed_entities", "target_contexts", "mechanisms", "scaffolds")])


@query("""SELECT doc_id AS preference_id, doc_id AS provenance_id FROM {documents} d WHERE doc_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM {b_claim} c WHERE c.claim_id = d.doc_id AND c.polarity = 'supports')""")
def unsupported_preferences(t):
    source = F.when(F.col("doc_id") % 3 == 0, "source_closed_spec").otherwise("operator")
    wishes = t.documents.select(F.col("doc_id").alias("preference_id"), F.col("doc_id").alias("provenance_id"), source.alias("source"))
    return O.unsupported_preferences(wishes, t.b_claim).select("preference_id", "provenance_id")


@query("""WITH s AS (SELECT DISTINCT source AS stage FROM {documents}),
n AS (SELECT source AS stage, count(*) AS n_records, count(DISTINCT lang) AS n_branches FROM {documents} WHERE n_chars >= 200 GROUP BY 1),
c AS (SELECT subject AS stage, count(*) AS n_claims FROM {b_claim} WHERE polarity = 'supports' GROUP BY 1),
m AS (SELECT stage, string_agg(lang, ',' ORDER BY lang) AS missing FROM (SELECT stage, unnest(['de', 'en', 'es', 'fr', 'it']) AS lang FROM s) w
      WHERE NOT EXISTS (SELECT 1 FROM {documents} d WHERE d.source = w.stage AND d.lang = w.lang) GROUP BY 1)
SELECT s.stage, coalesce(n_records, 0) AS n_records, coalesce(n_claims, 0) AS n_claims, coalesce(n_branches, 0) AS n_branches, coalesce(missing, '') AS missing_intents,
       right(s.stage, 1) IN ('0', '2', '4', '6', '8') AND right(s.stage, 1) <> '4' AND coalesce(n_branches, 0) > 0 AS can_steer_generation
FROM s LEFT JOIN n USING (stage) LEFT JOIN c USING (stage) LEFT JOIN m USING (stage)""")
def stage_report(t):
    end = F.right("stage", F.lit(1))
    docs = t.documents.withColumnRenamed("source", "stage")
    stages = docs.select("stage").distinct().where("stage is not null").select("stage", end.isin(*"02468").alias("can_steer"), (end != "4").alias("evidence_available"))
    asked = stages.select("stage", F.explode(F.array(*map(F.lit, ("de", "en", "es", "fr", "it")))).alias("intent_id"))
    found = docs.groupBy("stage", F.col("lang").alias("intent_id")).agg(F.count("*").alias("n"))
    intents = asked.join(found, ["stage", "intent_id"], "left").withColumn("n_records", F.coalesce("n", F.lit(0)))
    long = docs.where("n_chars >= 200")
    claims = t.b_claim.where("polarity = 'supports'").withColumnRenamed("subject", "stage")
    out = O.stage_report(stages, long, claims, long.select("stage", "lang").distinct(), intents)
    return out.withColumn("missing_intents", F.array_join("missing_intents", ","))


@query(r"""WITH w AS (SELECT doc_id, doc_id % 6 AS k, text FROM {documents})
SELECT doc_id, CASE k WHEN 0 THEN 'true' WHEN 1 THEN 'true' WHEN 2 THEN 'false' WHEN 3 THEN 'true' WHEN 4 THEN 'false' ELSE 'false' END AS supported,
       CASE k WHEN 0 THEN 'New York' WHEN 3 THEN 'Fe-Ni Alloy X2' END AS entity FROM w""")
def literal_support(t):
    k = F.col("doc_id") % 6
    text = case("doc_id", 6, "in New York at 300 K", "about 2.5 of it", "at 1300 of it", "the Fe-Ni Alloy X2 was heated", "nothing", "at 300.5 of it")
    rows = t.documents.select("doc_id", text.alias("text"), k.alias("k"))
    number = R.number_supported(F.when(F.col("k") == 1, 2.5).otherwise(300.0), F.col("text"))
    found = F.when(F.col("k") == 3, R.any_supported(F.array(F.lit(" "), F.lit("ALLOY  x2")), F.col("text"))).otherwise(number)
    return rows.select("doc_id", found.cast("string").alias("supported"), R.first_entity(F.col("text")).alias("entity"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'api_key' WHEN 2 THEN 'db_password;x_bearer_y' ELSE '' END AS secrets FROM {events}""")
def secret_keys(t):
    """Keys that name a secret, at any depth of the events' properties and what is put beside them."""
    more = case("event_id", 4, '{"note": "token\\": 1"}', '{"a": [{"API-Key": "x"}]}', '{"b": {"db password": 1, "X-Bearer.Y": {}}}', '{"a": "my token", "b": ["secret"]}')
    document = F.concat(F.lit('{"props": '), F.coalesce("props", F.lit("null")), F.lit(', "more": '), more, F.lit("}"))
    return t.events.select("event_id", S.joined(R.secret_keys(document)).alias("secrets"))
