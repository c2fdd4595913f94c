"""Claims against their sources: grounding in the text, structured records, mentions of candidates, hints, preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions import rules as R
from assaylake.functions.sizes import few

# Outcomes of a synthesis with the words that tell them, outcomes of the record types, other names of
# outcomes, and the predicate of each outcome.
OUTCOME_TERMS = {
    "successful_target": ["synthes", "prepared", "obtained", "formed", "characterized", "produced"],
    "impurity_or_partial": ["impurit", "secondary phase", "byproduct", "partial", "yield", "phase purity"],
    "failed_no_target": ["failed", "not obtained", "no crystalline", "amorphous", "decompos", "unsuccessful", "no target"],
    "condition_window": ["temperature", "pressure", "anneal", "atmosphere", "precursor", "time", "solvent", "ph", "range", "window"],
}
RECORD_OUTCOMES = {
    "reported_phase": "successful_target",
    "synthesis_success": "successful_target",
    "synthesis_partial": "impurity_or_partial",
    "synthesis_failure": "failed_no_target",
    "composition_window": "condition_window",
    "synthesis_condition_window": "condition_window",
}
OUTCOME_ALIASES = {
    "success": "successful_target",
    "successful": "successful_target",
    "target_obtained": "successful_target",
    "partial": "impurity_or_partial",
    "impurity": "impurity_or_partial",
    "failure": "failed_no_target",
    "failed": "failed_no_target",
    "no_target": "failed_no_target",
    "window": "condition_window",
}
PREDICATES = {
    "successful_target": "was_explicitly_synthesized_under",
    "impurity_or_partial": "was_partially_obtained_under",
    "failed_no_target": "was_not_obtained_under",
    "condition_window": "has_reported_synthesis_window",
}


def looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), key)


def grounded_claims(claims: DataFrame, records: DataFrame) -> DataFrame:
    """claims with grounded: whether the record itself says what a synthesis claim says.

    The record's abstract holds the support text, the support text holds a word of the outcome, a
    composition (or its elements) and one of the conditions, and the claim isn't uncertain. claims:
    claim_id, record_id, polarity, support_text, outcome, compositions and conditions (arrays of
    text); records: record_id, abstract. A claim of an unknown record isn't grounded.
    """
    sources = records.select("record_id", F.col("abstract").alias("_abstract"))
    support = R.plain_text(F.col("support_text"))
    told = F.lit(False)
    for outcome, terms in OUTCOME_TERMS.items():
        told = told | ((F.lower(F.trim("outcome")) == outcome) & F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(support, t)))
    shown = R.text_elements(F.col("support_text"))
    part = lambda c: (F.size(R.text_elements(c)) > 0) & (F.size(F.array_except(R.text_elements(c), shown)) == 0)
    named = F.exists(F.filter("compositions", lambda c: F.trim(c) != ""), lambda c: F.contains(support, R.plain_text(c)) | part(c))
    inside = F.contains(R.plain_text(F.col("_abstract")), support) & (support != "")
    ok = (F.col("polarity") != "uncertain") & inside & told & named & R.any_supported(F.col("conditions"), F.col("support_text"))
    return claims.join(sources, "record_id", "left").withColumn("grounded", F.coalesce(ok, F.lit(False))).drop("_abstract")


def structured_claims(records: DataFrame) -> DataFrame:
    """Claims of structured synthesis records, with the reason where a record gives none.

    records: record_id, record_type, outcome, polarity, composition, chemical_system, title, has_conditions.
    The outcome must be the record type's, a composition or system and conditions must be there, and a
    stated polarity must agree: only a failure contradicts.
    """
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    raw = F.lower(text(F.col("outcome")))
    outcome = F.coalesce(looked_up(raw, OUTCOME_ALIASES), raw)
    expected = looked_up(F.col("record_type"), RECORD_OUTCOMES)
    subject = F.when(text(F.col("composition")) != "", text(F.col("composition"))).otherwise(text(F.col("chemical_system")))
    against = F.col("_outcome") == "failed_no_target"
    stated = F.lower(text(F.col("polarity")))
    agrees = (stated == "") | F.when(against, stated.isin("contradicts", "null", "negative")).otherwise(stated.isin("supports", "positive"))
    reason = (
        F.when(expected.isNull(), "unknown_record_type")
        .when(F.col("_outcome") != expected, "outcome_differs")
        .when(subject == "", "composition_missing")
        .when(~F.col("has_conditions"), "conditions_missing")
        .when(~agrees, "polarity_differs")
    )
    rows = records.withColumn("_outcome", outcome).withColumn("reason", reason)
    good = F.col("reason").isNull()
    return rows.select("record_id", F.when(good, subject).alias("subject"), F.when(good, looked_up(F.col("_outcome"), PREDICATES)).alias("predicate"), F.when(good, F.when(against, "contradicts").otherwise("supports")).alias("claim_polarity"), "reason")


def mention_tokens(text: Column) -> Column:
    """Distinct runs of letters and digits of a lower-case text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""))


def candidate_mentions(candidates: DataFrame, claims: DataFrame, rare: int = 1) -> DataFrame:
    """(candidate_id, claim_id) where a claim's text holds a candidate's name between other signs than letters and digits.

    candidates: candidate_id, name; claims: claim_id, text. An inverted index instead of all pairs: every
    name is looked up by its rarest token alone, and the claims that hold that token are checked. Names
    under two characters are never linked; a name without a letter or digit of a-z is looked up by none.
    """
    from assaylake.functions.scalars import mentions

    names = candidates.select("candidate_id", F.lower(F.trim("name")).alias("name")).where("length(name) >= 2")
    named = names.select("candidate_id", "name", F.explode(mention_tokens(F.col("name"))).alias("token"))
    wanted = few(named.select("token").distinct(), 100_000)  # tokens of no name aren't shuffled
    index = claims.select("claim_id", F.explode(mention_tokens(F.col("text"))).alias("token")).join(wanted, "token", "left_semi")
    counts = index.groupBy("token").agg(F.count("*").alias("often"))
    tokens = named.join(counts, "token", "left")
    # A token that no claim holds settles the name: it is its rarest, and nothing joins it.
    rarest = tokens.groupBy("candidate_id", "name").agg(F.min_by("token", F.struct(F.coalesce("often", F.lit(0)), "token")).alias("token"))
    found = rarest.join(index, "token").join(claims.select("claim_id", F.lower("text").alias("_text")), "claim_id")
    return found.where(F.contains("_text", "name") & mentions(F.col("_text"), F.col("name"))).select("candidate_id", "claim_id").distinct()


def material_hints(claims: DataFrame, by: str) -> DataFrame:
    """Per bundle what its claims' texts hint at: elements, chemical systems, dopants, pressures and temperatures.

    claims: subject, object, and formulas (array of text), dopant, pressure_gpa, temperature_k. Sets are
    aggregates; a single system is also the chemical_system.
    """
    texts = F.array_compact(F.concat(F.array("subject", "object"), F.coalesce("formulas", F.array().cast("array<string>"))))
    spoken = F.array_compact(F.array("subject", "object"))
    numbers = lambda unit, any_case, own: F.concat(F.flatten(F.transform(spoken, lambda t: R.quantities(t, unit, any_case))), F.array_compact(F.array(own)))
    each = claims.select(
        by,
        F.flatten(F.transform(texts, R.text_elements)).alias("elements"),
        F.array_compact(F.transform(texts, R.text_system)).alias("systems"),
        F.when(F.trim("dopant") != "", F.trim("dopant")).alias("dopant"),
        numbers("GPa", True, F.col("pressure_gpa")).alias("pressures"),
        numbers("K", False, F.col("temperature_k")).alias("temperatures"),
    )
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    out = each.groupBy(by).agg(union("elements"), union("systems"), F.array_sort(F.collect_set("dopant")).alias("dopants"), union("pressures"), union("temperatures"))
    return out.withColumn("chemical_system", F.when(F.size("systems") == 1, F.get("systems", F.lit(0))))


def medicinal_hints(claims: DataFrame, by: str) -> DataFrame:
    """Per bundle seed entities, target contexts (the objects where no target is named), mechanisms and scaffolds.

    claims: subject, predicate, object, target, mechanism, scaffold.
    """
    some = lambda c: F.when(F.trim(c) != "", F.col(c))
    out = claims.groupBy(by).agg(
        F.array_sort(F.collect_set("subject")).alias("seed_entities"),
        F.array_sort(F.collect_set(some("target"))).alias("_targets"), F.array_sort(F.collect_set("object")).alias("_objects"),
        F.array_sort(F.array_union(F.collect_set(some("mechanism")), F.collect_set(some("predicate")))).alias("mechanisms"),
        F.array_sort(F.collect_set(some("scaffold"))).alias("scaffolds"),
    )
    return out.withColumn("target_contexts", F.when(F.size("_targets") > 0, F.col("_targets")).otherwise(F.col("_objects"))).drop("_targets", "_objects")


def unsupported_preferences(preferences: DataFrame, claims: DataFrame) -> DataFrame:
    """Source-closed preferences that cite no supporting claim; none may remain. preferences: source, provenance_id; claims: claim_id, polarity."""
    good = claims.where("polarity = 'supports'").select(F.col("claim_id").alias("provenance_id"))
    return preferences.where("source = 'source_closed_spec'").join(good, "provenance_id", "left_anti")


def stage_report(stages: DataFrame, records: DataFrame, claims: DataFrame, branches: DataFrame, intents: DataFrame) -> DataFrame:
    """Per stage the numbers of records, claims and branches, the intents without records, and whether it may steer generation.

    stages: stage, can_steer, evidence_available; the others have stage, intents also intent_id and n_records.
    """
    of = lambda rows, name: rows.groupBy("stage").agg(F.count("*").alias(name))
    missing = intents.where("n_records = 0").groupBy("stage").agg(F.array_sort(F.collect_set("intent_id")).alias("missing_intents"))
    out = stages
    for part in (of(records, "n_records"), of(claims, "n_claims"), of(branches, "n_branches"), missing):
        out = out.join(part, "stage", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    steers = F.col("can_steer") & F.col("evidence_available") & (F.coalesce("n_branches", F.lit(0)) > 0)
    return out.select("stage", zero("n_records"), zero("n_claims"), zero("n_branches"), F.coalesce("missing_intents", F.array().cast("array<string>")).alias("missing_intents"), steers.alias("can_steer_generation"))
