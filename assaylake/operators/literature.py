"""Literature records, claims and their graph: fusion, deduplication, classification, branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def identity_key(doi: Column, pmid: Column, arxiv: Column, title: Column, year: Column) -> Column:
    """The first identifier that is there: DOI, PMID, arXiv, then title and year."""
    return F.coalesce(F.concat(F.lit("doi:"), doi), F.concat(F.lit("pmid:"), pmid), F.concat(F.lit("arxiv:"), arxiv), F.concat_ws("|", F.lit("title:"), title, year.cast("string")))


def fuse_records(rows: DataFrame, key: str, order: list[str], longest: list[str], most: list[str], sets: list[str], any_true: list[str], first: list[str]) -> DataFrame:
    """One row per key: longest texts, greatest numbers, unions of values, flags if any; other columns from the first row in the declared order that has them."""
    place = F.struct(*order)
    long = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(-F.length(c), F.col(c)))).alias(c) for c in longest]
    big = [F.max(c).alias(c) for c in most]
    union = [F.array_sort(F.collect_set(c)).alias(c) for c in sets]
    flags = [(F.max(F.coalesce(F.col(c), F.lit(False)).cast("int")) == 1).alias(c) for c in any_true]
    early = [F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in first]
    return rows.groupBy(key).agg(*long, *big, *union, *flags, *early, F.count("*").alias("n_merged"))


def dedupe_best(rows: DataFrame, keys: list[str], best: str, tie: str) -> DataFrame:
    """The row of each key with the greatest value, the least tie column among equals."""
    w = Window.partitionBy(*keys).orderBy(F.desc(best), F.col(tie))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def claim_graph(claims: DataFrame) -> DataFrame:
    """Edges with counts by polarity and a conflict flag."""
    of = lambda v: F.count_if(F.col("polarity") == v)
    out = claims.groupBy("subject", "predicate", "object").agg(of("supports").alias("positive"), of("contradicts").alias("negative"), F.count_if(~F.col("polarity").isin("supports", "contradicts")).alias("uncertain"))
    return out.withColumn("conflict", (F.col("positive") > 0) & (F.col("negative") > 0))


def two_hop(edges: DataFrame) -> DataFrame:
    """Paths a-b-c of two edges, those that return to their start left out."""
    left = edges.select(F.col("subject").alias("start"), F.col("object").alias("middle"), F.col("claim_id").alias("c1"))
    right = edges.select(F.col("subject").alias("middle"), F.col("object").alias("end"), F.col("claim_id").alias("c2"))
    return left.join(right, "middle").where("start <> end")


# Words by which a graph node's type is told, first match wins.
NODE_TYPES = [
    ("disease", r"\b(cancer|disease|carcinoma|tumou?r|syndrome)\b"),
    ("target", r"\b(protein|gene|receptor|kinase|enzyme|target)\b"),
    ("scaffold", r"\b(scaffold|core|motif)\b"),
    ("toxicity", r"\b(toxic|toxicity|adverse)\b"),
    ("condition", r"\b(pressure|temperature|anneal|synthesis|condition)\b"),
    ("dopant", r"\b(dopant|doping|substitution)\b"),
    ("compound", r"\b(compound|drug|inhibitor|agonist|antagonist|molecule)\b"),
    ("material", r"\b(material|crystal|phase|alloy|oxide|hydride|formula)\b"),
]
PROPERTY_WORDS = r"\b(gap|energy|conduct|modulus|capacity|efficacy)\b"
# Kinds of evidence branches with their priorities.
PRIORITIES = {"conflict": 0.95, "avoidance": 0.9, "exact_recheck": 0.85, "composition": 0.82, "analog": 0.8, "condition": 0.8, "mechanism_alternative": 0.75, "underexplored": 0.65}


def node_type(name: Column, predicate: Column, is_object: Column) -> Column:
    """Type of a graph node by the words of its relation and name; a lone element symbol is an element."""
    compact = F.trim(F.regexp_replace(name, r"\s+", " "))
    low = F.lower(F.concat_ws(" ", predicate, compact))
    out = F.when(F.lit(False), "")
    for kind, words in NODE_TYPES:
        out = out.when(low.rlike(words), kind)
    return out.when(compact.rlike("^[A-Z][a-z]?$"), "element").when(is_object & low.rlike(PROPERTY_WORDS), "property").otherwise("other")


def claim_nodes(claims: DataFrame) -> DataFrame:
    """Nodes of the claim graph: node_type, name (in lower case with single spaces), and the numbers of claims with it as subject and object."""
    side = lambda c, is_object: claims.select(F.col(c).alias("raw"), "predicate", F.lit(is_object).alias("is_object"))
    both = side("subject", False).unionByName(side("object", True)).where("raw is not null")
    typed = both.select(node_type(F.col("raw"), F.col("predicate"), F.col("is_object")).alias("node_type"), F.lower(F.trim(F.regexp_replace("raw", r"\s+", " "))).alias("name"), "is_object")
    return typed.groupBy("node_type", "name").agg(F.count_if(~F.col("is_object")).alias("n_subject"), F.count_if("is_object").alias("n_object"))


def branches(graph: DataFrame, most: int, medicinal: bool = False) -> DataFrame:
    """Evidence branches (subject, object, kind, priority) of each relation; the best ``most`` of them.

    graph: subject, object, positive, negative (null results count here), has_conditions. A conflict keeps
    its other branches; evidence against alone gives nothing but avoidance. What is left gives a composition
    branch, with one for its conditions if it has any; in medicinal chemistry a recheck, an analog and an alternative.
    """
    conflict = (F.col("positive") > 0) & (F.col("negative") > 0)
    against = (F.col("negative") > 0) & (F.col("positive") == 0)
    rest = ["exact_recheck", "analog", "mechanism_alternative"] if medicinal else ["composition"]
    kinds = [F.when(conflict, "conflict"), F.when(against, "avoidance"), *[F.when(~against, k) for k in rest], *([] if medicinal else [F.when(~against & F.col("has_conditions"), "condition")])]
    rows = graph.select("subject", "object", F.explode(F.array_compact(F.array(*kinds))).alias("kind"))
    return best_branches(rows, most)


def path_branches(paths: DataFrame, most: int) -> DataFrame:
    """Branches of two-edge paths (start, middle, end), each once: hypotheses, never evidence."""
    return best_branches(paths.select(F.col("start").alias("subject"), F.col("end").alias("object"), F.lit("underexplored").alias("kind")).distinct(), most)


def best_branches(rows: DataFrame, most: int) -> DataFrame:
    """Each (subject, object, kind) once with its priority; the ``most`` with the greatest ones."""
    table = F.create_map(*[F.lit(x) for p in PRIORITIES.items() for x in p])
    once = rows.select("subject", "object", "kind").distinct().withColumn("priority", F.element_at(table, F.col("kind")))
    return once.orderBy(F.desc("priority"), "subject", "object", "kind").limit(most)
