"""Literature records, claims and the claim graph over documents, labels and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import scalars as S
from assaylake.functions.text_forms import normal_form as normal_form_of
from assaylake.operators import literature as O
from assaylake.plans.registry import query

STAGES = {"synthesis": "licen[sc]e|prepared|synthesi", "validation": "rights|measured|test", "computation": "version|model|comput"}
KEY = "CASE WHEN doc_id % 3 = 0 THEN 'doi:10.1/' || CAST(doc_id // 6 AS VARCHAR) WHEN doc_id % 3 = 1 THEN 'pmid:' || CAST(doc_id // 6 AS VARCHAR) ELSE 'title:|' || lower(trim(split_part(text, chr(10), 1))) || '|' || CAST(2000 + doc_id % 20 AS VARCHAR) END"
STEER = "SELECT claim_id, subject, object, polarity FROM {b_claim} WHERE polarity IN ('supports', 'contradicts') AND n_chars >= 200"


@query(f"""WITH r AS (SELECT {KEY} AS key, doc_id, source, lang, n_chars, lower(trim(split_part(text, chr(10), 1))) AS title, doc_id % 17 = 0 AS retracted FROM {{documents}})
SELECT key, max(n_chars) AS n_chars, array_to_string(list_sort(list(DISTINCT source)), ';') AS sources, bool_or(retracted) AS retracted, arg_min(lang, doc_id) AS lang, first(title ORDER BY length(title) DESC, title) AS title, count(*) AS n_merged FROM r GROUP BY 1""")
def record_fusion(t):
    sixth = F.floor(F.col("record_id") / 6).cast("string")
    rows = t.b_record.join(t.documents.select(F.col("doc_id").alias("record_id"), "n_chars"), "record_id")
    doi = S.normal_doi(F.when(F.col("record_id") % 3 == 0, F.concat(F.lit("https://doi.org/10.1/"), sixth)))
    pmid = F.when(F.col("record_id") % 3 == 1, sixth)
    rows = rows.withColumn("key", O.identity_key(doi, pmid, F.lit(None).cast("string"), F.col("title"), F.col("publication_year"))).withColumn("sources", F.col("provider")).withColumn("retracted", F.col("record_id") % 17 == 0)
    out = O.fuse_records(rows, "key", ["record_id"], ["title"], ["n_chars"], ["sources"], ["retracted"], ["lang"])
    return out.withColumn("sources", S.joined(F.col("sources")))


@query("SELECT claim_id, subject, object, polarity FROM {b_claim} QUALIFY row_number() OVER (PARTITION BY subject, object, polarity ORDER BY n_chars DESC, claim_id) = 1")
def claim_dedupe(t):
    return O.dedupe_best(t.b_claim, ["subject", "object", "polarity"], "n_chars", "claim_id").select("claim_id", "subject", "object", "polarity")


@query(r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\n\f\v]+', ' ', 'g'))) AS digest FROM {pages}""")
def markup_clean(t):
    return t.pages.select("page_id", F.md5(S.clean_markup(F.col("html"))).alias("digest"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[ \t\r\n\f\v\x1c-\x1f]+', ' ', 'g'))) AS digest, NOT regexp_matches(text, '[^\x00-\x7f]|&') AS plain FROM {documents}""")
def normal_form(t):
    """Digests of the documents' normal forms; the SQL holds for texts of Latin letters, as these are."""
    return t.documents.select("doc_id", F.md5(normal_form_of(F.col("text"))).alias("digest"), S.is_ascii_form(F.col("text")).alias("plain"))


@query("SELECT record_id, CASE " + " ".join(f"WHEN regexp_matches(lower(abstract), '{p}') THEN '{s}'" for s, p in STAGES.items()) + " ELSE 'unknown' END AS stage, regexp_matches(lower(title), 'licen[sc]e|idiot|fail') AS failure_term FROM {b_record}")
def stage_classify(t):
    stage = F.coalesce(*[F.when(F.lower("abstract").rlike(p), F.lit(s)) for s, p in STAGES.items()], F.lit("unknown"))
    return t.b_record.select("record_id", stage.alias("stage"), F.lower("title").rlike("licen[sc]e|idiot|fail").alias("failure_term"))


@query("""SELECT q.source || ':' || q.lang AS query_id, count(d.doc_id) AS n_records, CASE WHEN count(d.doc_id) > 0 THEN 'covered' ELSE 'no_records' END AS status FROM (SELECT * FROM (SELECT DISTINCT source FROM {documents}) CROSS JOIN (SELECT unnest(['en', 'fr', 'it']) AS lang)) q LEFT JOIN {documents} d ON d.source = q.source AND d.lang = q.lang GROUP BY 1""")
def intent_coverage(t):
    asked = t.documents.select("source").distinct().select("source", F.explode(F.array(*map(F.lit, ("en", "fr", "it")))).alias("lang"))
    got = t.documents.select("doc_id", "source", "lang")
    out = asked.join(got, ["source", "lang"], "left").groupBy(F.concat_ws(":", "source", "lang").alias("query_id")).agg(F.count("doc_id").alias("n_records"))
    return out.withColumn("status", F.when(F.col("n_records") > 0, "covered").otherwise("no_records"))


@query("""SELECT source, CASE WHEN ok = 0 THEN 'failed' WHEN bad > 0 THEN 'partial' ELSE 'success' END AS status, ok, bad FROM (SELECT source, count(CASE WHEN n_chars >= 100 THEN 1 END) AS ok, count(CASE WHEN n_chars < 100 THEN 1 END) AS bad FROM {documents} GROUP BY 1)""")
def source_status(t):
    out = t.documents.groupBy("source").agg(F.count_if(F.col("n_chars") >= 100).alias("ok"), F.count_if(F.col("n_chars") < 100).alias("bad"))
    return out.withColumn("status", F.when(F.col("ok") == 0, "failed").when(F.col("bad") > 0, "partial").otherwise("success"))


@query("""SELECT record_id, provider, publication_year FROM {b_record} WHERE trim(title) <> '' AND publication_year BETWEEN 2005 AND 2018 AND record_id % 17 <> 0 QUALIFY row_number() OVER (PARTITION BY provider ORDER BY publication_year DESC, record_id DESC) <= 25""")
def record_admission(t):
    from pyspark.sql import Window

    rows = t.b_record.where("trim(title) <> '' and publication_year between 2005 and 2018 and record_id % 17 <> 0")
    w = Window.partitionBy("provider").orderBy(F.desc("publication_year"), F.desc("record_id"))
    return rows.withColumn("r", F.row_number().over(w)).where("r <= 25").select("record_id", "provider", "publication_year")


@query("""SELECT subject, predicate, object, positive, negative, uncertain, positive > 0 AND negative > 0 AS conflict FROM (SELECT subject, predicate, object, count(CASE WHEN polarity = 'supports' THEN 1 END) AS positive, count(CASE WHEN polarity = 'contradicts' THEN 1 END) AS negative, count(CASE WHEN polarity NOT IN ('supports', 'contradicts') THEN 1 END) AS uncertain FROM {b_claim} GROUP BY 1, 2, 3)""")
def claim_graph(t):
    return O.claim_graph(t.b_claim)


@query(f"""WITH e AS ({STEER} UNION ALL SELECT n_nationkey + 1000000, lower(CASE n_regionkey WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END), n_name, 'supports' FROM {{nation}})
SELECT a.subject AS start, a.object AS middle, b.object AS "end", count(*) AS n_paths FROM e a JOIN e b ON a.object = b.subject AND a.subject <> b.object GROUP BY 1, 2, 3""")
def two_hop(t):
    return paths(t).groupBy("start", "middle", "end").agg(F.count("*").alias("n_paths"))


def paths(t):
    claims = t.b_claim.where("polarity in ('supports', 'contradicts') and n_chars >= 200").select("claim_id", "subject", "object")
    lang = F.coalesce(F.get(F.array(F.lit("en"), F.lit("fr"), F.lit("de")), F.col("n_regionkey").cast("int")), F.lit("es"))
    hubs = t.nation.select((F.col("n_nationkey") + 1000000).alias("claim_id"), lang.alias("subject"), F.col("n_name").alias("object"))
    return O.two_hop(claims.unionByName(hubs))


GRAPH = """g AS (SELECT subject, object, count(CASE WHEN polarity = 'supports' THEN 1 END) AS p, count(CASE WHEN polarity IN ('contradicts', 'null') THEN 1 END) AS n, bool_or(n_chars % 5 = 0) AS c FROM {b_claim} WHERE polarity <> 'uncertain' OR n_chars % 3 = 0 GROUP BY 1, 2)"""


def relations(t):
    """Relations of decided claims and a third of the uncertain ones; some have conditions."""
    claims = t.b_claim.where("polarity <> 'uncertain' or n_chars % 3 = 0")
    counts = [F.count_if(F.col("polarity") == "supports").alias("positive"), F.count_if(F.col("polarity").isin("contradicts", "null")).alias("negative")]
    return claims.groupBy("subject", "object").agg(*counts, (F.max((F.col("n_chars") % 5 == 0).cast("int")) == 1).alias("has_conditions"))


@query(f"""WITH {GRAPH}, b AS (
SELECT subject, object, 'conflict' AS kind, 0.95 AS priority FROM g WHERE p > 0 AND n > 0 UNION ALL SELECT subject, object, 'avoidance', 0.9 FROM g WHERE n > 0 AND p = 0
UNION ALL SELECT subject, object, 'composition', 0.82 FROM g WHERE NOT (n > 0 AND p = 0) UNION ALL SELECT subject, object, 'condition', 0.8 FROM g WHERE c AND NOT (n > 0 AND p = 0))
SELECT subject, object, kind, CAST(priority AS DOUBLE) AS priority FROM b ORDER BY priority DESC, subject, object, kind LIMIT 40""")
def evidence_branches(t):
    return O.branches(relations(t), 40)


@query(f"""WITH {GRAPH}, b AS (
SELECT subject, object, 'conflict' AS kind, 0.95 AS priority FROM g WHERE p > 0 AND n > 0 UNION ALL SELECT subject, object, 'avoidance', 0.9 FROM g WHERE n > 0 AND p = 0
UNION ALL SELECT subject, object, kind, priority FROM g, (VALUES ('exact_recheck', 0.85), ('analog', 0.8), ('mechanism_alternative', 0.75)) v(kind, priority) WHERE NOT (n > 0 AND p = 0))
SELECT subject, object, kind, CAST(priority AS DOUBLE) AS priority FROM b ORDER BY priority DESC, subject, object, kind LIMIT 60""")
def medicinal_branches(t):
    return O.branches(relations(t), 60, medicinal=True)


@query(f"""WITH e AS ({STEER} UNION ALL SELECT n_nationkey + 1000000, lower(CASE n_regionkey WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END), n_name, 'supports' FROM {{nation}})
SELECT DISTINCT a.subject, b.object, 'underexplored' AS kind, CAST(0.65 AS DOUBLE) AS priority FROM e a JOIN e b ON a.object = b.subject AND a.subject <> b.object ORDER BY 1, 2 LIMIT 50""")
def path_branches(t):
    return O.path_branches(paths(t), 50)


@query(r"""WITH s AS (SELECT subject || CASE claim_id % 5 WHEN 0 THEN '  Oxide' WHEN 1 THEN ' kinase' ELSE '' END AS name, predicate, false AS o FROM {b_claim} UNION ALL SELECT CASE WHEN claim_id % 4 = 0 THEN 'Fe' WHEN claim_id % 4 = 1 THEN 'band gap' ELSE object END, predicate, true FROM {b_claim}),
t AS (SELECT lower(regexp_replace(name, '\s+', ' ', 'g')) AS name, name = 'Fe' AS fe, o FROM s WHERE name IS NOT NULL)
SELECT CASE WHEN regexp_matches(name, '\bkinase\b') THEN 'target' WHEN regexp_matches(name, '\boxide\b') THEN 'material' WHEN fe THEN 'element' WHEN o AND regexp_matches(name, '\bgap\b') THEN 'property' ELSE 'other' END AS node_type, name,
       count(CASE WHEN NOT o THEN 1 END) AS n_subject, count(CASE WHEN o THEN 1 END) AS n_object FROM t GROUP BY 1, 2""".replace("\\\\", "\\"))
def claim_nodes(t):
    n = F.col("claim_id")
    subject = F.concat("subject", F.when(n % 5 == 0, "  Oxide").when(n % 5 == 1, " kinase").otherwise(""))
    object_ = F.when(n % 4 == 0, "Fe").when(n % 4 == 1, "band gap").otherwise(F.col("object"))
    return O.claim_nodes(t.b_claim.select(subject.alias("subject"), "predicate", object_.alias("object")))


@query(f"""WITH s AS ({STEER}) SELECT c.subject, c.object, count(*) AS n_claims, count(s.claim_id) AS n_steerable, count(*) = count(s.claim_id) AS closed FROM {{b_claim}} c LEFT JOIN s USING (claim_id) GROUP BY 1, 2""")
def branch_closure(t):
    ok = F.col("polarity").isin("supports", "contradicts") & (F.col("n_chars") >= 200)
    out = t.b_claim.groupBy("subject", "object").agg(F.count("*").alias("n_claims"), F.count_if(ok).alias("n_steerable"))
    return out.withColumn("closed", F.col("n_claims") == F.col("n_steerable"))


@query("""WITH s AS (SELECT 'stage' || CAST(doc_id % 3 AS VARCHAR) AS stage, doc_id, source FROM {documents})
SELECT stage || ':' || CAST(doc_id AS VARCHAR) AS record_id, stage || ':' || CAST(l.doc_id AS VARCHAR) AS claim_id, source FROM s JOIN {labels} l USING (doc_id)""")
def bundle_compose(t):
    stage = F.concat(F.lit("stage"), (F.col("doc_id") % 3).cast("string"))
    records = t.documents.select("doc_id", "source", F.concat_ws(":", stage, F.col("doc_id").cast("string")).alias("record_id"))
    return records.join(t.labels.select("doc_id"), "doc_id").select("record_id", F.col("record_id").alias("claim_id"), "source")


@query("""SELECT source, array_to_string(list_sort(list_filter([CASE WHEN source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7') THEN 'source_not_allowed' END, CASE WHEN count(DISTINCT lang) < 4 THEN 'language_missing' END, CASE WHEN count(*) < 10 THEN 'too_few_records' END], lambda x: x IS NOT NULL)), ';') AS violations FROM {documents} GROUP BY source""")
def source_contract(t):
    out = t.documents.groupBy("source").agg(F.countDistinct("lang").alias("langs"), F.count("*").alias("n"))
    allowed = [f"src{i}" for i in range(8)]
    return out.select("source", S.joined(S.reasons(source_not_allowed=~F.col("source").isin(*allowed), language_missing=F.col("langs") < 4, too_few_records=F.col("n") < 10)).alias("violations"))
