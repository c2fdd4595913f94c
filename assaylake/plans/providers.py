"""Provider payloads made from the documents as JSON or XML, and scanned back into rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import scalars as S
from assaylake.plans.claims import case
from assaylake.plans.registry import query
from assaylake.sources import providers as P

ID = "CAST(doc_id AS VARCHAR)"


def text_of(df, *names):
    return df.select(*[F.array_join(F.col(c), ";").alias(c) if c == "authors" else F.date_format(c, "yyyy-MM-dd").alias(c) if c == "publication_date" else F.col(c) for c in names])


@query(f"""SELECT 'LIT-' || substr(sha256(CAST(to_json(['europe_pmc', source_id, doi, pmid, 'A <b> title ' || {ID}]) AS VARCHAR)), 1, 24) AS record_id, source_id, doi, pmid, pmcid, 'A <b> title ' || {ID} AS title, 'Ann A;Bob B;C' AS authors,
  CASE doc_id % 3 WHEN 0 THEN '2001-05-06' WHEN 1 THEN '2002-07-01' END AS publication_date, CASE doc_id % 3 WHEN 0 THEN 2001 WHEN 1 THEN 2002 ELSE 1999 END AS publication_year,
  CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_retracted, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS citation_count
FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN {ID} END AS pmid, CASE WHEN doc_id % 4 = 1 THEN 'PMC' || {ID} END AS pmcid, CASE WHEN doc_id % 4 <= 2 THEN '10.1/x' || {ID} END AS doi,
      CASE doc_id % 4 WHEN 0 THEN {ID} WHEN 1 THEN 'PMC' || {ID} WHEN 2 THEN '10.1/x' || {ID} ELSE 'ppr' || {ID} END AS source_id FROM {{documents}})""")
def europe_pmc_scan(t):
    i, n = F.col("doc_id").cast("string"), F.col("doc_id")
    item = F.to_json(F.struct(
        F.concat(F.lit("ppr"), i).alias("id"), F.when(n % 4 == 0, i).alias("pmid"), F.when(n % 4 == 1, F.concat(F.lit("PMC"), i)).alias("pmcid"), F.when(n % 4 <= 2, F.concat(F.lit("https://doi.org/10.1/X"), i)).alias("doi"),
        F.concat(F.lit("<i>A</i> &lt;b&gt;\n title "), i).alias("title"), F.col("text").alias("abstractText"), F.lit("Ann A, Bob B and C;").alias("authorString"),
        case("doc_id", 3, "2001-05-06", "2002-07", "").alias("firstPublicationDate"), F.lit("1999").alias("pubYear"), F.when(n % 3 == 0, "Y").when(n % 3 == 1, "no").otherwise("?").alias("isRetracted"),
        F.when(n % 2 == 0, F.col("n_chars")).otherwise(F.lit(-1)).alias("citedByCount"),
    ))
    return text_of(P.europe_pmc(t.documents.select(item.alias("p")), "p"), "record_id", "source_id", "doi", "pmid", "pmcid", "title", "authors", "publication_date", "publication_year", "is_retracted", "citation_count")


@query(f"""SELECT 'https://openalex.org/W' || {ID} AS source_id, 'it is as it was ' || {ID} AS abstract, CASE WHEN doc_id % 2 = 0 THEN {ID} ELSE 'x' || {ID} END AS pmid, 'Ann' AS authors, source AS venue, doc_id % 3 = 0 AS open_access FROM {{documents}}""")
def openalex_scan(t):
    i, n = F.col("doc_id").cast("string"), F.col("doc_id")
    name = lambda s: F.struct(F.struct(F.lit(s).alias("display_name")).alias("author"))
    index = F.create_map(F.lit("it"), F.array(F.lit(3), F.lit(0)), F.lit("as"), F.array(F.lit(2)), i, F.array(F.lit(5)), F.lit("is"), F.array(F.lit(1)), F.lit("was"), F.array(F.lit(4)))
    item = F.to_json(F.struct(
        F.concat(F.lit("https://openalex.org/W"), i).alias("id"), F.lit("T").alias("title"), index.alias("abstract_inverted_index"), F.array(name("Ann"), name(" ")).alias("authorships"),
        F.struct(F.struct(F.col("source").alias("display_name")).alias("source")).alias("primary_location"), F.struct((n % 3 == 0).alias("is_oa")).alias("open_access"),
        F.struct(F.when(n % 2 == 0, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), i, F.lit("/"))).otherwise(F.concat(F.lit("x"), i)).alias("pmid")).alias("ids"),
    ))
    return text_of(P.openalex(t.documents.select(item.alias("p")), "p"), "source_id", "abstract", "pmid", "authors", "venue", "open_access")


@query(f"""SELECT CASE WHEN doc_id % 2 = 0 THEN '10.1/y' || {ID} ELSE 'https://u/' || {ID} END AS source_id, 'first' AS title, CASE doc_id % 4 WHEN 0 THEN '2010-03-04' WHEN 1 THEN '2011-05-01' WHEN 2 THEN '2012-01-01' END AS publication_date,
  CASE WHEN doc_id % 5 = 0 THEN true END AS is_retracted, 'Ann A;B' AS authors FROM {{documents}}""")
def crossref_scan(t):
    i, n = F.col("doc_id").cast("string"), F.col("doc_id")
    dates = lambda *parts: F.struct(F.array(F.array(*map(F.lit, parts))).alias("date-parts"))
    item = F.to_json(F.struct(
        F.when(n % 2 == 0, F.concat(F.lit("10.1/Y"), i)).alias("DOI"), F.concat(F.lit("https://u/"), i).alias("URL"), F.array(F.lit("first"), F.lit("second")).alias("title"),
        F.when(n % 4 == 0, dates(2010, 3, 4)).when(n % 4 == 1, dates(2010, 13, 1)).alias("published-print"), F.when(n % 4 == 1, dates(2011, 5)).alias("published-online"), F.when(n % 4 == 2, dates(2012)).alias("created"),
        F.when(n % 10 == 0, "Retraction").when(n % 5 == 0, "correction").otherwise("journal-article").alias("type"),
        F.array(F.struct(F.lit("Ann").alias("given"), F.lit("A").alias("family")), F.struct(F.lit(None).cast("string").alias("given"), F.lit("B ").alias("family"))).alias("author"),
    ))
    return text_of(P.crossref(t.documents.select(item.alias("p")), "p"), "source_id", "title", "publication_date", "is_retracted", "authors")


@query(f"""SELECT {ID} AS pmid, CASE WHEN doc_id % 2 = 0 THEN '10.1/z' || {ID} END AS doi, CASE WHEN doc_id % 3 = 0 THEN 'PMC' || {ID} END AS pmcid, 'On H2O ' || {ID} AS title, 'One. Two & more.' AS abstract, 'Ann A;The Group' AS authors,
  CASE doc_id % 4 WHEN 0 THEN '2010-03-04' WHEN 1 THEN '2011-05-01' WHEN 2 THEN '2012-01-01' ELSE '2013-01-01' END AS publication_date FROM {{documents}} WHERE doc_id % 7 <> 6""")
def pubmed_scan(t):
    i, n = F.col("doc_id").cast("string"), F.col("doc_id")
    when = case("doc_id", 4, "<Year>2010</Year><Month>Mar</Month><Day>4</Day>", "<Year>2011</Year><Month>05</Month>", "<Year>2012</Year><Month>Spring</Month>", "<MedlineDate>2013 Jan-Feb</MedlineDate>")
    xml = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID Version='1'>"), i, F.lit("</PMID><Article><Journal><JournalIssue><PubDate>"), when, F.lit("</PubDate></JournalIssue><Title>J</Title></Journal><ArticleTitle>"),
        F.when(n % 7 == 6, " ").otherwise(F.concat(F.lit("On H<sub>2</sub>O "), i)), F.lit("</ArticleTitle><Abstract><AbstractText Label='A'>One.</AbstractText><AbstractText>Two &amp; more.</AbstractText></Abstract>"),
        F.lit("<AuthorList><Author><LastName>A</LastName><ForeName>Ann</ForeName></Author><Author><CollectiveName>The Group</CollectiveName></Author></AuthorList></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType='pubmed'>"), i,
        F.lit("</ArticleId>"), F.when(n % 2 == 0, F.concat(F.lit("<ArticleId IdType='doi'>10.1/Z"), i, F.lit("</ArticleId>"))).otherwise(""), F.when(n % 3 == 0, F.concat(F.lit("<ArticleId IdType='pmc'>PMC"), i, F.lit("</ArticleId>"))).otherwise(""),
        F.lit("</ArticleIdList></PubmedData></PubmedArticle>"),
    )
    return text_of(P.pubmed(t.documents.select(xml.alias("p")), "p"), "pmid", "doi", "pmcid", "title", "abstract", "authors", "publication_date")


@query(f"""SELECT {ID} || 'v1' AS arxiv_id, 'A title ' || {ID} AS title, CASE WHEN doc_id % 2 = 0 THEN '10.1/w' || {ID} END AS doi, 'Ann;Bob' AS authors, CASE doc_id % 4 WHEN 0 THEN '2015-02-03' WHEN 1 THEN '2016-01-01' END AS publication_date
FROM {{documents}} WHERE doc_id % 4 <> 2""")
def arxiv_scan(t):
    i, n = F.col("doc_id").cast("string"), F.col("doc_id")
    xml = F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/"), i, F.lit("v1</id><title>A\n  title "), i, F.lit("</title><summary>s</summary><published>"), case("doc_id", 4, "2015-02-03T00:00:00Z", "2016", "2019-01-01", ""),
        F.lit("</published><author><name>Ann</name></author><author><name>Bob</name></author>"), F.when(n % 2 == 0, F.concat(F.lit("<doi>10.1/W"), i, F.lit("</doi>"))).otherwise(""), F.lit("</entry>"),
    )
    return text_of(P.arxiv(t.documents.select(xml.alias("p")), "p", "2015-01-01", "2018-12-31"), "arxiv_id", "title", "doi", "authors", "publication_date")


@query("""SELECT row_number() OVER (ORDER BY place) AS position, smiles FROM (SELECT 'C' || CAST(p_size AS VARCHAR) AS smiles, min(p_partkey) AS place FROM {part} WHERE p_partkey % 7 > 1 GROUP BY 1 ORDER BY place LIMIT 30)""")
def generated_molecules(t):
    smiles = F.when(F.col("p_partkey") % 7 == 0, " ").when(F.col("p_partkey") % 7 == 1, "C\nC").otherwise(F.concat(F.lit("C"), F.col("p_size").cast("string")))
    return P.first_texts(t.part.select("p_partkey", smiles.alias("smiles")), "smiles", "p_partkey", 30)


@query("""SELECT CASE WHEN p_partkey % 10 > 0 THEN 'm-' || CAST(p_partkey AS VARCHAR) END AS record_id, CASE p_partkey % 10 WHEN 0 THEN 'not_a_structure' WHEN 1 THEN 'unsupported_structure_features' WHEN 2 THEN 'assemblies_not_supported' WHEN 3 THEN 'non_three_dimensional_structure'
  WHEN 4 THEN 'site_count_or_site_arrays_inconsistent' WHEN 5 THEN 'partial_or_non_element_species_definition' WHEN 6 THEN 'species_at_sites_reference_unknown_definition' WHEN 7 THEN 'lattice_vectors_missing_or_invalid' END AS unsupported,
  CASE WHEN p_partkey % 10 > 7 THEN 2 END AS n_sites, CASE WHEN p_partkey % 10 > 7 THEN 'Na,Cl' END AS symbols, CASE WHEN p_partkey % 10 > 7 THEN CAST(p_size AS DOUBLE) END AS edge FROM {part}""")
def optimade_scan(t):
    k, i, edge = F.col("p_partkey") % 10, F.col("p_partkey").cast("string"), F.col("p_size").cast("double")
    zero = F.lit(0.0)
    lattice = F.when(k == 7, F.array(F.array(edge, zero))).otherwise(F.array(F.array(edge, zero, zero), F.array(zero, edge, zero), F.array(zero, zero, edge)))
    species = lambda name, symbol, share: F.struct(F.lit(name).alias("name"), F.array(F.lit(symbol)).alias("chemical_symbols"), F.array(share).alias("concentration"))
    attributes = F.struct(
        F.lit("NaCl").alias("chemical_formula_reduced"), F.when(k == 1, F.array(F.lit(" Disorder"))).otherwise(F.array(F.lit("site_attachments"))).alias("structure_features"), F.when(k == 2, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("assemblies"),
        F.when(k == 3, 2).otherwise(3).alias("nperiodic_dimensions"), F.array(F.lit(1), F.lit(1), F.lit(1)).alias("dimension_types"), lattice.alias("lattice_vectors"), F.array(F.array(zero, zero, zero), F.array(edge / 2, zero, zero)).alias("cartesian_site_positions"),
        F.array(F.lit("A"), F.when(k == 6, "C").otherwise("B")).alias("species_at_sites"), F.when(k == 4, 3).otherwise(2).alias("nsites"), F.array(species("A", "Na", F.lit(1.0)), species("B", "Cl", F.when(k == 5, 0.5).otherwise(1.0))).alias("species"),
    )
    item = F.to_json(F.struct(F.when(k > 0, F.concat(F.lit("m-"), i)).alias("id"), F.lit("structures").alias("type"), attributes.alias("attributes")))
    found = P.optimade(t.part.select(item.alias("p")), "p")
    return found.select("record_id", "unsupported", "n_sites", F.array_join("symbols", ",").alias("symbols"), F.col("lattice")[0][0].alias("edge"))


UNITED = f"""u AS (
  SELECT 0 AS rank, 'europe_pmc' AS provider, 'doi:10.1/' || (doc_id // 2) AS key, 'Title ' || {ID} AS title, n_chars AS cited, false AS gone FROM {{documents}}
  UNION ALL SELECT 3, 'crossref', 'doi:10.1/' || (doc_id // 2), 'Crossref title ' || {ID}, n_chars * 2, n_chars > 5000 FROM {{documents}} WHERE lang = 'en'
  UNION ALL SELECT 2, 'openalex', 'pmid:' || (doc_id // 3), 'Open ' || {ID}, 7, false FROM {{documents}} WHERE lang = 'de'
  UNION ALL SELECT 1, 'pubmed', 'pmid:' || (doc_id // 3), 'Medical ' || {ID}, NULL, false FROM {{documents}} WHERE lang = 'es'
  UNION ALL SELECT 4, 'arxiv', 'arxiv:24.' || {ID}, 'Preprint ' || {ID}, NULL, false FROM {{documents}} WHERE lang = 'fr')"""


@query(f"""WITH {UNITED} SELECT key, arg_min(title, {{'n': -length(title), 't': title}}) AS title, max(cited) AS citation_count, string_agg(DISTINCT provider, ';' ORDER BY provider) AS providers,
  bool_or(gone) AS is_retracted, CASE WHEN key LIKE 'doi:%' THEN substr(key, 5) END AS doi, count(*) AS n_merged FROM u GROUP BY key""")
def united_records(t):
    """Payloads of five providers made from the documents, scanned, united and fused by identity."""
    i = F.col("doc_id").cast("string")
    doi, pmid = F.concat(F.lit("10.1/"), F.floor(F.col("doc_id") / 2).cast("string")), F.floor(F.col("doc_id") / 3).cast("string")
    docs = t.documents
    of = lambda lang, payload: docs.where(F.col("lang") == lang).select(payload.alias("p"))
    europe = docs.select(F.to_json(F.struct(i.alias("id"), doi.alias("doi"), F.concat(F.lit("Title "), i).alias("title"), F.col("n_chars").cast("string").alias("citedByCount"))).alias("p"))
    crossref = of("en", F.to_json(F.struct(F.upper(doi).alias("DOI"), F.array(F.concat(F.lit("Crossref title "), i)).alias("title"), (F.col("n_chars") * 2).alias("is-referenced-by-count"), F.when(F.col("n_chars") > 5000, "retraction").otherwise("article").alias("type"))))
    openalex = of("de", F.to_json(F.struct(F.concat(F.lit("W"), i).alias("id"), F.concat(F.lit("Open "), i).alias("title"), F.struct(F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")).alias("pmid")).alias("ids"), F.lit(7).alias("cited_by_count"))))
    pubmed = of("es", F.concat(F.lit("<PubmedArticle><MedlineCitation><PMID>"), pmid, F.lit("</PMID><Article><ArticleTitle>Medical "), i, F.lit("</ArticleTitle></Article></MedlineCitation></PubmedArticle>")))
    arxiv = of("fr", F.concat(F.lit("<entry><id>http://arxiv.org/abs/24."), i, F.lit("</id><title>Preprint "), i, F.lit("</title></entry>")))
    scans = P.europe_pmc(europe, "p"), P.pubmed(pubmed, "p"), P.openalex(openalex, "p"), P.crossref(crossref, "p"), P.arxiv(arxiv, "p")
    out = P.fuse_united(P.unite(*scans))
    return out.select("key", "title", "citation_count", F.array_join("providers", ";").alias("providers"), "is_retracted", "doi", "n_merged")
