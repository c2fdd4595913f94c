"""Scans of dumped literature and structure payloads into one row schema per kind; one item or article a row.

Every scan takes a column of texts (JSON or XML of one item) and keeps the other columns of the rows
under their names in a struct ``row``, so nothing clashes. A payload that can't be read gives null fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaylake.functions import scalars as S

RECORD = ["record_id", "provider", "source_id", "title", "abstract", "authors", "venue", "doi", "pmid", "pmcid", "arxiv_id", "publication_date", "publication_year", "is_retracted", "citation_count", "open_access"]


def some(value: Column) -> Column:
    """A text without outer white space, null if nothing is left."""
    bare = F.trim(value)
    return F.when(bare != "", bare)


def count_or_null(value: Column) -> Column:
    number = value.try_cast("long")
    return F.when(number >= 0, number)


def year_or_null(value: Column) -> Column:
    year = value.try_cast("int")
    return F.when(year.between(1600, 3000), year)


def markup_text(value: Column) -> Column:
    return F.coalesce(S.clean_markup(value), F.lit(""))


def split_authors(value: Column) -> Column:
    """Names between commas, semicolons and the word and."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), r",|;|\band\b"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def inverted_abstract(index: Column) -> Column:
    """A text from a map of token to positions: tokens by position, then by themselves."""
    each = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda i: F.struct(i.alias("i"), e["key"].alias("t")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(F.filter(each, lambda x: x["i"].isNotNull())), lambda x: x["t"]), " "), F.lit(""))


def date_of_parts(parts: Column) -> Column:
    """A date of year, month and day, where month and day may be missing; null if there is none."""
    number = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(1))
    return F.try_to_date(F.format_string("%04d-%02d-%02d", F.get(parts, F.lit(0)), number(1), number(2)), "yyyy-MM-dd")


def _records(rows: DataFrame, provider: str, identity: list[Column], **fields: Column) -> DataFrame:
    """The common schema: missing fields are null, the year follows the date, the id is a hash of what identifies the record."""
    typed = {"authors": "array<string>", "publication_date": "date", "publication_year": "int", "is_retracted": "boolean", "citation_count": "long", "open_access": "boolean"}
    out = rows.select("row", *[F.coalesce(fields[c], F.lit(None)).alias(c) if c in fields else F.lit(None).cast(typed.get(c, "string")).alias(c) for c in RECORD if c not in ("record_id", "provider", "publication_year")], fields.get("publication_year", F.lit(None).cast("int")).alias("_year"), *[i.cast("string").alias(f"_id{n}") for n, i in enumerate(identity)])
    record = F.concat(F.lit("LIT-"), F.substring(S.identity_hash(F.lit(provider), *[F.col(f"_id{n}") for n in range(len(identity))]), 1, 24))
    year = F.coalesce(F.year("publication_date"), F.col("_year"))
    named = {"record_id": record, "provider": F.lit(provider), "publication_year": year}
    return out.select("row", *[named.get(c, F.col(c)).alias(c) for c in RECORD])


def _read(rows: DataFrame, payload: str, schema: str, xml: bool = False) -> DataFrame:
    others = [c for c in rows.columns if c != payload]
    kept = F.struct(*others) if others else F.lit(None).cast("string")
    return rows.select(kept.alias("row"), F.col(payload).alias("_p"), (F.from_xml(F.col(payload), schema) if xml else F.from_json(F.col(payload), schema)).alias("x"))


def europe_pmc(rows: DataFrame, payload: str) -> DataFrame:
    """Europe PMC items; the source id is the first of PMID, PMCID, DOI and id, else a hash of the payload."""
    read = _read(rows, payload, "id string, pmid string, pmcid string, doi string, title string, abstractText string, authorString string, journalTitle string, pubYear string, firstPublicationDate string, firstIndexDate string, isRetracted string, citedByCount string, isOpenAccess string")
    x = lambda c: F.col(f"x.{c}")
    doi, pmid, pmcid = S.normal_doi(x("doi")), some(x("pmid")), some(x("pmcid"))
    source = F.coalesce(pmid, pmcid, doi, some(x("id")), F.substring(F.sha2("_p", 256), 1, 16))
    title = markup_text(x("title"))
    return _records(
        read, "europe_pmc", [source, doi, pmid, title], source_id=source, title=title, abstract=markup_text(x("abstractText")), authors=split_authors(x("authorString")), venue=some(x("journalTitle")), doi=doi, pmid=pmid, pmcid=pmcid,
        publication_date=S.partial_date(F.coalesce(some(x("firstPublicationDate")), some(x("firstIndexDate")))), publication_year=year_or_null(x("pubYear")), is_retracted=S.tri_state(x("isRetracted")), citation_count=count_or_null(x("citedByCount")), open_access=S.tri_state(x("isOpenAccess")),
    )


def openalex(rows: DataFrame, payload: str) -> DataFrame:
    """OpenAlex works; the abstract is put together from its inverted index."""
    read = _read(rows, payload, "id string, doi string, title string, publication_date string, publication_year string, abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:struct<display_name:string>>, ids struct<pmid:string>, is_retracted string, cited_by_count string, open_access struct<is_oa:string>")
    x = lambda c: F.col(f"x.{c}")
    doi, ident = S.normal_doi(x("doi")), F.coalesce(some(x("id")), F.substring(F.sha2("_p", 256), 1, 16))
    names = F.transform(F.coalesce(x("authorships"), F.array().cast("array<struct<author:struct<display_name:string>>>")), lambda a: F.trim(a["author"]["display_name"]))
    pmid = some(x("ids.pmid"))
    pmid = F.when(pmid.startswith("https://pubmed.ncbi.nlm.nih.gov/"), F.regexp_extract(pmid, r"([^/]*)/*$", 1)).otherwise(pmid)
    return _records(
        read, "openalex", [ident, doi, x("title")], source_id=ident, title=markup_text(x("title")), abstract=markup_text(inverted_abstract(x("abstract_inverted_index"))), authors=F.filter(names, lambda n: n != ""), venue=some(x("primary_location.source.display_name")), doi=doi, pmid=pmid,
        publication_date=S.partial_date(x("publication_date")), publication_year=year_or_null(x("publication_year")), is_retracted=S.tri_state(x("is_retracted")), citation_count=count_or_null(x("cited_by_count")), open_access=S.tri_state(x("open_access.is_oa")),
    )


def crossref(rows: DataFrame, payload: str) -> DataFrame:
    """Crossref works: the first title, the first usable date of print, online, published and created; a retraction or
    correction is retracted, of any other type nothing is known."""
    parts = "struct<`date-parts`:array<array<int>>>"
    read = _read(rows, payload, f"DOI string, URL string, type string, title array<string>, abstract string, `container-title` array<string>, author array<struct<given:string,family:string>>, `is-referenced-by-count` string, `published-print` {parts}, `published-online` {parts}, published {parts}, created {parts}")
    x = lambda c: F.col("x")[c]
    doi, title = S.normal_doi(x("DOI")), markup_text(F.get(x("title"), F.lit(0)))
    date = F.coalesce(*[date_of_parts(F.get(x(k)["date-parts"], F.lit(0))) for k in ("published-print", "published-online", "published", "created")])
    names = F.transform(F.coalesce(x("author"), F.array().cast("array<struct<given:string,family:string>>")), lambda a: F.concat_ws(" ", some(a["given"]), some(a["family"])))
    source = F.coalesce(doi, some(x("URL")), F.substring(S.identity_hash(title, date), 1, 16))
    return _records(
        read, "crossref", [source, title], source_id=source, title=title, abstract=markup_text(x("abstract")), authors=F.filter(names, lambda n: n != ""), venue=some(F.get(x("container-title"), F.lit(0))), doi=doi, publication_date=date,
        is_retracted=F.when(F.lower(x("type")).isin("retraction", "correction"), F.lit(True)), citation_count=count_or_null(x("is-referenced-by-count")),
    )


PUBMED = """
MedlineCitation struct<PMID:struct<_VALUE:string>, Article:struct<ArticleTitle:string, Abstract:struct<AbstractText:array<string>>,
  Journal:struct<Title:string, JournalIssue:struct<PubDate:struct<Year:string,Month:string,Day:string,MedlineDate:string>>>,
  ArticleDate:array<struct<Year:string,Month:string,Day:string>>, AuthorList:struct<Author:array<struct<CollectiveName:string,ForeName:string,LastName:string>>>>>,
PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string,_VALUE:string>>>>"""
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def inner_text(value: Column) -> Column:
    """An element's text without the tags inside it, single-spaced."""
    return F.trim(F.regexp_replace(F.regexp_replace(value, "<[^>]+>", ""), r"\s+", " "))


def pubmed_date(part: Column) -> Column:
    """A date of year, month (number or English name) and day; 1 January of the year where they make none."""
    month = F.coalesce(some(part["Month"]), F.lit("1"))
    number = F.coalesce(month.try_cast("int"), F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(month, 1, 3))).cast("int"))
    day = F.coalesce(some(part["Day"]).try_cast("int"), F.lit(1))
    year = F.when(F.trim(part["Year"]).rlike("^[0-9]+$"), F.trim(part["Year"]).cast("int"))
    return F.coalesce(F.try_to_date(F.format_string("%04d-%02d-%02d", year, number, day), "yyyy-MM-dd"), F.make_date(year, F.lit(1), F.lit(1)))


def pubmed(rows: DataFrame, payload: str) -> DataFrame:
    """PubMed articles, one PubmedArticle element a row; those without a title are left out. Abstract sections are joined by blanks."""
    read = _read(rows, payload, PUBMED, xml=True)
    a = F.col("x.MedlineCitation.Article")
    raw = inner_text(a["ArticleTitle"])
    title = markup_text(raw)
    ids = F.col("x.PubmedData.ArticleIdList.ArticleId")
    of = lambda kind: some(F.element_at(F.filter(ids, lambda i: (i["_IdType"] == kind) & (F.trim(i["_VALUE"]) != "")), -1)["_VALUE"])
    doi, pmid = S.normal_doi(F.when(F.exists(ids, lambda i: i["_IdType"] == "doi"), of("doi"))), some(F.col("x.MedlineCitation.PMID._VALUE"))
    pmcid = F.when(F.exists(ids, lambda i: i["_IdType"] == "pmc"), of("pmc"))
    names = F.transform(F.coalesce(a["AuthorList"]["Author"], F.array().cast("array<struct<CollectiveName:string,ForeName:string,LastName:string>>")), lambda n: F.coalesce(some(n["CollectiveName"]), some(F.concat_ws(" ", some(n["ForeName"]), some(n["LastName"])))))
    issue = a["Journal"]["JournalIssue"]["PubDate"]
    date = F.coalesce(pubmed_date(issue), pubmed_date(F.get(a["ArticleDate"], F.lit(0))), S.partial_date(issue["MedlineDate"]))
    abstract = F.array_join(F.filter(F.transform(a["Abstract"]["AbstractText"], inner_text), lambda t: t != ""), " ")
    source = F.coalesce(pmid, F.substring(S.identity_hash(F.lit("pubmed"), doi, raw), 1, 16))
    found = _records(read.where(raw != ""), "pubmed", [pmid, doi, raw], source_id=source, title=title, abstract=markup_text(abstract), authors=F.array_compact(names), venue=some(a["Journal"]["Title"]), doi=doi, pmid=pmid, pmcid=pmcid, publication_date=date)
    return found


ARXIV = "id string, title string, summary string, published string, author array<struct<name:string>>, doi string, `arxiv:doi` string"


def arxiv(rows: DataFrame, payload: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """arXiv Atom entries, one entry element a row; those without a title are left out, and those with a known date
    outside of first to last (yyyy-MM-dd)."""
    read = _read(rows, payload, ARXIV, xml=True)
    x = lambda c: F.col("x")[c]
    compact = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    title, ident = compact(x("title")), F.regexp_extract(some(x("id")), r"([^/]*)/*$", 1)
    doi = S.normal_doi(F.coalesce(x("arxiv:doi"), x("doi")))
    names = F.transform(F.coalesce(x("author"), F.array().cast("array<struct<name:string>>")), lambda a: some(a["name"]))
    source = F.coalesce(some(ident), F.substring(S.identity_hash(F.lit("arxiv"), doi, title), 1, 16))
    found = _records(read.where(title != ""), "arxiv", [ident, doi, title], source_id=source, title=title, abstract=F.coalesce(compact(x("summary")), F.lit("")), authors=F.array_compact(names), venue=F.lit("arXiv"), doi=doi, arxiv_id=some(ident), publication_date=S.partial_date(x("published")), open_access=F.lit(True))
    day = F.col("publication_date")
    late = F.lit(True) if first is None else day.isNull() | (day >= F.lit(first).cast("date"))
    early = F.lit(True) if last is None else day.isNull() | (day <= F.lit(last).cast("date"))
    return found.where(late & early)


def read_xml_records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Files of many articles or entries as rows with one element's XML each (column xml), for pubmed() and arxiv()."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(rf"(?s)<{tag}[\s>].*?</{tag}>"), F.lit(0))).alias("xml"))
    return text


def generator_csv(spark: SparkSession, path: str, wanted: int) -> DataFrame:
    """(position, smiles): the first ``wanted`` different molecule texts of generated CSV files, in the order of their lines.

    The column is smiles or smile in any case; texts are trimmed, and blank ones and ones with a line
    break left out. Fewer than ``wanted`` are an error.
    """
    table = spark.read.csv(path, header=True, multiLine=True, escape='"')
    names = [c for c in table.columns if c.strip().lower() in ("smiles", "smile")]
    if len(names) != 1:
        raise ValueError("the file needs one column named smiles or smile")
    out = first_texts(table.select(F.trim(F.col(f"`{names[0]}`")).alias("smiles"), F.struct(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i")).alias("place")), "smiles", "place", wanted)
    if out.count() < wanted:
        raise ValueError(f"the files have fewer than {wanted} different molecules")
    return out


def first_texts(rows: DataFrame, text: str, place: str, wanted: int) -> DataFrame:
    """(position, text): the first different texts by place, blank ones and ones with a line break left out."""
    used = rows.where((F.trim(F.coalesce(text, F.lit(""))) != "") & ~F.col(text).rlike("[\r\n]"))
    first = used.groupBy(text).agg(F.min(place).alias("_place")).orderBy("_place").limit(wanted)
    return first.select(F.row_number().over(Window.orderBy("_place")).cast("long").alias("position"), text)  # at most the wanted rows


SITES = "struct<immutable_id:string, last_modified:string, chemical_formula_reduced:string, structure_features:array<string>, assemblies:string, dimension_types:array<int>, nperiodic_dimensions:int, lattice_vectors:array<array<double>>, cartesian_site_positions:array<array<double>>, species_at_sites:array<string>, nsites:int, species:array<struct<name:string, chemical_symbols:array<string>, concentration:array<double>>>>"


def optimade(rows: DataFrame, payload: str) -> DataFrame:
    """OPTIMADE structure resources: record_id, formula, n_sites, symbols (of the sites), lattice, positions and unsupported.

    unsupported says why a resource gives no structure: it isn't one, it is disordered, has implicit atoms
    or assemblies, isn't periodic in three directions, or its arrays are missing or don't agree. Only
    supported resources have sites.
    """
    read = _read(rows, payload, f"id string, type string, attributes {SITES}")
    a = F.col("x.attributes")
    features = F.transform(F.coalesce(a["structure_features"], F.array().cast("array<string>")), lambda f: F.lower(F.trim(f)))
    lattice, positions, at, species = a["lattice_vectors"], a["cartesian_site_positions"], a["species_at_sites"], a["species"]
    bad = lambda n: n.isNull() | F.isnan(n) | (F.abs(n) == float("inf"))
    shaped = lambda m: F.forall(m, lambda v: F.coalesce(F.size(v) == 3, F.lit(False)))
    finite = lambda m: ~F.exists(F.flatten(m), bad)
    names = F.transform(species, lambda s: s["name"])
    one = lambda s: F.coalesce((F.size(s["chemical_symbols"]) == 1) & (F.size(s["concentration"]) == 1), F.lit(False))
    pure = lambda s: F.coalesce(F.get(s["chemical_symbols"], F.lit(0)).rlike("^[A-Z][a-z]?$") & (F.abs(F.get(s["concentration"], F.lit(0)) - 1.0) <= 1e-8), F.lit(False))
    reason = (
        F.when(some(F.col("x.id")).isNull() | ~F.coalesce(F.col("x.type") == "structures", F.lit(False)), "not_a_structure")
        .when(a.isNull(), "attributes_missing")
        .when(F.arrays_overlap(features, F.array(*map(F.lit, ("disorder", "implicit_atoms", "assemblies")))), "unsupported_structure_features")
        .when(a["assemblies"].isNotNull() & (a["assemblies"] != "[]"), "assemblies_not_supported")
        .when((a["dimension_types"] != F.array(F.lit(1), F.lit(1), F.lit(1))) | (a["nperiodic_dimensions"] != 3), "non_three_dimensional_structure")
        .when(lattice.isNull() | (F.size(lattice) != 3) | ~shaped(lattice), "lattice_vectors_missing_or_invalid")
        .when(positions.isNull() | at.isNull(), "site_positions_or_species_at_sites_missing")
        .when((F.size(positions) != F.size(at)) | (F.size(positions) == 0) | ~F.coalesce(a["nsites"] == F.size(positions), F.lit(False)), "site_count_or_site_arrays_inconsistent")
        .when(species.isNull(), "species_definitions_missing")
        .when(F.exists(species, lambda s: some(s["name"]).isNull() | ~one(s)) | (F.size(F.array_distinct(names)) != F.size(names)), "disordered_or_invalid_species_definition")
        .when(F.exists(species, lambda s: ~pure(s)), "partial_or_non_element_species_definition")
        .when(F.size(F.array_except(at, names)) > 0, "species_at_sites_reference_unknown_definition")
        .when(~finite(lattice) | ~finite(positions), "non_finite_lattice_or_site_position")
        .when(~shaped(positions), "cartesian_site_position_shape_invalid")
    )
    symbol = F.map_from_entries(F.transform(species, lambda s: F.struct(s["name"].alias("k"), F.get(s["chemical_symbols"], F.lit(0)).alias("v"))))
    rows_ = read.select("row", "x", reason.alias("unsupported"))
    ok = F.col("unsupported").isNull()
    sites = F.when(ok, F.transform(at, lambda s: F.element_at(symbol, s)))
    return rows_.select("row", some(F.col("x.id")).alias("record_id"), some(a["chemical_formula_reduced"]).alias("formula"), F.when(ok, F.size(at)).alias("n_sites"), sites.alias("symbols"), F.when(ok, lattice).alias("lattice"), F.when(ok, positions).alias("positions"), "unsupported")


def unite(*scans: DataFrame) -> DataFrame:
    """Records of several scans in one table, with source_rank (the scan's place, which settles whose field comes first)."""
    out = None
    for rank, scan in enumerate(scans):
        part = scan.select(*RECORD).withColumn("source_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part)
    return out


def fuse_united(records: DataFrame) -> DataFrame:
    """One row per identity of united records: DOI, PMID, arXiv id, else title and year (see literature.fuse_records).

    Titles and abstracts are the longest, citations the greatest, providers all, flags true if one is;
    ids, venue and date are the first in the order of source_rank and record_id that are known.
    """
    from assaylake.operators.literature import fuse_records, identity_key

    keyed = records.withColumn("key", identity_key(F.col("doi"), F.col("pmid"), F.col("arxiv_id"), F.lower("title"), F.col("publication_year")))
    first = ["record_id", "doi", "pmid", "pmcid", "arxiv_id", "venue", "publication_date", "publication_year"]
    names = keyed.withColumn("providers", F.col("provider"))
    order = names.withColumn("_at", F.struct("source_rank", "record_id"))
    return fuse_records(order, "key", ["_at"], ["title", "abstract"], ["citation_count"], ["providers"], ["is_retracted", "open_access"], first)
