"""Rules of text, identity, geometry and control over columns: support by the text itself, secret keys, contracts, targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaylake.functions import scalars as S
from assaylake.operators.chemistry import ELEMENTS

# Parts of keys that name a secret.
SECRET_MARKERS = ["api_key", "access_key", "private_key", "client_secret", "token", "secret", "password", "credential", "authorization", "bearer"]
#: Identity receipts of this canonical form alone count.
CANONICAL_FORM = "source-niggli-no-symmetry-v2"
# Roles of tensors whose first axis follows the candidate.
DYNAMIC_ROLES = ["atom_embedding", "cell_embedding", "token_embedding"]
# Search priors of the branches for the energy above the hull, in eV an atom, and the thresholds.
HULL_PRIORS = {"stability": 0.0, "expert_disagreement": 0.03, "novelty": 0.08, "target_property": 0.03, "pareto": 0.05}
HULL_STABLE, HULL_EXPLORE, DISAGREEMENT = 0.03, 0.05, 0.25


def plain_text(value: Column) -> Column:
    """Lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))


def number_supported(value: Column, text: Column) -> Column:
    """Whether a number stands in the text by itself: not inside a longer number; 300.0 may stand as 300."""
    whole = F.when(value == F.floor(value), value.cast("long").cast("string"))
    forms = F.array_compact(F.array(value.cast("string"), whole))
    found = lambda form: F.rlike(text, F.concat(F.lit(r"(?<![0-9.])"), F.regexp_replace(form, r"([.+])", r"\\$1"), F.lit(r"(?![0-9.])")))
    return F.coalesce(F.exists(forms, found), F.lit(False))


def phrase_supported(value: Column, text: Column) -> Column:
    """Whether a text that isn't blank stands in the text, both in plain form."""
    return F.coalesce((plain_text(value) != "") & F.contains(plain_text(text), plain_text(value)), F.lit(False))


def any_supported(values: Column, text: Column) -> Column:
    """Whether one of an array of texts stands in the text."""
    return F.coalesce(F.exists(values, lambda v: phrase_supported(v, text)), F.lit(False))


def first_entity(text: Column) -> Column:
    """The first run of one to four capitalised words."""
    found = F.regexp_extract(text, r"\b[A-Z][A-Za-z0-9+\-]{1,30}(?:\s+[A-Z][A-Za-z0-9+\-]{1,30}){0,3}\b", 0)
    return F.when(found != "", found)


def quantities(text: Column, unit: str, any_case: bool) -> Column:
    """Sorted distinct numbers that stand before a unit."""
    found = F.regexp_extract_all(text, F.lit(("(?i)" if any_case else "") + rf"(-?\d+(?:\.\d+)?)\s*{unit}\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("double"))))


def text_elements(text: Column) -> Column:
    """Sorted element symbols that a text shows."""
    found = F.regexp_extract_all(text, F.lit("(?<![a-z])[A-Z][a-z]?"), F.lit(0))
    return F.array_sort(F.array_intersect(F.array_distinct(found), F.array(*map(F.lit, ELEMENTS))))


def text_system(text: Column) -> Column:
    """Elements of a text joined by "-", null for fewer than two."""
    return F.when(F.size(text_elements(text)) >= 2, F.array_join(text_elements(text), "-"))


def json_keys(document: Column) -> Column:
    """Keys of a JSON text at any depth, in lower case with every other sign than letters and digits as one underscore."""
    both = lambda i: F.regexp_extract_all(document, F.lit(r'"((?:[^"\\]|\\.)*)"(\s*:)?'), F.lit(i))
    keys = F.filter(F.arrays_zip(both(1).alias("k"), both(2).alias("c")), lambda x: x["c"] != "")
    return F.transform(keys, lambda x: F.regexp_replace(F.regexp_replace(F.lower(x["k"]), "[^a-z0-9]+", "_"), "^_|_$", ""))


def secret_keys(document: Column) -> Column:
    """Sorted distinct keys of a JSON text that name a secret."""
    return F.array_sort(F.array_distinct(F.filter(json_keys(document), lambda k: k.rlike("|".join(SECRET_MARKERS)))))


def cell_expression(document: Column, most: int = 65_536) -> Column:
    """Struct of rows (gene, value), semantics and error of a JSON text with genes, values and value_semantics alone."""
    keys = F.json_object_keys(document)
    read = F.from_json(document, "genes array<string>, values array<double>, value_semantics string")
    genes = F.transform(read["genes"], lambda g: F.trim(g))
    values = read["values"]
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    error = (
        F.when(keys.isNull(), "not_an_object")
        .when((F.size(keys) != 3) | (F.array_sort(keys) != F.array(*map(F.lit, ("genes", "value_semantics", "values")))), "other_keys")
        .when(read["genes"].isNull() | values.isNull(), "no_arrays")
        .when(F.size(genes) != F.size(values), "lengths_differ")
        .when((F.size(genes) < 1) | (F.size(genes) > most), "gene_count")
        .when(~F.coalesce(read["value_semantics"].isin("raw_counts", "normalized_log1p"), F.lit(False)), "unknown_semantics")
        .when(F.exists(genes, lambda g: g.isNull() | (g == "") | (F.length(g) > 256)), "invalid_gene")
        .when(F.exists(values, lambda v: ~finite(v)), "not_finite")
        .when(F.size(F.array_distinct(genes)) != F.size(genes), "duplicate_gene")
    )
    rows = F.arrays_zip(genes.alias("gene"), values.alias("value"))
    return F.struct(F.when(error.isNull(), rows).alias("rows"), F.when(error.isNull(), read["value_semantics"]).alias("semantics"), error.alias("error"))


def geometry_reasons(volume: Column, atoms: Column, nearest: Column, occupancies: Column, least: float = 0.1, most: float = 1e6, distance: float = 0.5) -> Column:
    """Why a structure's supplied numbers can't be: empty when they can. One atom has no nearest distance."""
    each = volume / atoms
    return S.reasons(
        atoms_missing=atoms.isNull() | (atoms < 1),
        volume_not_positive=volume.isNull() | F.isnan(volume) | (volume <= 0),
        volume_per_atom_out_of_range=F.coalesce((each < least) | (each > most), F.lit(False)),
        atoms_too_close=F.coalesce((atoms > 1) & (nearest.isNull() | (nearest < distance)), F.lit(False)),
        occupancy_above_one=F.coalesce(F.exists(occupancies, lambda x: x > 1 + 1e-8), F.lit(False)),
        occupancy_not_positive=F.coalesce(F.exists(occupancies, lambda x: x <= 0), F.lit(False)),
    )


def hull_target(explicit: Column, n_values: Column, n_stable: Column, disagreement: Column, improvement: Column, branch: Column) -> Column:
    """The next target: the goal's own, else the branch's prior without values, 0 while under half are stable, then the
    branch's prior, the threshold where models disagree, 0 after an improvement, and else the exploration target."""
    prior = F.element_at(F.create_map(*[F.lit(x) for p in HULL_PRIORS.items() for x in p]), branch)
    later = F.coalesce(prior, F.when(disagreement >= DISAGREEMENT, HULL_STABLE), F.when(improvement > 0, 0.0), F.lit(HULL_EXPLORE))
    return F.when(explicit.isNotNull(), F.round(explicit, 8)).when(n_values == 0, prior).when(2 * n_stable < n_values, F.lit(0.0)).otherwise(later)


def shape_contract(role: Column, shape: Column, has_entities: Column) -> Column:
    """Hash of a tensor's rank and fixed dimensions; axes that follow the candidate don't count: two of a hamiltonian, else
    one of the dynamic roles and of tensors with entity ids."""
    one = (F.size(shape) > 0) & (role.isin(*DYNAMIC_ROLES) | has_entities)
    axes = F.when((role == "hamiltonian") & (F.size(shape) >= 2), 2).when(one, 1).otherwise(0)
    fixed = F.slice(shape, axes + 1, F.size(shape) - axes)
    return S.identity_hash(F.size(shape), axes, F.array_join(F.transform(fixed, lambda x: x.cast("string")), ","))


def collapse_reasons(reasons: Column) -> Column:
    """The reasons that say structural collapse themselves; sorted, each once."""
    return F.array_sort(F.array_distinct(F.filter(reasons, lambda r: F.lower(F.trim(r)).startswith("structural_collapse:"))))


def attested_key(digest: Column, receipts: Column, form: str = CANONICAL_FORM) -> Column:
    """Identity key of a 64-digit digest that a representation's receipt (struct of digest, form) repeats; else null."""
    same = F.exists(receipts, lambda r: (r["digest"] == digest) & (r["form"] == form))
    return F.when(digest.rlike("^[0-9a-f]{64}$") & F.coalesce(same, F.lit(False)), F.concat(F.lit("attested-crystal-hash:"), digest))


def common_rules(candidate: Column, values: Column, parents: Column, stated_hash: Column, content_hash: Column) -> Column:
    """Struct of representation_valid, lineage_valid and content_hash_valid (false without a stated hash)."""
    shown = (F.size(values) > 0) & F.forall(values, lambda v: F.coalesce(F.trim(v) != "", F.lit(False)))
    lineage = ~F.array_contains(parents, candidate) & (F.size(F.array_distinct(parents)) == F.size(parents))
    return F.struct(shown.alias("representation_valid"), lineage.alias("lineage_valid"), F.coalesce(stated_hash == content_hash, F.lit(False)).alias("content_hash_valid"))


def display_order(group: Column, rank: Column, completeness: Column, candidate: Column) -> list[Column]:
    """Sort keys of a portfolio: comparison group (unscored last), rank, completeness from the top, id."""
    return [group.asc_nulls_last(), rank.asc_nulls_last(), completeness.desc(), candidate.asc()]
