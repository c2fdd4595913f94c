"""Scalar functions over columns: utilities, gates, units, distances, identities and text rules.

Nothing here is zero, passed or averaged where an input is missing: the result is null or unknown.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factors to angstrom, to gigapascal and to electronvolt an atom.
LENGTH_UNITS = {"a": 1.0, "angstrom": 1.0, "å": 1.0, "nm": 10.0, "pm": 0.01, "m": 1.0e10, "bohr": 0.529177210903}
STRESS_UNITS = {"gpa": 1.0, "ev/a^3": 160.2176634, "ev/å^3": 160.2176634, "kbar": 0.1, "mpa": 0.001, "pa": 1.0e-9}
ENERGY_UNITS = {"ev/atom": 1.0, "mev/atom": 0.001}


def rounded(x: Column, digits: int = 4) -> Column:
    """Half-up rounding by floor, alike in every engine."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def reasons(**flags: Column) -> Column:
    """Sorted array of the names whose condition holds."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()])))


def joined(codes: Column) -> Column:
    return F.array_join(codes, ";")


def unit_factor(unit: Column, table: Mapping[str, float]) -> Column:
    """Factor of a unit, null where it is missing or unknown."""
    return F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), F.lower(F.trim(unit)))


def length_scales(left: Column, right: Column) -> Column:
    """Struct of two factors to angstrom: 1 and 1 where both units are missing, null where one is or is unknown."""
    a, b = unit_factor(left, LENGTH_UNITS), unit_factor(right, LENGTH_UNITS)
    both = F.struct(a.alias("l"), b.alias("r"))
    return F.when(left.isNull() & right.isNull(), F.struct(F.lit(1.0).alias("l"), F.lit(1.0).alias("r"))).when(a.isNotNull() & b.isNotNull(), both)


def selector_utility(value: Column, direction: Column, target: Column, low: Column, high: Column) -> Column:
    """(utility, reason): values outside bounds are excluded; range needs bounds and is worth 1 inside."""
    outside = F.coalesce(value < low, F.lit(False)) | F.coalesce(value > high, F.lit(False))
    reason = (
        F.when(value.isNull() | F.isnan(value), F.lit("missing_value"))
        .when(outside, F.lit("bound_violated"))
        .when((direction == "target") & target.isNull(), F.lit("target_missing"))
        .when((direction == "range") & (low.isNull() | high.isNull()), F.lit("range_bounds_missing"))
        .when((direction == "satisfy") & low.isNull() & high.isNull() & (target.isNull() | (value != target)), F.lit("not_satisfied"))
    )
    worth = F.when(direction == "maximize", value).when(direction == "minimize", -value).when(direction == "target", -F.abs(value - target)).otherwise(F.lit(1.0))
    return F.struct(F.when(reason.isNull(), worth).alias("utility"), reason.alias("reason"))


def goal_utility(value: Column, direction: Column, target: Column, low: Column, high: Column) -> Column:
    """Without a bound check; range: 0 inside, minus the distance outside; satisfy: null."""
    away = F.greatest(low - value, value - high, F.lit(0.0))
    return F.when(direction == "maximize", value).when(direction == "minimize", -value).when(direction == "target", -F.abs(value - target)).when(direction == "range", -away)


def controller_utility(value: Column, direction: Column, target: Column, low: Column, high: Column) -> Column:
    """Range: 1 inside, outside minus the distance to the nearer bound; satisfy: 1 or 0."""
    inside = (value >= low) & (value <= high)
    away = -F.least(F.abs(value - low), F.abs(value - high))
    met = F.coalesce(value >= low, F.lit(True)) & F.coalesce(value <= high, F.lit(True)) & F.coalesce(value == target, F.lit(True))
    return F.when(direction == "maximize", value).when(direction == "minimize", -value).when(direction == "target", -F.abs(value - target)).when(direction == "range", F.when(inside, F.lit(1.0)).otherwise(away)).when(direction == "satisfy", F.when(met, F.lit(1.0)).otherwise(F.lit(0.0)))


def signed_improvement(off: Column, on: Column, direction: Column, target: Column, low: Column, high: Column) -> Column:
    """How much better on is than off: by value, or by the distance to a target or range that goes away."""
    away = lambda v: F.greatest(low - v, v - high, F.lit(0.0))
    return F.when(direction == "maximize", on - off).when(direction == "minimize", off - on).when(direction == "target", F.abs(off - target) - F.abs(on - target)).when(direction == "range", away(off) - away(on))


def interval_utility(low: Column, high: Column, direction: Column, target: Column) -> Column:
    """(worst, best) of an interval: target and range go by the distance to the target or the range's middle."""
    far, near = F.greatest(F.abs(low - target), F.abs(high - target)), F.least(F.abs(low - target), F.abs(high - target))
    near = F.when((low <= target) & (target <= high), F.lit(0.0)).otherwise(near)
    worst = F.when(direction == "maximize", low).when(direction == "minimize", -high).otherwise(-far)
    best = F.when(direction == "maximize", high).when(direction == "minimize", -low).otherwise(-near)
    return F.struct(worst.alias("worst"), best.alias("best"))


def interval_gate(low: Column, high: Column, minimum: Column, maximum: Column) -> Column:
    """not_configured, fail (wholly outside), unknown (no interval, or across a limit) or pass."""
    no_limit = minimum.isNull() & maximum.isNull()
    fails = F.coalesce(high < minimum, F.lit(False)) | F.coalesce(low > maximum, F.lit(False))
    straddles = F.coalesce(low < minimum, F.lit(False)) | F.coalesce(high > maximum, F.lit(False))
    return F.when(no_limit, "not_configured").when(low.isNull() | high.isNull(), "unknown").when(fails, "fail").when(straddles, "unknown").otherwise("pass")


def constraint_met(value: Column, operator: Column, first: Column, second: Column) -> Column:
    return F.when(operator == "eq", value == first).when(operator == "ne", value != first).when(operator == "gt", value > first).when(operator == "gte", value >= first).when(operator == "lt", value < first).when(operator == "lte", value <= first).when(operator == "between", (value >= first) & (value <= second))


# Words in a property's name that suggest its direction.
MAXIMIZED = ["conductivity", "capacity", "voltage", "critical_temperature", "turnover", "selectivity", "durability", "absorption", "slme", "zt", "coercivity", "remanence", "curie", "polarization", "piezoelectric", "yield", "toughness", "uptake", "mobility"]
MINIMIZED = ["energy_above_hull", "resistance", "overpotential", "degradation", "force", "leakage", "loss"]


def direction_of(name: Column) -> Column:
    """Optimisation direction that a property's name suggests; the words for more go first."""
    low = F.lower(name)
    return F.when(low.rlike("|".join(MAXIMIZED)), "maximize").when(low.rlike("|".join(MINIMIZED)), "minimize").otherwise("user_defined")


def frobenius_stress(xx: Column, yy: Column, zz: Column, yz: Column, xz: Column, xy: Column) -> Column:
    return F.sqrt(xx * xx + yy * yy + zz * zz + 2 * (yz * yz + xz * xz + xy * xy))


def checked_stress(norm: Column, *components: Column) -> Column:
    """A stated stress norm that agrees with its six components within 1e-9 (of 1 or the norm); null if it doesn't."""
    own = frobenius_stress(*components)
    return F.when(F.abs(norm - own) <= 1e-9 * F.greatest(F.lit(1.0), own), norm)


def lattice_distance(first: Column, second: Column) -> Column:
    """Frobenius distance of two 3 x 3 lattices; null for other shapes."""
    shaped = lambda m: (F.size(m) == 3) & F.forall(m, lambda v: F.size(v) == 3)
    squares = F.zip_with(F.flatten(first), F.flatten(second), lambda x, y: (x - y) * (x - y))
    return F.when(shaped(first) & shaped(second), F.sqrt(total(squares)))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def track_delta(reference: Column, alternate: Column) -> Column:
    """Mean absolute difference over the common prefix of the finite values; null without one."""
    finite = lambda xs: F.filter(xs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    a, b = finite(reference), finite(alternate)
    n = F.least(F.size(a), F.size(b))
    gaps = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.abs(x - y))
    return F.when(n > 0, total(gaps) / n)


def variant_priority(effects: Column, uncertainty: Column, literature: Column, disagreement: Column) -> Column:
    known = F.array_compact(effects)
    return total(known) / F.size(known) * (1 - 0.5 * uncertainty) + 0.2 * literature - 0.1 * disagreement


def component_rmse(first: Column, second: Column) -> Column:
    """Root mean square over xyz of two arrays of vectors; null where their lengths differ or are zero."""
    squares = F.zip_with(first, second, lambda a, b: total(F.zip_with(F.slice(a, 1, 3), F.slice(b, 1, 3), lambda x, y: (x - y) * (x - y))))
    return F.when((F.size(first) == F.size(second)) & (F.size(first) > 0), F.sqrt(total(squares) / (3 * F.size(first))))


def vector_rms(first: Column, second: Column) -> Column:
    """Root mean square of the vectors' distances (per vector, not per component)."""
    squares = F.zip_with(first, second, lambda a, b: total(F.zip_with(F.slice(a, 1, 3), F.slice(b, 1, 3), lambda x, y: (x - y) * (x - y))))
    return F.when((F.size(first) == F.size(second)) & (F.size(first) > 0), F.sqrt(total(squares) / F.size(first)))


def largest_vector_gap(first: Column, second: Column) -> Column:
    gaps = F.zip_with(first, second, lambda a, b: F.sqrt(total(F.zip_with(F.slice(a, 1, 3), F.slice(b, 1, 3), lambda x, y: (x - y) * (x - y)))))
    return F.when((F.size(first) == F.size(second)) & (F.size(first) > 0), F.array_max(gaps))


def fractions(counts: Column) -> Column:
    """Map of amounts to map of shares; null unless the amounts sum to more than 0."""
    whole = total(F.map_values(counts))
    return F.when(whole > 0, F.transform_values(counts, lambda k, v: v / whole))


def total_variation(left: Column, right: Column) -> Column:
    gaps = F.map_zip_with(left, right, lambda k, a, b: F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))))
    return total(F.map_values(gaps)) / 2


def jensen_shannon(left: Column, right: Column) -> Column:
    """Divergence in bits between two maps of shares."""

    def part(k: Column, a: Column, b: Column) -> Column:
        a, b = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
        half = lambda x: F.when(x > 0, x * F.log2(2 * x / (a + b))).otherwise(F.lit(0.0))
        return (half(a) + half(b)) / 2

    return total(F.map_values(F.map_zip_with(left, right, part)))


def sequence_distance(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; 0 for two empty ones."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longer)


def fasta_sequence(text: Column, alphabet: str) -> Column:
    """Sequence of a single-record FASTA text or a plain one; null for several records or other letters."""
    records = F.regexp_count(text, F.lit("(?m)^>"))
    body = F.upper(F.regexp_replace(F.regexp_replace(text, "(?m)^>.*$", ""), r"\s+", ""))
    return F.when((records <= 1) & body.rlike(f"^[{alphabet}]+$"), body)


def normal_doi(value: Column) -> Column:
    bare = F.lower(F.trim(F.regexp_replace(F.trim(value), r"(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)", "")))
    return F.when(bare != "", bare)


def clean_markup(value: Column) -> Column:
    """Tags become blanks, the five basic references are decoded, white space collapses."""
    text = F.regexp_replace(value, "<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0b]+", " "))


def routing_text(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), r"[\s_-]+", " "))


def spaced_text(value: Column) -> Column:
    """Lower case with each run of white space as one blank."""
    return F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))


def word_text(value: Column) -> Column:
    """Lower case with each run of other signs than letters, digits and underscores as one blank."""
    return F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}_]+", " "))


def partial_date(value: Column) -> Column:
    """y-m-d, y-m or y from the first ten characters, else 1 January of any 19xx or 20xx there."""
    head = F.substring(F.trim(value), 1, 10)
    year = F.regexp_extract(head, r"(19|20)\d\d", 0)
    return F.coalesce(F.try_to_date(head, "yyyy-MM-dd"), F.try_to_date(head, "yyyy-MM"), F.try_to_date(head, "yyyy"), F.try_to_date(F.when(year != "", year), "yyyy"))


def tri_state(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin("true", "1", "yes", "y", "t"), F.lit(True)).when(low.isin("false", "0", "no", "n", "f"), F.lit(False))


def mentions(haystack: Column, needle: Column) -> Column:
    """Whether needle stands in haystack between characters that aren't letters or digits; both in lower case."""
    escaped = F.regexp_replace(needle, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    return F.rlike(haystack, F.concat(F.lit("(^|[^a-z0-9])"), escaped, F.lit("([^a-z0-9]|$)")))


def identity_hash(*parts: Column) -> Column:
    """Hash of the parts as a JSON list of texts and nulls, so that no two lists of parts share a form."""
    texts = F.to_json(F.array(*[p.cast("string") for p in parts]), {"ignoreNullFields": "false"})
    return F.sha2(texts, 256)


def sampling_seed(*parts: Column) -> Column:
    """Unsigned 32-bit seed of the parts."""
    return F.conv(F.substring(identity_hash(*parts), 1, 8), 16, 10).cast("long")


def canonical_number(value: Column) -> Column:
    """A numeric text in one form (300.0 and 300 are equal), other texts as they are."""
    number = value.try_cast("double")
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(number.isNull() | F.lower(value).isin("nan", "inf", "infinity", "-inf"), value).when(whole, number.cast("long").cast("string")).otherwise(number.cast("string"))


def is_missing(value: Column) -> Column:
    """Whether a text is null or blank."""
    return value.isNull() | (F.trim(value) == "")


def is_empty(value: Column) -> Column:
    """Whether an array or map is null or has nothing."""
    return value.isNull() | (F.size(value) == 0)


def is_ascii_form(value: Column) -> Column:
    """Whether a text has ASCII alone and nothing that could be a character reference."""
    return ~value.rlike(r"[^\x00-\x7f]|&")
