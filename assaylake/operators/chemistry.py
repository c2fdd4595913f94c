"""Formula tables: elements with amounts, reduced keys and element shares."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The element symbols in the order of their atomic numbers.
ELEMENTS = """
H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr
Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir
Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl
Mc Lv Ts Og
""".split()
NUMBER = {symbol: i + 1 for i, symbol in enumerate(ELEMENTS)}
TOKEN = re.compile(r"([A-Z][a-z]?)|(\d+(?:\.\d*)?|\.\d+)|([()])|(.)", re.S)


def formula_counts(formula: str | None) -> tuple[dict[str, float] | None, str | None]:
    """Amount of each element of a formula with nested brackets and decimals, by atomic number, or an error.

    Spaces don't count. An amount must follow an element or a bracket and be above zero and finite; a
    symbol that is no element, an empty bracket's amount and brackets that don't match are errors.
    """
    stack: list[dict[str, float]] = [{}]
    last: dict[str, float] | None = None
    tokens = TOKEN.findall((formula or "").replace(" ", ""))
    if not tokens:
        return None, "empty_formula"
    for symbol, number, bracket, other in tokens:
        if other:
            return None, "unknown_character"
        if number:
            if last is None or not 0 < float(number) < float("inf"):
                return None, "misplaced_or_zero_amount"
            for k in last:
                stack[-1][k] += last[k] * (float(number) - 1)
            last = None
        elif symbol:
            if symbol not in NUMBER:
                return None, "unknown_element"
            last = {symbol: 1.0}
            stack[-1][symbol] = stack[-1].get(symbol, 0.0) + 1.0
        elif bracket == "(":
            stack.append({})
            last = None
        else:
            if len(stack) == 1:
                return None, "unbalanced_brackets"
            last = stack.pop()
            for k, v in last.items():
                stack[-1][k] = stack[-1].get(k, 0.0) + v
    if len(stack) > 1:
        return None, "unbalanced_brackets"
    if not stack[0]:
        return None, "empty_formula"
    return dict(sorted(stack[0].items(), key=lambda item: NUMBER[item[0]])), None


def formula_elements(rows: DataFrame, entity: str, formula: str) -> DataFrame:
    """entity, counts (map), error; a broken formula has an error and no counts."""

    @F.pandas_udf("counts map<string,double>, error string")
    def parse(column: pd.Series) -> pd.DataFrame:
        known = {x: formula_counts(x) for x in column.unique()}
        return pd.DataFrame([known[x] for x in column], columns=["counts", "error"])

    return rows.select(entity, parse(formula).alias("p")).select(entity, "p.counts", "p.error")


def reduced_formula(counts: Column) -> Column:
    """Alphabetical formula by the greatest common divisor of whole amounts of a map; null for other amounts."""
    amounts = F.map_values(counts)
    whole = F.forall(amounts, lambda v: v == F.floor(v)) & (F.size(amounts) > 0)
    # Euclid's steps as a fold: at most 64 of them bring two numbers of 63 bits to their divisor.
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    steps = F.sequence(F.lit(1), F.lit(96))
    euclid = lambda x, y: F.aggregate(steps, pair(x, y), lambda s, _: F.when(s["b"] == 0, s).otherwise(pair(s["b"], s["a"] % s["b"])))["a"]
    divisor = F.aggregate(amounts, F.lit(0).cast("long"), lambda d, v: euclid(v.cast("long"), d))
    text = lambda k, d: F.concat(k, F.when(F.element_at(counts, k).cast("long") == d, F.lit("")).otherwise((F.element_at(counts, k) / d).cast("long").cast("string")))
    # The divisor is bound by a list of one: named inside, it would be computed twice an element.
    of = F.transform(F.array(divisor), lambda d: F.array_join(F.transform(F.array_sort(F.map_keys(counts)), lambda k: text(k, d)), ""))
    return F.when(whole, F.get(of, F.lit(0)))


def chemical_system(symbols: Column, least: int = 1) -> Column:
    """Element symbols in alphabetical order, each once, joined by "-"; null where one is no element or fewer than least remain."""
    once = F.array_sort(F.array_distinct(symbols))
    known = F.size(F.array_except(once, F.array(*map(F.lit, ELEMENTS)))) == 0
    return F.when(known & (F.size(once) >= least), F.array_join(once, "-"))


def composition_scope(key: Column, reduced: Column, representations: Column, formulas: Column) -> Column:
    """The first that isn't blank of an attribute's key, a reduced formula, the canonical formula among the
    representations (structs of kind, canonical, value) and the first formula given, without white space."""
    canonical = F.get(F.filter(representations, lambda r: (r["kind"] == "formula") & r["canonical"]), 0)["value"]
    bare = lambda x: F.regexp_replace(x, r"\s+", "")
    some = lambda x: F.when(bare(x) != "", bare(x))
    return F.coalesce(some(key), some(reduced), some(canonical), some(F.get(formulas, 0)))


def composition_rules(rows: DataFrame, entity: str, formula: str) -> DataFrame:
    """entity, warning, formula_validity, element_count, atom_count and elements (by atomic number) of a formula; a valid
    formula says nothing about charges, structure or stability."""
    parsed = formula_elements(rows, entity, formula)
    valid, counts = F.col("error").isNull(), F.col("counts")
    warning = F.when(F.col("error") == "empty_formula", "no_formula").otherwise(F.col("error"))
    amount = F.aggregate(F.map_values(counts), F.lit(0.0), lambda a, x: a + x)
    return parsed.select(entity, warning.alias("warning"), valid.alias("formula_validity"), F.when(valid, F.size(counts)).cast("long").alias("element_count"), F.when(valid, amount).alias("atom_count"), F.array_join(F.map_keys(counts), ",").alias("elements"))
