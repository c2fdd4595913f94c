"""Quality by weak supervision, in DataFrame expressions alone.

Rules over text statistics vote for (1), against (-1) or abstain (0). The table of vote patterns is
bounded by 3 to the number of rules whatever the corpus; expectation-maximisation over it, one fold
of SQL's aggregate(), estimates each rule's accuracies (on good and on bad documents) and the share of good ones. A document's
posterior quality probability replaces a filter that all rules must pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.session import materialize

SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
ROUNDS = 25
#: Chances of the votes -1, 0, 1 on bad and on good documents that the rounds start from, and how many
#: documents this start weighs in each of them.
START, SMOOTH = (0.4, 0.5, 0.1, 0.1, 0.5, 0.4), 2.0


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words inside 8-word windows that the text has twice or more, the first included.

    Windows are compared by a 64-bit hash; equal neighbours in hash order give the repeated starts,
    and the gaps between these in text order give the words that they cover.
    """

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twice = F.filter(F.sequence(F.lit(1), F.size(s)), lambda k: ((k > 1) & (F.get(s, k - 1)["h"] == F.get(s, k - 2)["h"])) | ((k < F.size(s)) & (F.get(s, k - 1)["h"] == F.get(s, k)["h"])))
            return F.sort_array(F.transform(twice, lambda k: F.get(s, k - 1)["i"]))

        def total(p: Column) -> Column:
            return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"), i.alias("at")), lambda a: a["n"])

        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(pairs, lambda s: let(starts(s), total))).otherwise(0)

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) > WINDOW, let(windows, covered)).otherwise(0)


def text_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id and the counts that the rules read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    first = let(words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r"), F.size(F.array_distinct(w)).alias("d"), F.size(F.filter(w, lambda x: x.rlike(f"[{SYMBOLS}]"))).alias("m")))
    second = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), first.alias("w"), second.alias("l"),
        F.length(F.translate(text, SPACE, "")).alias("c"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("s"),
        F.regexp_count(text, F.lit(r"[.!?][\"')\]]*(?:[\x20\x09-\x0D]|$)")).alias("e"),
    )
    named = {"n_words": "w.n", "word_chars": "c", "n_symbols": "s", "n_dup_lines": "l.d", "n_repeat_words": "w.r", "n_lines": "l.n", "n_distinct": "w.d", "n_ends": "e", "n_marked": "w.m"}
    return rows.select("doc_id", *[F.col(c).cast("long").alias(n) for n, c in named.items()])


def vote(good: str, bad: str) -> Column:
    return F.when(F.expr(bad), F.lit(-1)).when(F.expr(good), F.lit(1)).otherwise(F.lit(0))


#: Name, condition for a vote for, condition for a vote against (which goes first). What nearly every
#: text fulfils gives no vote for it, so that it doesn't outweigh the telling rules.
RULES = {
    "word_length": ("false", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    "symbols": ("50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    "symbol_chars": ("500 * n_symbols <= word_chars", "100 * n_symbols > 4 * word_chars"),
    "marked_words": ("50 * n_marked <= n_words", "8 * n_marked > n_words"),
    "dup_lines": ("n_dup_lines = 0 and n_lines >= 2", "10 * n_dup_lines > 3 * n_lines"),
    "repeats": ("n_repeat_words = 0 and n_words >= 20", "100 * n_repeat_words > 20 * n_words"),
    "length": ("false", "n_words < 20"),
    "sentences": ("n_ends > 0 and n_words between 2 * n_ends and 60 * n_ends", "n_words > 200 * n_ends and n_words >= 20"),
    "variety": ("false", "n_words >= 20 and n_distinct * n_distinct < n_words"),
}


def weights(cells: Column) -> Column:
    """Log likelihood ratio of good to bad for the votes -1, 0, 1 of a rule, from its six cells.

    A vote against never speaks for a document, a vote for never against it, an abstention for nothing.
    """
    against = F.least(F.lit(0.0), F.log(F.get(cells, 3) / F.get(cells, 0)))
    favour = F.greatest(F.lit(0.0), F.log(F.get(cells, 5) / F.get(cells, 2)))
    return F.array(against, F.lit(0.0), favour)


def fit(votes: DataFrame) -> dict:
    """prior and, per rule, the weights of its three votes, from the counts of vote patterns over all documents.

    A rule's cells are the chances of its votes -1, 0, 1 on bad and on good documents.
    """
    rules, total = len(RULES), lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))
    patterns = votes.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    table = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("p"))

    def e_step(s: Column) -> Column:
        odds = F.log(s["prior"] / (1 - s["prior"]))
        score = lambda x, w: odds + F.aggregate(F.zip_with(x["votes"], w, lambda v, u: F.get(u, v + 1)), F.lit(0.0), lambda a, b: a + b)
        return let(F.transform(s["cells"], weights), lambda w: F.transform("p", lambda x: F.struct(x["votes"].alias("v"), x["n"].alias("n"), (1 / (1 + F.exp(-score(x, w)))).alias("q"))))

    def m_step(posts: Column) -> Column:
        good = total(posts, lambda x: x["n"] * x["q"])
        every = total(posts, lambda x: x["n"])
        prior = F.least(F.lit(0.98), F.greatest(F.lit(0.02), (good + 5.0) / (every + 10.0)))

        def cell(j: Column, v: int, is_good: int) -> Column:
            share = (lambda x: x["q"]) if is_good else (lambda x: 1 - x["q"])
            hits = total(posts, lambda x: F.when(F.get(x["v"], j) == v, x["n"] * share(x)).otherwise(0.0))
            return (hits + SMOOTH * START[3 * is_good + v + 1]) / ((good if is_good else every - good) + SMOOTH)

        cells = F.transform(F.sequence(F.lit(0), F.lit(rules - 1)), lambda j: F.array(*[cell(j, v, g) for g in (0, 1) for v in (-1, 0, 1)]))
        return F.struct(prior.alias("prior"), cells.alias("cells"))

    start = F.struct(F.lit(0.5).alias("prior"), F.array_repeat(F.array(*map(F.lit, START)), rules).alias("cells"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, _: let(e_step(s), m_step))
    found = table.select(end.alias("m")).select("m.prior", F.transform("m.cells", weights).alias("w")).first()
    return {"prior": found["prior"], "weights": [list(w) for w in found["w"]]}


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id, the counts, votes, base_failed, quality (posterior probability) and kept.

    base_failed: under 20 words, or more than 30 % of the words in repeated 8-word windows. kept is
    false then, else quality >= threshold. A null text counts as empty; ids may be null or repeated
    and every row has its own result; an empty table gives an empty one; other columns are ignored.
    """
    counts = text_counts(docs, id_col, text_col)
    voted = materialize(counts.withColumn("votes", F.array(*[vote(g, b) for g, b in RULES.values()])), "votes")
    model = fit(voted)
    score = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for j, w in enumerate(model["weights"]):
        score = score + F.get(F.array(*map(F.lit, w)), F.get("votes", F.lit(j)) + 1)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    quality = 1 / (1 + F.exp(-score))
    return voted.withColumn("base_failed", failed).withColumn("quality", F.round(quality, 9)).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
