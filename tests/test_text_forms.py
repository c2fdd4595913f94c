"""The normal form of texts against the definition, for every code point."""

import html
import re
import unicodedata

from pyspark.sql import functions as F

from assaylake.functions.text_forms import normal_form


def plain(value):
    return None if value is None else re.sub(r"\s+", " ", html.unescape(unicodedata.normalize("NFKC", value))).strip().casefold()


def test_every_code_point(spark):
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"A{''.join(points[i : i + 64])}z" for i in range(0, len(points), 64)] + [f"{a}́ B" for a in points[:700]] + points[:300]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    assert {r.id: r.form for r in df.select("id", normal_form(F.col("text")).alias("form")).collect()} == {i: plain(t) for i, t in enumerate(texts)}


def test_odd_texts(spark):
    texts = [None, "", "  ", "A\t\n b ", "&AMP; &lt;X&gt; &#65; &nbsp;&eacute;", "&notit;", "ﬁ Straße ΣΑΣ İI", "Å", "x\x1cy\x1f", " a　", "K" * 10_000 + "é"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert {r.id: r.form for r in df.select("id", normal_form(F.col("text")).alias("form")).collect()} == {i: plain(t) for i, t in enumerate(texts)}
    assert df.limit(0).select(normal_form(F.col("text"))).collect() == []
