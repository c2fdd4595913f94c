"""Normal form of texts: compatibility composition, character references, one space, full case folding.

Texts of plain ASCII, nearly all of a corpus, stay in the JVM: there the form is lower case. Only
others are sent to a worker's Unicode tables, as Arrow batches; Spark has no function for them.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from assaylake.functions.scalars import is_ascii_form

SPACE = re.compile(r"\s+")


def normal_text(value: str | None) -> str | None:
    """NFKC, then character references, then white space to single spaces without ends, then case folding."""
    if value is None:
        return None
    return SPACE.sub(" ", html.unescape(unicodedata.normalize("NFKC", value))).strip().casefold()


@F.pandas_udf(StringType())
def _normal(values: pd.Series) -> pd.Series:
    return values.map(normal_text, na_action="ignore")


def normal_form(value: Column) -> Column:
    """normal_text of a column; null stays null."""
    plain = is_ascii_form(value)
    simple = F.lower(F.btrim(F.regexp_replace(value, r"[ \t-\r\x1c-\x1f]+", " ")))
    return F.when(plain, simple).otherwise(_normal(F.when(~plain, value)))
