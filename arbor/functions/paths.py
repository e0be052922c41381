"""Path expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _composed(paths: pd.Series) -> pd.Series:
    return paths.map(lambda p: None if p is None else unicodedata.normalize("NFC", p))


def composed(text: Column) -> Column:
    """NFC. Plain ASCII stays in the JVM: only other rows carry their text to Python."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, text).otherwise(_composed(F.when(plain, F.lit(None).cast("string")).otherwise(text)))


def one_spelling(path: Column) -> Column:
    """Without leading './', with '/', composed."""
    return composed(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./+)+(?=.)", ""))
