"""Unicode normalisation, which Spark SQL lacks: Arrow batches, only where normalised text itself is wanted."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(c: Column, form: str = "NFD") -> Column:
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(form)

    @F.pandas_udf("string")
    def norm(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")

    return norm(c)
