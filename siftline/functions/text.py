"""Numbers as text, as reports print them. C's formats round the exact binary value; Spark's own formatter does not, hence Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def formatted(x: Column, form: str) -> Column:
    """A double in a format such as ``.3g``; NULL stays NULL."""

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else format(v, form))

    return text(x.cast("double"))


def fixed2(x: Column) -> Column:
    """Two decimals."""
    return formatted(x, ".2f")


def general3(x: Column) -> Column:
    """Three significant digits without trailing zeros, in scientific form below 1e-4 and from 1000 on."""
    return formatted(x, ".3g")
