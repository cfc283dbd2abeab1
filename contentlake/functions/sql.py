"""The library's vectorised functions for use in SQL texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from contentlake.functions import html, text


def _text(function):
    def per_batch(values: pd.Series) -> pd.Series:
        return values.map(function, na_action=None)

    return F.pandas_udf(per_batch, StringType())


def register(spark: SparkSession) -> list[str]:
    """Registers fold, html_text, html_markdown, html_main_text; gives their names."""
    functions = {"fold": text.fold_text, "html_text": html.plain_text, "html_markdown": html.markdown, "html_main_text": html.main_text}
    for name, function in functions.items():
        spark.udf.register(name, _text(function))
    return sorted(functions)
