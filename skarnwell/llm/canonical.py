"""Visually identical text: bring texts to one canonical form, and match texts by it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarnwell.llm import lookalike


def _canonical_series(texts: pd.Series) -> pd.Series:
    return texts.map(lookalike.canonical, na_action="ignore")


def canonical_column(text: Column) -> Column:
    """Canonical form of a string column.

    The quick check runs inside the JVM: texts of stable characters only never leave it. The others go
    to Python in Arrow batches, where only their unstable segments are normalized. Null stays null, an
    empty text stays empty, the length of a text is not bounded.
    """
    unstable = text.rlike(lookalike.MAY_BE_UNSTABLE)
    udf = F.pandas_udf(_canonical_series, "string")
    return F.when(unstable, udf(F.when(unstable, text))).otherwise(text)


def with_canonical(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the canonical form of `column` as `out` (replaced if there is such a column)."""
    return df.withColumn(out, canonical_column(F.col(column)))


def same_lines(texts: DataFrame, text_id: str, text: str, wanted: DataFrame, wanted_id: str, wanted_text: str) -> DataFrame:
    """(wanted_id, text_id), distinct, where a wanted text looks the same as one whole line of a text.

    Lines lie between line feeds; blanks at the ends of a line cannot be seen and do not count. Wanted
    texts that draw nothing match no line. Rows with null ids or texts match nothing. The join is an
    equi-join on the canonical line: Spark broadcasts `wanted` when its size permits and shuffles
    lines otherwise.
    """
    w = wanted.select(F.col(wanted_id).alias("_w"), F.trim(canonical_column(F.col(wanted_text))).alias("_line")).filter("_w is not null and _line != ''")
    t = with_canonical(texts.select(F.col(text_id).alias("_t"), F.col(text).alias("_text")).filter("_t is not null"), "_text", "_text")
    lines = t.select("_t", F.explode(F.split("_text", "\n")).alias("_line")).select("_t", F.trim("_line").alias("_line")).filter("_line != ''")
    return lines.join(w, "_line").select(F.col("_w").alias(wanted_id), F.col("_t").alias(text_id)).distinct()


def question_of(query: Column) -> Column:
    """The question of a golden query: what follows `folder:repos/<name>` and one space."""
    return F.regexp_replace(query, r"^folder:repos/[^ ]* ", "")
