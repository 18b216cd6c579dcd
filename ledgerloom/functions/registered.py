"""Functions for use from SQL: table functions over texts and scalar functions over batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.assembly import windows_of
from ledgerloom.operators.matching import Nearest
from ledgerloom.sources.html import visible_lines


class TokenWindows:
    """token_windows(text, most, overlap): idx, first_token, n_tokens, chunk of windows over tokens without white space."""

    def eval(self, text: str, most: int, overlap: int):
        words = (text or "").split()
        for idx, (a, z, _) in enumerate(windows_of([1] * len(words), most, overlap)):
            yield idx, a, z - a, " ".join(words[a:z])


class Lines:
    """filled_lines(text): idx and line of a text's lines that aren't blank."""

    def eval(self, text: str):
        yield from ((k, s) for k, line in enumerate((text or "").split("\n")) if (s := line.strip()))


class VisibleLines:
    """visible_lines(html): idx and line of a page's visible text."""

    def eval(self, html: str):
        yield from enumerate(visible_lines(html))


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL: token_windows, filled_lines, visible_lines (tables), name_ratio (a number), longest_text (an aggregate)."""
    spark.udtf.register("token_windows", F.udtf(TokenWindows, returnType="idx int, first_token int, n_tokens int, chunk string"))
    spark.udtf.register("filled_lines", F.udtf(Lines, returnType="idx int, line string"))
    spark.udtf.register("visible_lines", F.udtf(VisibleLines, returnType="idx int, line string"))

    @F.pandas_udf("double")
    def name_ratio(query: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([None if q is None or n is None else (Nearest([n]).best(q, 0.0, 1) or [(n, 0.0)])[0][1] if n else 0.0 for q, n in zip(query, name, strict=True)], dtype="float64")

    @F.pandas_udf("string")
    def longest_text(texts: pd.Series) -> str:
        filled = texts.dropna()
        return min((-len(t), t) for t in filled)[1] if len(filled) else None

    spark.udf.register("name_ratio", name_ratio)
    spark.udf.register("longest_text", longest_text)
