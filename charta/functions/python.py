"""Functions that built-in expressions can't say: Arrow batches, and a table function for rows from a value."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def unaccented(texts: pd.Series) -> pd.Series:
    """Texts without any combining accents, of all scripts (canonical decomposition); null stays null."""
    bare = lambda t: unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)))
    return texts.map(bare, na_action="ignore")


@F.udtf(returnType=T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("n_chars", T.IntegerType()), T.StructField("first", T.StringType())]))
class LineTable:
    """A row for each line of a text: its number from 1, its length and its first word; none for null."""

    def eval(self, text: str | None) -> Iterator[tuple[int, int, str]]:
        for i, line in enumerate([] if text is None else text.split("\n"), 1):
            yield i, len(line), line.split(" ")[0]
