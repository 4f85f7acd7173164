"""Edit distance that counts transpositions, over a dictionary of distinct terms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def damerau(a: str, b: str, most: int) -> int:
    """Edits between two words, a swap of neighbours being one; ``most + 1`` if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def expand(terms: DataFrame, term: str, edits: int = 2, prefix: int = 0, most: int = 50) -> DataFrame:
    """``(term, distance)``: the nearest terms of a dictionary, at most ``most``, as the query class defines.

    Length and prefix filters run before the function, which sees each distinct term once.
    """

    @F.pandas_udf("int")
    def distance(t: pd.Series) -> pd.Series:
        return t.map(lambda x: damerau(x, term, edits)).astype("int32")

    near = terms.where(F.length("term").between(len(term) - edits, len(term) + edits) & F.col("term").startswith(term[:prefix]))
    found = near.select("term").withColumn("distance", distance("term")).where(F.col("distance") <= edits)
    return found.orderBy("distance", "term").limit(most)
