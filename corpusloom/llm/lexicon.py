"""Lists of words that readers of text need: broadcast while small, else looked up by a join."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a list that is broadcast (about 100 bytes each).
MOST_WORDS = 200_000


def with_lexicon(df: DataFrame, key: str, text_cols: list[str], words: Callable[[list], list[str]], table: DataFrame, most: int = MOST_WORDS):
    """(rows, shared): ``table`` (w, x) as a broadcast dict if it has at most ``most`` words. Otherwise shared is None, and
    rows get a column ``known``, a map of those words of the list that ``words`` finds in their text columns."""
    held = table.select("w", F.col("x").cast("double")).limit(most + 1).collect()
    if len(held) <= most:
        return df.withColumn("known", F.lit(None).cast("map<string,double>")), df.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in held})
    found = F.pandas_udf(lambda *cols: pd.Series([words(list(row)) for row in zip(*cols)], dtype=object), "array<string>")
    rows = df.select(key, F.explode(F.array_distinct(found(*text_cols))).alias("w")).distinct()
    hits = rows.join(table.select("w", F.col("x").cast("double").alias("x")), "w").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("w", "x"))).alias("known"))
    return df.join(hits, key, "left"), None
