"""Groups of like vectors: exact cosine of all pairs, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.graph import components
from corpusloom.session import cut, spread


#: Bytes of vectors that are sent to every task at once (a larger table goes in slices), and rows multiplied in one step.
MOST_SENT = 1 << 26
STEP = 512


def _unit(vectors: list[list[float]]) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))


def similar_vectors(df: DataFrame, id_col: str, vec_col: str, least: float = 0.7, most: int = MOST_SENT) -> DataFrame:
    """(a, b, cosine), a < b: all pairs with at least this cosine; null and empty vectors have none.

    Exact: slices of at most about ``most`` bytes go to the tasks one after the other, and each is multiplied with all
    rows. Nothing is shuffled but the pairs; the multiplications grow with the square of the rows.
    """
    sc = df.sparkSession.sparkContext
    rows = cut(df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).filter(F.col("id").isNotNull() & (F.size("vec") > 0)))
    slices = -(-8 * (rows.agg(F.sum(F.size("vec"))).first()[0] or 0) // most)
    id_type = rows.schema["id"].dataType.simpleString()

    def against(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, y = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                x = _unit(b.column(1).to_pylist())
                for i in range(0, len(x), STEP):
                    for j in range(0, len(y), 8 * STEP):
                        c = x[i : i + STEP] @ y[j : j + 8 * STEP].T
                        p, q = np.nonzero(c >= least - 1e-9)
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(p + i)), ids.take(pa.array(q + j)), pa.array(c[p, q])], names=["a", "b", "cosine"])

        return run

    out = df.sparkSession.createDataFrame([], f"a {id_type}, b {id_type}, cosine double")
    for k in range(slices):
        part = rows.filter(F.pmod(F.xxhash64("id"), F.lit(slices)) == k).toArrow()
        if not part.num_rows:
            continue
        shared = sc.broadcast((part.column("id").combine_chunks(), _unit(part.column("vec").to_pylist())))
        out = out.unionAll(cut(spread(rows).mapInArrow(against(shared), out.schema).filter("a < b")))
        shared.destroy()
    return out.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def similar_groups(df: DataFrame, id_col: str, vec_col: str, least: float = 0.7, most: int = MOST_SENT) -> DataFrame:
    """(id, group, links): each record with the least id of its group and its number of like records.

    A threshold outside (0, 1] counts as 0.7. Records like none are groups of one.
    """
    least = least if 0 < least <= 1 else 0.7
    pairs = similar_vectors(df, id_col, vec_col, least, most)
    ends = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    roots = components(pairs.select("a", "b"))
    out = df.select(F.col(id_col).alias("id")).join(roots.withColumnRenamed("node", "id"), "id", "left").join(ends, "id", "left")
    return out.select("id", F.coalesce("root", "id").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))


def homogenise(groups: DataFrame, values: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """(id, value): each value replaced by the most frequent one of its group, of equals the one with the least id."""
    rows = groups.join(values.select(F.col(id_col).alias("id"), value_col), "id")
    per = rows.groupBy("group", value_col).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    top = per.groupBy("group").agg(F.min_by(value_col, F.struct(-F.col("n"), F.col("first"))).alias("value"))
    return rows.select("id", "group").join(top, "group").select("id", "value")
