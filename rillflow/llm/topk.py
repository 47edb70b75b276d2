"""Exact top-k inner-product search by columnar branch and bound.

Vectors become integers floor(scale * x). Candidates and queries are dealt to blocks; each pair of blocks is scored in
one task in vertical layout (one array per dimension). For a query, scores are accumulated one block of dimensions at a
time; what the remaining dimensions can add lies within the product of both remaining norms (Cauchy-Schwarz), so a
candidate whose upper bound is below the k-th best lower bound can never be among the k best and is compacted away.
Each pair of blocks gives its k best of each query, and a final ranking merges them. All of it is exact.

Defined results: vectors that are null, empty or hold a null or non-finite component, and rows with a null id, take no
part; an empty table gives no rows, and other columns are not read. Vectors are compared with those of equal length. Rows
that share the query's id are the query's own and no candidates; other repeated ids count row by row. Each query row has
ranks of its own: an id that several query rows share comes with so many lists. Ties go to the smaller id. Scores outside 64
bits are clamped, and ranked as such. No block is ever pruned by an approximation, and no row is sent to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import small_batches, table

SCALE, K = 1024, 10
#: Rows of a block of candidates and of queries, on average, and dimensions scored at a time.
BLOCK_ROWS, QUERY_ROWS, DIMS = 2048, 8192, 8
#: Products below this are exact in double arithmetic.
EXACT = float(1 << 52)


def usable(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, v (array<double> of whole numbers) of the rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False)))
    # floor() of a double is a bigint in Spark and would overflow, so it is taken in the workers
    return rows.select("id", F.transform("v", lambda x: x.cast("double") * float(scale)).alias("v"))


def best(q: np.ndarray, columns: np.ndarray, rest_c: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the k best candidates of one query.

    columns: dimensions x candidates. rest_c[b]: norms of the candidates' dimensions from block b on."""
    dims = len(q)
    left = np.flatnonzero(ids != own)
    score = np.zeros(len(left))
    cols = columns if len(left) == columns.shape[1] else columns[:, left]
    rest_q = np.sqrt(np.add.accumulate((q * q)[::-1])[::-1])
    for b, at in enumerate(range(0, dims, DIMS)):
        to = min(dims, at + DIMS)
        score = score + q[at:to] @ cols[at:to]
        if to < dims and len(left) > k:
            slack = rest_q[to] * rest_c[b + 1][left] * (1 + 1e-9) + 1e-6
            low = score - slack
            floor = np.partition(low, len(low) - k)[len(low) - k]
            keep = score + slack >= floor
            if keep.sum() < 0.7 * len(left):  # compact
                left, score, cols = left[keep], score[keep], cols[:, keep]
    order = np.lexsort((ids[left], -score))[:k]
    return left[order], score[order]


def _block(cands, queries, k: int):
    """(row, query_id, vec_id, score) of one pair of blocks; candidates are (ids, matrix rows x dims), queries have the numbers
    of their rows too."""
    c_ids, c = cands
    q_ids, q, q_rows = queries
    big = np.abs(c).max(initial=0) * np.abs(q).max(initial=0) * c.shape[1] >= EXACT
    out: tuple[list[int], ...] = ([], [], [], [])
    if big:  # Python's integers: any size, exact
        rows = [[int(x) for x in r] for r in c]
        for row, own, vec in zip(q_rows.tolist(), q_ids.tolist(), q):
            v = [int(x) for x in vec]
            clamped = lambda r: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, r))))  # noqa: E731, B023
            scored = sorted((-clamped(r), i) for i, r in zip(c_ids.tolist(), rows) if i != own)[:k]
            for s, i in scored:
                for x, y in zip(out, (row, own, i, -s)):
                    x.append(y)
        return out
    columns = np.ascontiguousarray(c.T)
    squares = (columns * columns)[::-1].cumsum(axis=0)[::-1]
    rest_c = [np.sqrt(squares[at]) for at in range(0, c.shape[1], DIMS)]
    for row, own, vec in zip(q_rows.tolist(), q_ids.tolist(), q):
        at, score = best(vec, columns, rest_c, c_ids, own, k)
        out[0].extend([row] * len(at))
        out[1].extend([own] * len(at))
        out[2].extend(c_ids[at].tolist())
        out[3].extend(int(s) for s in score)
    return out


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best. is_query: a condition on the column ``id``."""
    small_batches(df.sparkSession)
    ship(df.sparkSession)
    # a row's number, which follows from its place in the input, deals it to a block: repeated ids are spread like others
    rows = usable(df, id_col, vec_col, scale).withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id())
    queries = rows.where(is_query)
    n, n_q = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).head()
    c_blocks, q_blocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n_q // QUERY_ROWS))
    block = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    c = rows.withColumn("cb", block(c_blocks)).withColumn("qb", each(q_blocks)).drop("row")
    q = queries.withColumn("qb", block(q_blocks)).withColumn("cb", each(c_blocks))

    def pair(cands, asked):
        import pandas as pd

        if not len(cands) or not len(asked):
            return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")
        own, other = [(x["id"].to_numpy(), np.floor(np.stack([np.asarray(v, dtype=np.float64) for v in x["v"]]))) for x in (cands, asked)]
        return pd.DataFrame(dict(zip(("row", "query_id", "vec_id", "score"), _block(own, (*other, asked["row"].to_numpy()), k))), dtype="int64")

    keys = ["dim", "cb", "qb"]
    partial = c.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(pair, "row long, query_id long, vec_id long, score long")
    ranked = partial.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
