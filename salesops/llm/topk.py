"""Exact top-k search by multi-resolution segment statistics.

A vector's components become integers, floor(256 x).  For each cut of the
components into segments the bound

    q . x <= sum over segments of n (mean q * mean x + deviation q * deviation x)

holds (with the lengths of q and x it is a lower bound of their distance), and
it tightens from coarse to fine cuts.  In one block of queries against one
block of rows all bounds of a cut are a matrix product.  The rows of best
coarse bound give each query a first k-th score; rows whose bound is below it
drop out, cut by cut, and the survivors get exact scores.

The stated queries (every row whose vec_id is divisible by 50) meet all rows in
blocks of bounded size on both sides; each block returns k rows per query, and
the best k of all blocks are ranked.

Defined results: vectors null or with null or non-finite components, and rows
with a null vec_id, take no part.  Rows with the query's vec_id are its own.
Vectors of another length than the query's are no candidates.  Ties go to the
smaller vec_id.  Scores are exact up to 2**53.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesops.llm.embedding_dedup import usable
from salesops.llm.tasks import ship

K = 5
EVERY = 50
QUERY_BLOCK, ROW_BLOCK = 1024, 8192
SEGMENTS = (4, 8, 16, 32)
SEEDS = 32
SCALE = 256


def integers(vectors) -> np.ndarray:
    """floor(256 x) of equally long vectors, as whole doubles."""
    return np.floor(SCALE * np.stack(vectors).astype(np.float64))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments of each row, scaled so that the bound is an inner product."""
    cuts = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int))
    size = np.diff(cuts)
    total = np.add.reduceat(x, cuts[:-1], axis=1)
    square = np.add.reduceat(x * x, cuts[:-1], axis=1)
    spread = np.sqrt(np.maximum(square - total * total / size, 0))
    return np.concatenate([total / np.sqrt(size), spread], axis=1)


def best(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query its k best rows: position of the query, position of the row, exact score."""
    alive = q_ids[:, None] != ids[None, :]
    scale = np.sqrt((queries * queries).sum(axis=1))[:, None] * np.sqrt((rows * rows).sum(axis=1)).max(initial=1.0)
    slack = 1e-9 * scale[:, 0] + 0.5  # rounding of the bounds; scores are whole
    floor_ = np.full(len(queries), -np.inf)
    for level, segments in enumerate(SEGMENTS):
        if segments > rows.shape[1] and level:
            break
        bound = statistics(queries, segments) @ statistics(rows, segments).T
        if not level:
            bound[~alive] = -np.inf
            seeds = min(max(SEEDS, k), len(rows))
            at = np.argpartition(-bound, seeds - 1, axis=1)[:, :seeds]
            score = np.einsum("qd,qsd->qs", queries, rows[at])
            score[~np.take_along_axis(alive, at, axis=1)] = -np.inf
            if seeds >= k:
                floor_ = np.partition(score, seeds - k, axis=1)[:, seeds - k]
        alive &= bound >= (floor_ - slack)[:, None]
    out = [], [], []
    for q in range(len(queries)):
        at = np.flatnonzero(alive[q])
        score = rows[at] @ queries[q]
        top = np.lexsort((ids[at], -score))[:k]
        out[0].append(np.full(len(top), q))
        out[1].append(at[top])
        out[2].append(score[top])
    return tuple(np.concatenate(o) if o else np.zeros(0, int) for o in out)


def search(vectors: DataFrame, k: int = K, every: int = EVERY, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of every query."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable() & (F.size("embedding") > 0)).withColumn("len", F.size("embedding"))
    asked = rows.where(F.col("vec_id") % every == 0)
    n_rows, n_asked = rows.count(), asked.count()
    row_blocks, query_blocks = -(-n_rows // row_block) or 1, -(-n_asked // query_block) or 1
    block = lambda n: F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("len", block(query_blocks).alias("qb"), each(row_blocks).alias("rb"), "vec_id", "embedding")
    right = rows.select("len", each(query_blocks).alias("qb"), block(row_blocks).alias("rb"), "vec_id", "embedding")

    def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q_ids, ids = q["vec_id"].to_numpy(), x["vec_id"].to_numpy()
        at, row, score = best(integers(q["embedding"].tolist()), q_ids, integers(x["embedding"].tolist()), ids, k)
        return pd.DataFrame({"query_id": q_ids[at], "vec_id": ids[row], "score": score.astype(np.int64)})

    ship(vectors.sparkSession)
    key = ["len", "qb", "rb"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
