"""Nearest neighbours by cosine with randomly rotated one-bit codes.

A vector is scaled to length one, the centre of a bounded sample is taken off, and the rest is rotated at random and
kept as one sign bit per dimension, with correction scalars: the rest's length, its product with the centre, and
the product of the rest with its own code. From the bits and these scalars follow an unbiased estimate of any
inner product with a query and a bound on its error. A block of the index is searched so: the vectors of
largest estimate are scored exactly, which gives a score that the k-th best reaches at least; all others whose
estimate plus error bound reaches it are scored exactly too, with the original vectors in double precision.

Work is dealt as cells (block of vectors, block of queries), so no task grows with the data and nothing is broadcast.
Equal vectors form a class that is searched once; of its members only the k + 1 of smallest id can be among the k
nearest of any query, so this drops nothing from results.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with
a null id; vectors of different lengths are never compared; rows repeated with the same id and vector count once, and
a query is never its own neighbour, by id.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Classes in a block of the index, and queries in a block.
BLOCK, QUERY_BLOCK = 32_768, 2_048
#: Vectors that the centre is the mean of, at most.
CENTRE_SAMPLE = 4_096
#: Width of the error bound in standard deviations.
EPSILON = 3.0
_STEP, _FIRST = 128, 32


@lru_cache(8)
def rotation(dims: int, seed: int = 0) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def usable(embedding: str | Column) -> Column:
    col = F.col(embedding) if isinstance(embedding, str) else embedding
    finite = F.forall(col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(col) > 0) & finite & F.exists(col, lambda x: x != 0), F.lit(False))


def encode(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed bits, scalars) of vectors: scalars are length of the rest, its product with the centre, and the code's quality."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rest = unit - centre
    length = np.linalg.norm(rest, axis=1)
    turned = (rest / np.maximum(length, 1e-30)[:, None]).astype(np.float32) @ rotation(vectors.shape[1])
    quality = np.abs(turned).sum(1) / np.sqrt(vectors.shape[1])
    return np.packbits(turned > 0, axis=1), np.column_stack([length, rest @ centre, np.maximum(quality, 1e-6)])


def estimate(bits: np.ndarray, scalars: np.ndarray, queries: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, error bounds) of the cosines between coded vectors (rows) and queries (columns)."""
    dims = queries.shape[1]
    unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    rest = unit - centre
    length = np.linalg.norm(rest, axis=1)
    turned = (rest / np.maximum(length, 1e-30)[:, None]).astype(np.float32) @ rotation(dims)
    signs = np.unpackbits(bits, axis=1, count=dims).astype(np.float32)
    product = (2 * (signs @ turned.T) - turned.sum(1)) / np.float32(np.sqrt(dims))
    norm, along, quality = scalars.T.astype(np.float32)
    scale = norm[:, None] * length.astype(np.float32)
    guess = (unit @ centre).astype(np.float32) + along[:, None] + scale * product / quality[:, None]
    spread = np.sqrt(np.maximum(1 - quality**2, 0)) / quality * np.float32(EPSILON / np.sqrt(max(dims - 1, 1)))
    return guess, scale * spread[:, None] + np.float32(1e-5)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _search_cell(k: int, centres: dict[int, np.ndarray]):  # noqa: ANN202
    def search(key: tuple, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[list, list, list]] = []
        if len(index) and len(queries):
            dims = int(key[0])
            centre = centres.get(dims, np.zeros(dims))
            vectors = np.array(index["embedding"].tolist(), np.float64)
            norms = np.linalg.norm(vectors, axis=1)
            ids = index["class_id"].to_numpy()
            bits = np.frombuffer(b"".join(index["bits"]), np.uint8).reshape(len(index), -1)
            scalars = np.array(index["scalars"].tolist())
            asked = np.array(queries["embedding"].tolist(), np.float64)
            asked_ids = queries["query_class"].to_numpy()
            for lo in range(0, len(asked), _STEP):
                q = asked[lo : lo + _STEP]
                guess, error = estimate(bits, scalars, q, centre)
                first = min(max(_FIRST, 2 * k), len(ids))
                top = np.argpartition(-guess, first - 1, axis=0)[:first]
                for i in range(len(q)):
                    size = np.linalg.norm(q[i])
                    exact = (vectors[top[:, i]] @ q[i]) / (norms[top[:, i]] * size)
                    floor = np.partition(exact, -min(k, first))[-min(k, first)]
                    rerank = np.flatnonzero(guess[:, i] + error[:, i] >= floor)
                    scores = (vectors[rerank] @ q[i]) / (norms[rerank] * size)
                    best = _best(scores, ids[rerank], k)
                    out.append((np.full(len(best), asked_ids[lo + i]), ids[rerank][best], scores[best]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [[], [], []]
        return pd.DataFrame(dict(zip(("query_class", "class_id", "score"), columns, strict=True))).astype({"query_class": "int64", "class_id": "int64", "score": "float64"})

    return search


def _encode_batches(centres: dict[int, np.ndarray]):  # noqa: ANN202
    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            dims = pdf["embedding"].map(len).to_numpy() if len(pdf) else np.zeros(0, int)
            bits, scalars = np.empty(len(pdf), object), np.empty(len(pdf), object)
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                vectors = np.array(pdf["embedding"].iloc[own].tolist(), np.float64)
                b, s = encode(vectors, centres.get(int(d), np.zeros(d)))
                for at, x, y in zip(own, b, s, strict=True):
                    bits[at], scalars[at] = x.tobytes(), y
            yield pdf.assign(bits=bits, scalars=scalars)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest of every row for which `is_query` holds, among all other rows."""
    own = vectors.where(usable(embedding) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    by_class = Window.partitionBy("embedding").orderBy("vec_id")
    # the k + 1 smallest ids of each class; the rank limit is applied before the shuffle as well
    distinct = own.select("vec_id", "embedding").distinct()
    members = distinct.withColumn("place", F.row_number().over(by_class)).where(F.col("place") <= k + 1)
    classes = members.groupBy("embedding").agg(F.min("vec_id").alias("class_id"), F.sort_array(F.collect_list("vec_id")).alias("members"))
    classes = classes.withColumn("class_id", F.xxhash64("embedding", "class_id")).withColumn("dims", F.size("embedding"))
    classes = checkpoint(classes)
    asked = own.where("asked").select("vec_id", "embedding").distinct()
    asked = checkpoint(asked.join(classes.select("embedding", F.col("class_id").alias("query_class")), "embedding").select("vec_id", "query_class"))

    centres: dict[int, np.ndarray] = {}
    for r in classes.orderBy(F.xxhash64("class_id", F.lit(5))).limit(CENTRE_SAMPLE).select("dims", "embedding").collect():
        v = np.array(r.embedding)
        centres.setdefault(r.dims, []).append(v / np.linalg.norm(v))  # type: ignore[union-attr]
    centres = {d: np.mean(v, axis=0) for d, v in centres.items()}

    queries = classes.join(asked.select("query_class").distinct(), F.col("class_id") == F.col("query_class")).select("dims", "query_class", "embedding")
    n_blocks = -(-classes.count() // BLOCK) or 1
    n_blocks = max(n_blocks, min(classes.sparkSession.sparkContext.defaultParallelism, -(-n_blocks * BLOCK // 4096)))
    n_query_blocks = -(-queries.count() // QUERY_BLOCK) or 1
    index = classes.select("dims", "class_id", "embedding").mapInPandas(_encode_batches(centres), "dims int, class_id bigint, embedding array<double>, bits binary, scalars array<double>")
    index = index.withColumn("block", F.pmod(F.xxhash64("class_id", F.lit(1)), F.lit(n_blocks))).withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_query_blocks - 1).cast("long"))))
    queries = queries.withColumn("query_block", F.pmod(F.xxhash64("query_class", F.lit(2)), F.lit(n_query_blocks))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    cell = ["dims", "block", "query_block"]
    found = index.groupBy(*cell).cogroup(queries.groupBy(*cell)).applyInPandas(_search_cell(k + 1, centres), "query_class bigint, class_id bigint, score double")

    # members of a class share its score, so the k + 1 best classes (by score, then smallest id) hold the k nearest rows
    scored = found.join(classes.select("class_id", "members"), "class_id").withColumn("least", F.col("members")[0])
    best = scored.withColumn("place", F.row_number().over(Window.partitionBy("query_class").orderBy(F.desc("score"), "least"))).where(F.col("place") <= k + 1)
    rows = asked.join(best, "query_class").select(F.col("vec_id").alias("query_id"), "score", F.explode("members").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
