"""Whitening of embeddings from an exact scatter matrix by residue numbers.

Entries become integers, x = floor(1024 c) + offset. With n vectors of sums S, the centred integers n x - S are exact, and
so is their scatter: each task multiplies their residues modulo several primes, as products of double matrices so short that no
rounding occurs, and adds residues up. Residues of all tasks are summed by Spark, and Chinese remaindering gives each entry of the
scatter as one integer, the same whatever the order of sums. Only then it becomes double, for one `eigh` of a matrix of
dims x dims numbers on the driver, whose size is checked. As many primes are taken as the largest possible entry needs.

Defined results: vectors that are null, empty, or hold null or non-finite entries take no part, nor do those with an entry so large
(beyond 2**40) that no 64-bit integer stands for it; a zero vector does take part. Vectors of different lengths are whitened apart, each
length over its own. Rows with a null id or the same id, and equal rows, count and are returned one by one. Along a component without
variance `whitened` is null and `identity_error` does not look there; it is null if there is no other. Without variance at all `explained` is
null. Other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

SCALE, OFFSET = 1024.0, 100_000
#: Largest entry of a vector, and the most dimensions whose matrix goes to the driver.
LARGEST, MOST_DIMS = float(1 << 40), 4_096
#: Primes are the largest below this; a product of matrices is exact up to STEP rows.
PRIME_BELOW = 1 << 20
STEP = 1 << 12
#: Below this share of the largest a variance counts as none.
NO_VARIANCE = 1e-13


def primes_for(bound: int) -> list[int]:
    """The largest primes below PRIME_BELOW whose product exceeds twice `bound`, so that they tell all integers within +-bound apart."""
    found, product, k = [], 1, PRIME_BELOW - 1
    while product <= 2 * bound:
        if all(k % d for d in range(3, math.isqrt(k) + 1, 2)):
            found.append(k)
            product *= k
        k -= 2
    return found


def reconstructed(residues: list[int], primes: list[int]) -> int:
    """The integer of least absolute value with these residues."""
    value, product = 0, 1
    for r, p in zip(residues, primes, strict=True):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value - product if 2 * value > product else value


def usable(embedding: str) -> Column:
    col = F.col(embedding)
    fine = F.forall(col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) <= LARGEST), F.lit(False)))
    return F.coalesce((F.size(col) > 0) & fine, F.lit(False))


def _integers(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dims, rows, integers) of a batch's vectors by length."""
    lists = batch.column(column)
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    dims = np.diff(at)
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        values = flat[at[rows][:, None] + np.arange(d)]
        yield int(d), rows, np.floor(SCALE * values).astype(np.int64) + OFFSET


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and length: number, sums and largest absolute values of the integers, sums in two halves of 32 bits."""
    found: dict[int, list] = {}
    for batch in batches:
        for d, rows, x in _integers(batch, 0):
            own = found.setdefault(d, [0, np.zeros(d, object), np.zeros(d, np.int64)])
            own[0] += len(rows)
            own[1] = own[1] + (x >> 32).sum(0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
            own[2] = np.maximum(own[2], np.abs(x).max(0))
    for d, (n, s, top) in found.items():
        kinds = {"dims": pa.int32(), "place": pa.int32(), "n": pa.int64(), "total": pa.decimal128(38, 0), "largest": pa.int64()}
        values = [[d] * d, list(range(d)), [n] * d, [int(v) for v in s], top.tolist()]
        yield pa.RecordBatch.from_arrays([_decimals(v) if pa.types.is_decimal(t) else pa.array(v, t) for v, t in zip(values, kinds.values(), strict=True)], names=list(kinds))


def _decimals(values: list[int]) -> pa.Array:
    from decimal import Decimal

    return pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))


def _residues(fit: dict[int, dict]):  # noqa: ANN202
    """Per task, length and prime: the upper half of the scatter of centred integers, modulo the prime."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for d, rows, x in _integers(batch, 0):
                f = fit[d]
                for k, p in enumerate(f["primes"]):
                    # residues around 0 have half the size; n x - S without overflow, factor by factor
                    z = (f["n"] % p * (x % p) - f["sums_mod"][k]) % p
                    z = np.where(z > p // 2, z - p, z).astype(np.float64)
                    total = found.setdefault((d, k), np.zeros((d, d), np.int64))
                    for lo in range(0, len(rows), STEP):
                        part = z[lo : lo + STEP]
                        total += (part.T @ part).astype(np.int64) % p
                    total %= p
        for (d, k), total in found.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), v, np.int32)) for v in (d, k)] + [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["dims", "k", "i", "j", "residue"])

    return run


def _entries(fit: dict[int, dict]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_pylist()
            out = []
            for d, pairs in zip(dims, batch.column(3).to_pylist(), strict=True):
                primes, n = fit[d]["primes"], fit[d]["n"]
                residues = [x["total"] % primes[x["k"]] for x in sorted(pairs, key=lambda x: x["k"])]
                # the scatter of n x - S is n**2 times that of x around its mean; one division, rounded once
                out.append(reconstructed(residues, primes) / n**3)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.float64())], names=["dims", "i", "j", "covariance"])

    return run


def covariances(vectors: DataFrame, fit: dict[int, dict]) -> DataFrame:
    """(dims, i, j, covariance) of the upper half, exact but for one rounding. `vectors` has the one column `embedding`."""
    parts = vectors.mapInArrow(_residues(fit), "dims int, k int, i int, j int, residue bigint")
    summed = parts.groupBy("dims", "k", "i", "j").agg(F.sum("residue").alias("total"))
    whole = summed.groupBy("dims", "i", "j").agg(F.collect_list(F.struct("k", "total")).alias("residues"))  # one for each prime
    return whole.mapInArrow(_entries(fit), "dims int, i int, j int, covariance double")


def fitted(vectors: DataFrame, components: int = 8) -> dict[int, dict]:
    """By length: n, sums, primes, and the first components (rows) with their eigenvalues and the trace."""
    sums = vectors.mapInArrow(_sums, "dims int, place int, n bigint, total decimal(38,0), largest bigint")
    sums = sums.groupBy("dims", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("largest").alias("largest"))
    fit: dict[int, dict] = {}
    for r in sums.orderBy("dims", "place").collect():  # a row for each dimension
        if r.dims > MOST_DIMS:
            raise ValueError(f"vectors of {r.dims} dimensions; at most {MOST_DIMS} have their matrix on the driver")
        own = fit.setdefault(r.dims, {"n": r.n, "sums": [], "largest": 0})
        own["sums"].append(int(r.total))
        own["largest"] = max(own["largest"], r.largest)
    for d, f in fit.items():
        f["reach"] = max(f["n"] * f["largest"] + abs(s) for s in f["sums"])  # of any n x - S
        f["primes"] = primes_for(f["n"] * f["reach"] ** 2)
        f["sums_mod"] = [np.array([s % p for s in f["sums"]], np.int64) for p in f["primes"]]
        f["matrix"] = np.zeros((d, d))
    if not fit:
        return fit
    for r in covariances(vectors, fit).toLocalIterator():  # dims * dims numbers, checked above
        fit[r.dims]["matrix"][r.i, r.j] = fit[r.dims]["matrix"][r.j, r.i] = r.covariance
    for f in fit.values():
        values, turned = np.linalg.eigh(f.pop("matrix"))
        order = np.argsort(-values, kind="stable")[:components]
        axes = turned[:, order].T
        largest = axes[np.arange(len(axes)), np.abs(axes).argmax(1)]
        f |= {"axes": axes * np.where(largest < 0, -1.0, 1.0)[:, None], "values": values[order], "trace": float(np.maximum(values, 0).sum())}
    return fit


def _whitened(fit: dict[int, dict]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, x in _integers(batch, 1):
                f = fit[d]
                n, sums = f["n"], f["sums"]
                if f["reach"] < 1 << 62:
                    z = n * x - np.array(sums, np.int64)
                else:
                    z = n * x.astype(object) - np.array(sums, object)
                exact = z if d * f["reach"] ** 2 < 1 << 63 else z.astype(object)
                deviation = [int(v) for v in (exact * exact).sum(1)]
                fixed = f["values"] > NO_VARIANCE * max(f["trace"], 1e-300)
                scale = np.where(fixed, np.sqrt(np.where(fixed, f["values"], 1.0)), np.nan)
                w = (z.astype(np.float64) / n) @ f["axes"].T / scale
                flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(scale)), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), d, np.int32)), _decimals(deviation), lists], names=["vec_id", "dims", "deviation", "whitened"])

    return run


def whiten(vectors: DataFrame, components: int = 8, id_column: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, dims, n, component, deviation, whitened, explained, identity_error), a row for each vector and component.

    `deviation` is a decimal of 38 digits; it raises where it needs more."""
    spark = vectors.sparkSession
    own = vectors.where(usable(embedding)).select(F.col(id_column).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    fit = fitted(own.select("embedding"), components)
    kind = own.schema["vec_id"].dataType.simpleString()
    if fit:
        rows = checkpoint(own.mapInArrow(_whitened(fit), f"vec_id {kind}, dims int, deviation decimal(38,0), whitened array<double>"))
    else:
        rows = spark.createDataFrame([], f"vec_id {kind}, dims int, deviation decimal(38,0), whitened array<double>")
    errors = identity_errors(rows, min(components, max(fit, default=0)))
    facts = [(d, f["n"], k + 1, float(v / f["trace"]) if f["trace"] > 0 else None) for d, f in fit.items() for k, v in enumerate(f["values"])]
    known = spark.createDataFrame(facts, "dims int, n bigint, component int, explained double").join(errors, "dims", "left")
    each = rows.select("vec_id", "dims", "deviation", F.posexplode("whitened").alias("place", "whitened")).withColumn("component", F.col("place") + 1)
    return each.join(F.broadcast(known), ["dims", "component"]).select("vec_id", "dims", "n", "component", "deviation", "whitened", "explained", "identity_error")


def identity_errors(rows: DataFrame, components: int) -> DataFrame:
    """(dims, identity_error): largest absolute entry of the whitened values' covariance less the identity."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    at = lambda i: F.get("whitened", F.lit(i))
    entry = [F.abs(F.covar_pop(at(i), at(j)) - (1.0 if i == j else 0.0)).alias(f"c{i}_{j}") for i, j in pairs]
    if not pairs:
        return rows.select("dims", F.lit(None).cast("double").alias("identity_error")).limit(0)
    return rows.groupBy("dims").agg(*entry).select("dims", F.array_max(F.array(*[f"c{i}_{j}" for i, j in pairs])).alias("identity_error"))
