"""Centroid clustering over space-filling-curve zone maps.

Vectors are put in the order of a Hilbert curve and cut into blocks, each with its box: the
least and largest value of every component. Over a box the difference of the distances to two
centroids is linear in each component, so its bound is exact: a centroid that is further than
another one anywhere in the box can be nearest to none of the block's vectors. The others are
the block's candidates, and its vectors are compared with these, in integers. A block gives
counts and sums per cluster; what reaches the driver is a row per cluster.

Components are integers, floor(scale * x). Those beyond 2**26 are handled as whole numbers of
any size, in the same steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestream.llm.common import cut_lineage, schema

#: Vectors of a block; from the smaller number on it ends where the curve enters another cell of its first level.
BLOCK_ROWS, LEAST_ROWS = 512, 32
#: Bits of each component that place a vector on the curve.
CURVE_BITS = 5
#: Integers up to this keep squared distances and sums of a block within 64 bits.
PLAIN = 2**26
_LONGEST = 2**63 - 1
_LIMB = 2**32


def quantized(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or as Python integers where one is too large for these steps."""
    wide = np.asarray(vectors, np.float64)
    if np.abs(wide).max(initial=0) * scale <= PLAIN:
        return np.floor(wide * scale).astype(np.int64)
    # A double of 2**53 or more is whole.
    return np.array([[int(x) * scale if abs(x) >= 2**53 else int(np.floor(x * scale)) for x in row] for row in wide.tolist()], object)


def curve_places(vectors: np.ndarray, span: float = 1.0, bits: int = CURVE_BITS) -> list[bytes]:
    """Each row's place on a Hilbert curve of all components, as bytes that sort like it.

    The curve fills [-span, span); components outside stand in its border cells.
    """
    cells = 1 << bits
    inside = np.clip(np.asarray(vectors, np.float64) / span, -1, 1)
    x = np.minimum((inside + 1) * (cells / 2), cells - 1).astype(np.uint32).T.copy()
    n = len(x)
    # From the coordinates' bits to the transposed index: undo the turns of each level, then the Gray code.
    level = cells >> 1
    while level > 1:
        below = np.uint32(level - 1)
        for i in range(n):
            turn = (x[i] & level) != 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & below).astype(np.uint32)
            x[0] ^= np.where(turn, below, swap).astype(np.uint32)
            x[i] ^= swap
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, level = np.zeros(x.shape[1], np.uint32), cells >> 1
    while level > 1:
        flip ^= np.where((x[n - 1] & level) != 0, np.uint32(level - 1), np.uint32(0))
        level >>= 1
    x ^= flip
    planes = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)])  # the highest bit of every component comes first
    packed = np.packbits(planes.reshape(bits * n, -1).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest somewhere in the box, ties included."""
    # |x - c|^2 - |x - d|^2 = sum of (d - c)(2 x - c - d): at least the sum of each component's least value.
    by = centroids[None, :, :] - centroids[:, None, :]  # [c, d]: d - c
    both = centroids[None, :, :] + centroids[:, None, :]
    least = np.minimum(by * (2 * low - both), by * (2 * high - both)).sum(axis=2)
    return np.flatnonzero(~(least > 0).any(axis=1))


def nearest(vectors: np.ndarray, centroids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid; of equal ones the smaller number."""
    best, number = None, None
    for k in numbers.tolist():
        away = vectors - centroids[k]
        square = (away * away).sum(axis=1)
        if best is None:
            best, number = square, np.full(len(vectors), k)
        else:
            closer = np.asarray(square < best, bool)
            best, number = np.where(closer, square, best), np.where(closer, k, number)
    return number, best


def _usable(vector: Column, dim: int) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & (F.size(vector) == dim), F.lit(False))


def zone_blocks(vectors: DataFrame, scale: int, dim: int, id_col: str, vector_col: str) -> DataFrame:
    """(ids, rows, low, high): blocks of vectors that are near on the curve, with their boxes; numbers as bytes.

    Rows are ordered by the curve and then by a hash of their id and where they were read, so
    equal vectors, however many, are dealt over many partitions and blocks.
    """
    own_kind = vectors.schema[id_col].dataType
    kept = vectors.where(_usable(F.col(vector_col), dim)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))

    largest = F.array_max(F.transform("vec", lambda x: F.abs(x)))
    span = kept.agg(F.percentile_approx(largest, 0.95)).first()[0] or 1.0  # a few outliers do not coarsen the curve

    @F.pandas_udf(T.BinaryType())
    def place(batch: pd.Series) -> pd.Series:
        return pd.Series(curve_places(np.stack(batch.to_list()), span) if len(batch) else [], dtype=object)

    out = T.StructType([
        T.StructField("ids", T.ArrayType(own_kind)), T.StructField("wide", T.BooleanType()), T.StructField("rows", T.BinaryType()),
        T.StructField("low", T.BinaryType()), T.StructField("high", T.BinaryType()),
    ])

    def pack(ids: list, rows: list) -> tuple:
        whole = quantized(np.stack(rows), scale)
        low, high = whole.min(axis=0), whole.max(axis=0)
        return (ids, whole.dtype == object, _bytes(whole), _bytes(low), _bytes(high))

    most, fewest = BLOCK_ROWS, LEAST_ROWS

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, rows, last = [], [], None
        for batch in batches:
            found = []
            own = batch["id"].astype(object).where(batch["id"].notna(), None).tolist()
            for i, v, cell in zip(own, batch["vec"].to_list(), batch["cell"].to_list()):
                if len(rows) >= most or len(rows) >= fewest and cell != last:
                    found.append(pack(ids, rows))
                    ids, rows = [], []
                ids.append(i if i is None or isinstance(i, (str, bytes)) else int(i))
                rows.append(v)
                last = cell
            if found:
                yield pd.DataFrame(found, columns=out.names)
        if rows:
            yield pd.DataFrame([pack(ids, rows)], columns=out.names)

    keyed = kept.withColumn("place", place("vec")).withColumn("tie", F.xxhash64("id", F.monotonically_increasing_id()))
    ordered = keyed.repartitionByRange("place", "tie").sortWithinPartitions("place", "tie")
    return ordered.select("id", "vec", F.substring("place", 1, (dim + 7) // 8).alias("cell")).mapInPandas(cut, out)


def _bytes(numbers: np.ndarray) -> bytes:
    """32-bit integers, or text where one needs more."""
    return ",".join(map(str, numbers.ravel())).encode() if numbers.dtype == object else numbers.astype("<i4").tobytes()


def _numbers(raw: bytes, wide: bool, dim: int) -> np.ndarray:
    flat = np.array([int(x) for x in raw.split(b",")], object) if wide else np.frombuffer(raw, "<i4").astype(np.int64)
    return flat.reshape(-1, dim)


def _assigned(blocks: pd.DataFrame, centroids: list[list[int]]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Of each block: ids, vectors, numbers, squared distances, how many candidates it had."""
    dim = len(centroids[0])
    whole = np.array(centroids, object)
    plain = whole.astype(np.int64) if max(abs(x) for c in centroids for x in c) <= PLAIN else None
    for block in blocks.itertuples():
        vectors = _numbers(block.rows, block.wide, dim)
        centres = whole if plain is None or block.wide else plain
        if centres is whole:
            vectors = vectors.astype(object)
        some = candidates(_numbers(block.low, block.wide, dim)[0], _numbers(block.high, block.wide, dim)[0], centres)
        yield list(block.ids), vectors, *nearest(vectors, centres, some), len(some)


def assign_sums(blocks: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int], int]]:
    """cluster -> (vectors, componentwise sums, summed distances): partial sums per block, a row per cluster at the driver."""
    dim = len(centroids[0])
    limb = T.ArrayType(T.DecimalType(38, 0))
    kinds = T.StructType([
        T.StructField("cluster", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("high", limb), T.StructField("low", limb),
    ])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for batch in batches:
            for _, vectors, numbers, squares, _ in _assigned(batch, centroids):
                for k in np.unique(numbers).tolist():
                    own = numbers == k
                    # Beyond a long a sum of distances only has to stay there.
                    sums = [*map(int, vectors[own].sum(axis=0)), min(sum(squares[own].tolist()), 2 * _LONGEST)]
                    old = held.get(k)
                    held[k] = [int(own.sum()), sums] if old is None else [old[0] + int(own.sum()), [a + b for a, b in zip(old[1], sums)]]
        rows = [(k, n, [Decimal(s // _LIMB) for s in sums], [Decimal(s % _LIMB) for s in sums]) for k, (n, sums) in held.items()]
        yield pd.DataFrame(rows, columns=kinds.names)

    at = [F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("high", "low") for i in range(dim + 1)]
    found = blocks.mapInPandas(partial, kinds).groupBy("cluster").agg(F.sum("n").alias("n"), *at).collect()
    out = {}
    for r in found:
        sums = [int(r[f"high{i}"]) * _LIMB + int(r[f"low{i}"]) for i in range(dim + 1)]
        out[r["cluster"]] = (r["n"], sums[:dim], sums[dim])
    return out


def first_centroids(vectors: DataFrame, k: int, scale: int, dim: int, id_col: str, vector_col: str) -> list[list[int]]:
    """The k vectors whose ids have the smallest sha256 of "1:<id>", in that order; of equal ids the smaller vector first."""
    kept = vectors.where(_usable(F.col(vector_col), dim))
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = kept.select(digest.alias("h"), F.col(vector_col).cast("array<double>").alias("v")).orderBy("h", "v").limit(k).collect()
    return [[int(x) for x in quantized(np.array([r["v"]]), scale)[0]] for r in rows]


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector of exactly `dim` finite components.

    Others give no row. Repeated rows are vectors of their own, a null id counts as empty text
    where first centroids are chosen. With fewer than k vectors there are as many centroids.
    An empty cluster keeps its centroid. Ties go to the smaller number. Distances and sums of
    distances that exceed a long are given as the largest long; what they decide is exact.
    Other columns are not read.
    """
    told = schema("cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = first_centroids(vectors, k, scale, dim, id_col, vector_col)
    if not centroids:
        return vectors.where(F.lit(False)).select(F.col(id_col), *(F.lit(None).cast(f.dataType).alias(f.name) for f in told.fields))
    blocks = cut_lineage(zone_blocks(vectors, scale, dim, id_col, vector_col))
    for _ in range(rounds):
        for number, (n, sums, _) in assign_sums(blocks, centroids).items():
            centroids[number] = [s // n for s in sums]
    last = {number: least for number, (_, _, least) in assign_sums(blocks, centroids).items()}
    inertia = min(sum(last.values()), _LONGEST)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    out = T.StructType([T.StructField(id_col, vectors.schema[id_col].dataType), *told.fields])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, _, numbers, squares, _ in _assigned(batch, centroids):
                rows = pd.DataFrame({"cluster": numbers, "distance": [min(int(s), _LONGEST) for s in squares]})
                rows.insert(0, id_col, pd.Series(ids, dtype=object))
                rows["cluster_inertia"] = [min(last[n], _LONGEST) for n in numbers.tolist()]
                rows["inertia"] = inertia
                rows["centroid_sha256"] = [digests[n] for n in numbers.tolist()]
                yield rows

    return blocks.mapInPandas(assign, out)


def candidate_counts(blocks: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vectors, candidates) of each block: what its box left to be compared."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(len(ids), n) for ids, _, _, _, n in _assigned(batch, centroids)], columns=["vectors", "candidates"])

    return blocks.mapInPandas(count, schema("vectors long, candidates long"))
