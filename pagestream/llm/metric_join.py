"""Near-duplicate vectors by an exact metric range join.

Vectors of one label are compared by the distance of their unit vectors, which is a metric:
cosine >= c means distance <= sqrt(2 - 2 c). Pivots, vectors further apart than four times that
radius, partition a label: a vector's cell is its nearest pivot's core (within two radii) or
the rest around it. By the triangle inequality, and its sharper form for the plane between two
pivots, only some other cells can hold a vector within the radius of it; it is replicated into
those with a smaller number. So each pair meets in exactly one cell, and cells join
independently, the large ones in blocks. A block gives counts and a spanning forest of its
links, never its pairs. Pairs are judged by their cosine in double precision.

How many pivots a label gets is chosen by the work estimated on a bounded sample; the result
is the same for every choice.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestream.llm.common import cut_lineage
from pagestream.llm.components import components, joined_by_hub

LEAST_COSINE = 0.98
#: Distinct vectors from which pivots are taken: no more reach the driver or are broadcast.
SAMPLE_ROWS = 4096
#: Vectors on one side of a block, and their components.
BLOCK_ROWS, BLOCK_FLOATS = 4096, 2**20
#: Work of copying a vector into a cell, in comparisons of two vectors.
COPY_WORK = 200
_SLACK = 1e-9


def usable(vector: Column) -> Column:
    """A vector that has a direction: not null, not zero, all components finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows in double precision, each by a power of two, so squares neither overflow nor vanish; cosines stay as they are."""
    wide = np.asarray(vectors, np.float64)
    return np.ldexp(wide, -np.frexp(np.abs(wide).max(axis=1))[1][:, None])


def norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", vectors, vectors))


def unit(vectors: np.ndarray) -> np.ndarray:
    wide = scaled(vectors)
    return wide / norms(wide)[:, None]


class Cells:
    """The cells of one label: pivots as unit vectors, and the radius of the join."""

    def __init__(self, pivots: np.ndarray, radius: float):
        self.pivots, self.radius = pivots, radius
        self.between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
        np.fill_diagonal(self.between, 1)

    def place(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home cell of each row, rows replicated, the cells they go to); cell 2 j is pivot j's core, 2 j + 1 the rest."""
        homes, rows, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, 2**20 // len(self.pivots))
        for at in range(0, len(units), step):
            home, row, cell = self._place(units[at:at + step])
            homes.append(home)
            rows.append(row + at)
            cells.append(cell)
        return np.concatenate(homes), np.concatenate(rows), np.concatenate(cells)

    def _place(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, every = self.radius + _SLACK, np.arange(len(units))
        square = np.maximum(2 - 2 * units @ self.pivots.T, 0)
        nearest, away = square.argmin(axis=1), np.sqrt(square)
        home = 2 * nearest + (away[every, nearest] > 2 * self.radius)
        # What is nearest to pivot j lies on its side of the plane between j and this row's own pivot.
        reach = (square - square[every, nearest][:, None]) <= 2 * r * self.between[nearest]
        reach[every, nearest] = True
        cell = 2 * np.arange(len(self.pivots))[None]
        core = reach & (away <= 2 * self.radius + r) & (cell < home[:, None])
        rest = reach & (away >= 2 * self.radius - r) & (cell + 1 < home[:, None])
        rows, which = (np.concatenate(x) for x in zip(np.nonzero(core), np.nonzero(rest)))
        return home, rows, np.concatenate([2 * which[:core.sum()], 2 * which[core.sum():] + 1])


def net(units: np.ndarray, apart: float, near: float) -> np.ndarray:
    """Rows more than `apart` from one another, those with the most neighbours within `near` first."""
    many = np.zeros(len(units), np.int64)
    for at in range(0, len(units), 512):
        many[at:at + 512] = (2 - 2 * units[at:at + 512] @ units.T <= near * near).sum(axis=1)
    chosen, free = [], np.ones(len(units), bool)
    for i in np.argsort(-many, kind="stable"):
        if free[i]:
            chosen.append(i)
            free &= 2 - 2 * units @ units[i] > apart * apart
    return units[chosen]


def choose_cells(units: np.ndarray, rows: float, radius: float) -> Cells | None:
    """Cells for a label of about `rows` vectors, from a sample of them; None where one cell is the least work."""
    found = net(units, 4 * radius, 2 * radius)
    best, least, many = None, rows * rows / 2, 1
    while many <= len(found):
        cells = Cells(found[:many], radius)
        home, _, guests = cells.place(units)
        own, more = np.bincount(home, minlength=2 * many), np.bincount(guests, minlength=2 * many)
        work = (own * (own / 2 + more)).sum() * (rows / len(units)) ** 2 + COPY_WORK * rows * len(guests) / len(units)
        if work < least:
            best, least = cells, work
        many *= 2
    return best


def linked(left: np.ndarray, right: np.ndarray | None, least: float) -> np.ndarray:
    """Which rows of `left` and `right` have that cosine; without `right`, which two different rows of `left`."""
    own, other = scaled(left), scaled(left if right is None else right)
    a, b = norms(own), norms(other)
    out = np.empty((len(own), len(other)), bool)
    for at in range(0, len(own), 512):
        out[at:at + 512] = own[at:at + 512] @ other.T / (a[at:at + 512, None] * b) >= least
    if right is None:
        np.fill_diagonal(out, False)
    return out


def forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each column the smallest node (of `left`, `right`) that it reaches in this block."""
    roots, col_roots = left.copy(), right.copy()
    todo, open_cols = links.any(axis=1), links.any(axis=0)
    for i in np.flatnonzero(todo):
        if not todo[i]:
            continue
        rows, cols = [np.array([i])], []
        todo[i] = False
        while True:
            new = np.flatnonzero(links[rows[-1]].any(axis=0) & open_cols)
            open_cols[new] = False
            cols.append(new)
            more = np.flatnonzero(links[:, new].any(axis=1) & todo) if len(new) else new
            todo[more] = False
            if not len(more):
                break
            rows.append(more)
        mine, theirs = np.concatenate(rows), np.concatenate(cols)
        root = min(left[mine].min(), right[theirs].min())
        roots[mine], col_roots[theirs] = root, root
    return roots, col_roots


class _Sent(NamedTuple):
    cells: dict[tuple, Cells]


def _sampled_cells(nodes: DataFrame, radius: float) -> dict[tuple, Cells]:
    total = nodes.count()
    sample = nodes.select(F.to_json(F.struct("label")).alias("l"), F.size("vec").alias("dim"), "vec", "node")
    sample = sample.orderBy(F.xxhash64("l", "vec"), "node").limit(SAMPLE_ROWS).toPandas()
    found = {}
    for key, own in sample.groupby(["l", "dim"], sort=True):
        units = unit(np.stack(own["vec"].to_list()))
        cells = choose_cells(units, total * len(own) / len(sample), radius)
        if cells is not None:
            found[key] = cells
    return found


def _placed(nodes: DataFrame, radius: float) -> DataFrame:
    """(label, dim, cell, home, node, weight, vec): every node in its home cell and the cells it is replicated to; vec as bytes."""
    sent = nodes.sparkSession.sparkContext.broadcast(_Sent(_sampled_cells(nodes, radius)))  # at most SAMPLE_ROWS pivots
    kind = nodes.schema["vec"].dataType.elementType
    dtype = np.float32 if isinstance(kind, T.FloatType) else np.float64
    out = T.StructType([
        T.StructField("label", nodes.schema["label"].dataType), T.StructField("dim", T.IntegerType()), T.StructField("cell", T.IntegerType()),
        T.StructField("home", T.BooleanType()), T.StructField("node", T.LongType()), T.StructField("weight", T.LongType()),
        T.StructField("vec", T.BinaryType()),
    ])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (l, dim), own in batch.groupby(["l", "dim"], sort=False):
                vectors = np.stack(own["vec"].to_list()).astype(dtype)
                cells = sent.value.cells.get((l, dim))
                if cells is None:
                    home, guests, to = np.zeros(len(own), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                else:
                    home, guests, to = cells.place(unit(vectors))
                rows = np.concatenate([np.arange(len(own)), guests])
                raw = [v.tobytes() for v in vectors]
                got = own[["label", "dim", "node", "weight"]].iloc[rows].reset_index(drop=True)
                got["cell"] = np.concatenate([home, to])
                got["home"] = np.arange(len(rows)) < len(own)
                got["vec"] = [raw[i] for i in rows]
                yield got[out.names]

    keyed = nodes.select("label", F.to_json(F.struct("label")).alias("l"), F.size("vec").alias("dim"), "node", "weight", "vec")
    return keyed.mapInPandas(place, out)


def _dealt(placed: DataFrame) -> DataFrame:
    """Cells cut into blocks (a, b): home part a against home part b, or against part -1 - b of the replicated rows.

    Cells without a pair drop out. side tells which part of its block a row is.
    """
    cell = ["label", "dim", "cell"]
    sizes = placed.groupBy(*cell).agg(
        F.count(F.when(F.col("home"), 1)).alias("own"), F.count(F.when(~F.col("home"), 1)).alias("more")
    ).where("own > 0 and own + more > 1")
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_FLOATS) / F.col("dim"))))
    sizes = sizes.select(*cell, F.ceil(F.col("own") / most).alias("parts"), F.ceil(F.col("more") / most).alias("guest_parts"))
    rows = placed.join(sizes, cell)
    part = F.pmod(F.xxhash64("node", "cell"), F.when(F.col("home"), F.col("parts")).otherwise(F.col("guest_parts")))
    rows = rows.withColumn("part", part)
    block = lambda a, b, side: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), side.alias("side"))
    mine, parts, guest_parts = F.col("part"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), F.col("guest_parts")
    with_own = F.transform(parts, lambda p: block(F.least(mine, p), F.greatest(mine, p), mine > p))
    none = F.filter(with_own, lambda _: F.lit(False))
    with_guests = F.when(
        guest_parts > 0, F.transform(F.sequence(F.lit(1).cast("long"), guest_parts), lambda p: block(mine, -p, F.lit(False)))
    ).otherwise(none)
    as_guest = F.transform(parts, lambda p: block(p, -1 - mine, F.lit(True)))
    blocks = F.when(F.col("home"), F.concat(with_own, with_guests)).otherwise(as_guest)
    return rows.select(*cell, "node", "weight", "vec", F.inline(blocks))


def _joiner(dtype: type, least: float):
    def join(block: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack([np.frombuffer(v, dtype) for v in block["vec"]])
        node, weight, side = (block[c].to_numpy() for c in ("node", "weight", "side"))
        if block["a"].iat[0] == block["b"].iat[0]:
            links = linked(vectors, None, least)
            roots, other = forest(links, node, node)
            out = pd.DataFrame({"node": node, "n": links @ weight, "root": np.minimum(roots, other)})
        else:
            links = linked(vectors[~side], vectors[side], least)
            roots, other = forest(links, node[~side], node[side])
            out = pd.concat([
                pd.DataFrame({"node": node[~side], "n": links @ weight[side], "root": roots}),
                pd.DataFrame({"node": node[side], "n": weight[~side] @ links, "root": other}),
            ])
        return out[out["n"] > 0]

    return join


def near_vectors(
    vectors: DataFrame, least: float = LEAST_COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(id, n_links, component_id, kept) for each row; pairs of one label with that cosine (0 < least < 1) are linked.

    Null, zero and non-finite vectors, and those without a label, link with nothing, nor do
    vectors of different lengths. Equal vectors of one label are one node with a weight, so
    copies cost nothing but their count. Repeated rows are rows of their own: each counts as a
    link of the others, and each gets a row. A null id takes part; it is a component's id only
    where no other id is in it, and is never kept (null). Other columns are not read. An empty
    table gives no row.
    """
    radius = float(np.sqrt(2 - 2 * least))
    vector, kind = F.col(vector_col), vectors.schema[vector_col].dataType.elementType
    plain = F.transform(vector, lambda x: x + F.lit(0).cast(kind))  # no negative zeros
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.when(usable(vector) & F.col(label_col).isNotNull(), plain).alias("vec"))
    seen = rows.where("vec is not null").groupBy("label", "vec").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("least_id"))
    nodes = cut_lineage(seen.withColumn("node", F.monotonically_increasing_id()))
    placed = cut_lineage(_placed(nodes.drop("least_id"), radius))
    dtype = np.float32 if isinstance(kind, T.FloatType) else np.float64
    found = cut_lineage(
        _dealt(placed).groupBy("label", "dim", "cell", "a", "b").applyInPandas(_joiner(dtype, least), "node long, n long, root long")
    )
    members = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    members = cut_lineage(members.join(nodes.select("node", "least_id"), "node"))
    named = members.groupBy("component").agg(F.min("least_id").alias("component_id"))
    member = joined_by_hub(members.select("node", "component"), named, "component", "node").select("node", "component_id")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    hashes = lambda v: (F.xxhash64(v), F.xxhash64(v, F.lit(1)))
    one, two = hashes(F.col("vec"))
    told = (
        nodes.select("node", "label", one.alias("h"), two.alias("h2"), "weight", "least_id")
        .join(counts, "node", "left").join(member, "node", "left")
        .select(
            "label", "h", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component_id", "least_id").alias("component_id"),
        )
    )
    out = rows.select("id", F.when(F.col("vec").isNotNull(), F.col("label")).alias("label"), one.alias("h"), two.alias("h2"))
    out = out.join(told, ["label", "h", "h2"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))
