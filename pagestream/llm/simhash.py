"""SimHash near-duplicates by an inverted index of byte positions with count filtering.

Two 64-bit fingerprints that differ in at most `MAX_BITS` = 4 bits differ in at most 4 of
their 8 bytes, so they share at least 4 bytes at equal positions. The index posts each
fingerprint under its positional bytes. One byte has only 256 values, so postings are
intersected by three: of any 4 positions that agree, three form one of the 20 triples below
(a Turan system), so no pair within reach is lost. Pairs met there are tallied, kept from the
guaranteed count on, and verified by their differing bits.

What is asked for are groups, so pairs inside a group need not be listed. Equal fingerprints are
one node. First each posting list is linked to a few of its own members, which joins a large
group of near copies in linear work; then only pairs of different groups are compared, and
posting lists that hold a single group drop out. The result equals that of all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestream.llm.common import cut_lineage, free_name
from pagestream.llm.components import components

BYTES = 8
MAX_BITS = 4
SHINGLE_WORDS = 4
SEED = 42
#: Bytes that must agree for a pair within MAX_BITS.
LEAST_EQUAL = BYTES - MAX_BITS


def _triples() -> list[tuple[int, int, int]]:
    """Turan's system: of positions in three classes, the triples within a class, and two of one class with one of the next."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    found = []
    for k, group in enumerate(groups):
        found += combinations(group, 3)
        found += [(*pair, one) for pair in combinations(group, 2) for one in groups[(k + 1) % 3]]
    return [tuple(sorted(t)) for t in found]


TRIPLES = _triples()


def fingerprint(text: str | None) -> int:
    """The bits set in over half the hashes of the text's word shingles; zero without words."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and white space of ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE_WORDS, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())],
        np.uint64,
    )
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = np.ascontiguousarray(hashes[at:at + 8192].astype(">u8")).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    values = np.array([fingerprint(t) for t in texts], np.uint64)
    return pd.Series(values.view(np.int64))


def with_fingerprint(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """`docs` with its signed 64-bit fingerprint; a null text has that of an empty one, zero."""
    return docs.withColumn(out, _fingerprints(F.col(text_col)))


def _byte(value: Column, at: int) -> Column:
    return F.shiftrightunsigned(value, 8 * at).bitwiseAND(F.lit(255))


def _postings(nodes: DataFrame) -> DataFrame:
    """(key, fp, ...): each fingerprint under its 20 triples of positional bytes."""
    keys = [
        F.lit(n * 2**24) + _byte(F.col("fp"), a) * 65536 + _byte(F.col("fp"), b) * 256 + _byte(F.col("fp"), c)
        for n, (a, b, c) in enumerate(TRIPLES)
    ]
    return nodes.withColumn("key", F.explode(F.array(*keys)))


def _near(a: Column, b: Column) -> Column:
    """Count filter, then the check of the bits."""
    differing = a.bitwiseXOR(b)
    tally = sum((_byte(differing, at) == 0).cast("int") for at in range(BYTES))
    return (tally >= LEAST_EQUAL) & (F.bit_count(differing) <= MAX_BITS)


def near_groups(nodes: DataFrame) -> DataFrame:
    """(fp, group) for distinct fingerprints `nodes` (fp, weight); only those with a near one.

    group is the smallest fingerprint (signed) of the component over pairs within MAX_BITS bits.
    """
    nodes = cut_lineage(nodes)
    posted = _postings(nodes)
    # Of each list, up to two members: the heaviest, and one by hash, another in each list.
    pivots = posted.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct("weight", "fp")).alias("heaviest"),
        F.min(F.struct(F.xxhash64("key", "fp").alias("h"), "fp")).alias("any"),
    ).where("n > 1").select("key", F.col("heaviest.fp").alias("p"), F.col("any.fp").alias("q"))
    shared = cut_lineage(posted.select("key", "fp").join(pivots, "key"))
    links = shared.select("fp", F.explode(F.array("p", "q")).alias("other")).where(
        (F.col("fp") != F.col("other")) & _near(F.col("fp"), F.col("other"))
    )
    first = components(links.select(F.col("fp").alias("a"), F.col("other").alias("b")))
    named = shared.select("key", "fp").join(
        first.select(F.col("node").alias("fp"), "component"), "fp", "left"
    ).select("key", "fp", F.coalesce("component", "fp").alias("g"))
    mixed = named.groupBy("key").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low < high").select("key")
    left = cut_lineage(named.join(mixed, "key"))
    right = left.select("key", F.col("fp").alias("fp2"), F.col("g").alias("g2"))
    across = left.join(right, "key").where(
        (F.col("g") < F.col("g2")) & _near(F.col("fp"), F.col("fp2"))
    ).select(F.col("g").alias("a"), F.col("g2").alias("b"))
    between = components(across)
    return first.select(F.col("node").alias("fp"), F.col("component").alias("g")).unionByName(
        between.select(F.col("node").alias("fp"), F.col("node").alias("g"))
    ).distinct().join(
        between.select(F.col("node").alias("g"), F.col("component").alias("root")), "g", "left"
    ).groupBy("fp").agg(F.min(F.coalesce("root", "g")).alias("group"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): the smallest id reachable over fingerprints within MAX_BITS bits.

    Null and empty texts have fingerprint zero and are linked like any other. A null id gets a
    row, and is the component only where no other id is in it. Repeated rows each give a row.
    Other columns are not read. An empty table gives no row.
    """
    marked = cut_lineage(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "fp").select("id", "fp"))
    nodes = marked.groupBy("fp").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("least"))
    groups = cut_lineage(near_groups(nodes.select("fp", "weight")))
    named = nodes.join(groups, "fp", "left").select("fp", "least", F.coalesce("group", "fp").alias("group"))
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    by_print = named.join(least, "group").select("fp", "component_id")
    return marked.join(by_print, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group stays: that of the smallest id; of equal ids the one with the smallest row hash.

    A group whose ids are all null keeps one of its rows by that hash.
    """
    found = near_duplicates(docs, id_col, text_col)
    id_name, row = free_name(docs, "kept_id"), free_name(docs, "kept_row")
    keep = found.select(F.col("component_id").alias(id_name)).distinct()
    kept = docs.join(keep, F.col(id_col).eqNullSafe(F.col(id_name)), "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # Combined on the map side, so very many rows of one id do not meet.
    first = kept.groupBy(F.col(f"`{id_col}`").alias(id_name)).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias(row))
    return first.select(*[F.col(f"`{row}`.`{c}`").alias(c) for c in docs.columns])
