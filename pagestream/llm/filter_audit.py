"""Filter interaction audit by wide packed counters.

Which filters a document fails is a mask of five bits. For each of the 120 orders of the
filters, the mask settles what happens at each of the five steps: kept, removed, or failing but
removed before. Each mask is mapped to one big integer whose fields hold all 600 step outcomes,
so the outcomes of many documents are one sum of integers per part, taken apart once at the
end. A field is wider than any count of rows, so none runs into the next.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestream.llm.common import cut_lineage, schema

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Bits of a field; counts are longs, so a sum stays below 2**63.
FIELD_BITS = 64
OUTCOMES = ("kept", "removed", "redundant")

# The limits of the filters, and the signs of D.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
CAPITALS, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"

RESULT = schema(
    "filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def failing(text: str | None) -> int:
    """Bits 0 to 3: whether a text fails A, B, C, D; a null text is empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: white space of ASCII only
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    mask = len(words) < LEAST_WORDS
    mask |= (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
    mask |= (100 * capitals > MOST_CAPITALS * len(text)) << 2
    mask |= (len(raw.translate(None, SIGNS)) < len(raw)) << 3
    return int(mask)


def bits(letters: str) -> int:
    return sum(1 << FILTERS.index(x) for x in letters)


@lru_cache(maxsize=1)
def packed() -> tuple[int, ...]:
    """For each mask the integer of its outcomes: field 3 s + o counts outcome o of step s, of 600 steps."""
    out = []
    for mask in range(1 << len(FILTERS)):
        whole = 0
        for at, (order, step) in enumerate((o, s) for o in ORDERS for s in range(len(FILTERS))):
            fails, before = mask & bits(order[step]), mask & bits(order[:step])
            for k, holds in enumerate((not fails and not before, fails and not before, fails and before)):
                if holds:
                    whole |= 1 << FIELD_BITS * (len(OUTCOMES) * at + k)
        out.append(whole)
    return tuple(out)


def unpacked(whole: int) -> list[dict[str, int]]:
    """The counts of each of the 600 steps."""
    size = FIELD_BITS // 8
    raw = whole.to_bytes(len(ORDERS) * len(FILTERS) * len(OUTCOMES) * size, "little")
    fields = [int.from_bytes(raw[i:i + size], "little") for i in range(0, len(raw), size)]
    return [dict(zip(OUTCOMES, fields[i:i + len(OUTCOMES)])) for i in range(0, len(fields), len(OUTCOMES))]


def report(rows: list[tuple[int, bool, bool, int]]) -> list[tuple]:
    """The 600 rows of a part, from (mask, good, toxic, documents)."""
    table = packed()
    every = unpacked(sum(n * table[m] for m, _, _, n in rows))
    good = unpacked(sum(n * table[m] for m, g, _, n in rows if g))
    toxic = unpacked(sum(n * table[m] for m, _, t, n in rows if t))
    alone = {x: sum(n for m, _, _, n in rows if m == bits(x)) for x in FILTERS}
    steps = [(o, s) for o in ORDERS for s in range(len(FILTERS))]
    shapley = dict.fromkeys(FILTERS, 0)
    for (order, step), found in zip(steps, every):
        shapley[order[step]] += found["removed"]
    return [
        (
            order, step + 1, found["kept"], found["removed"], found["redundant"], alone[order[step]],
            g["removed"], t["removed"], shapley[order[step]],
        )
        for (order, step), found, g, t in zip(steps, every, good, toxic)
    ]


@F.pandas_udf(schema("mask int, digest binary"))
def _judged(texts: pd.Series) -> pd.DataFrame:
    rows = [(failing(t), hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest()) for t in texts]
    return pd.DataFrame(rows, columns=["mask", "digest"])


def mask_counts(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
) -> DataFrame:
    """(part, mask, good, toxic, n): documents by what they fail, E included, and their labels.

    E compares texts by their sha256. Of a group of equal texts only the rows of its smallest
    id pass it, told from the group's least id, so no row is joined with its copies.
    """
    judged = _judged(F.col(text_col))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), part.alias("part"), judged.alias("j")).select("id", "part", "j.mask", "j.digest")
    rows = cut_lineage(rows.groupBy("id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n")))
    marked = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    known = rows.where("id is not null").join(marked, "id", "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}
    )
    nameless = rows.where("id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    kinds = known.unionByName(nameless).groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
    )
    least = kinds.groupBy("digest").agg(F.min("first.id").alias("least"))
    first = F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    split = kinds.join(least, "digest").withColumn("passes", F.col("nameless") + F.coalesce(first, F.lit(0)))
    both = F.array(
        F.struct("mask", F.col("passes").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(bits("E"))).alias("mask"), (F.col("n") - F.col("passes")).alias("n")),
    )
    return (
        split.select("part", "good", "toxic", F.inline(both)).where("n > 0")
        .groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    )


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    600 rows for each part, zeros included. A null text is empty, a null part is "". A null id is
    smaller and larger than none, so its row passes E, and has no label. Repeated rows of one
    id are documents of their own, none a copy of another by its id. Several labels of an id
    count if any does. Other columns are not read. An empty table gives no row. A part is at
    most 128 counts before its integers are summed.
    """
    counts = mask_counts(docs, labels, id_col, text_col, part_col)
    out = T.StructType([T.StructField("part", T.StringType()), *RESULT.fields])

    def unpack(own: pd.DataFrame) -> pd.DataFrame:
        rows = report([(int(r.mask), bool(r.good), bool(r.toxic), int(r.n)) for r in own.itertuples()])
        found = pd.DataFrame(rows, columns=RESULT.names)
        found.insert(0, "part", own["part"].iat[0])
        return found

    return counts.groupBy("part").applyInPandas(unpack, out)
