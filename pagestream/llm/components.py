"""Connected components as joins and aggregates: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestream.llm.common import cut_lineage
from pagestream.operators.joins import hot_values, skew_join

#: Links among which hubs are not looked for.
SMALL = 1_000_000


def joined_by_hub(
    rows: DataFrame, values: DataFrame, key: str, row_id: str, how: str = "inner", share: float = 0.02
) -> DataFrame:
    """`rows` with the one row of `values` for their key, keys with that share of the rows dealt to several tasks by `row_id`."""
    return skew_join(rows, values, [key], how, hot_left=hot_values(rows, key, share), left_id=row_id)


def _joined(rows: DataFrame, least: DataFrame, many: int) -> DataFrame:
    """Up to SMALL links a hub's are little work for one task, and looking for hubs would cost more."""
    return rows.join(least, "a") if many <= SMALL else joined_by_hub(rows, least, "a", "b")


def _large_star(links: DataFrame, many: int) -> DataFrame:
    """Every larger neighbour of a node goes to the node's smallest neighbour, or itself."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        _joined(both, least, many).where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
    )


def _small_star(links: DataFrame, many: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, go to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return (
        _joined(down, least, many).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select("a", F.col("m").alias("b")))
    )


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in `links` (columns a, b); component is its smallest node.

    Nulls and loops are ignored; no link gives no row. A step keeps at most as many links as
    before, a hub's links are combined on the map side, and the joins' hot keys are split by
    hot_values and skew_join. Each round is a reliable checkpoint. Ends when the links no longer
    change: then every node points at its smallest one.
    """
    links = links.select("a", "b").where(F.col("a") != F.col("b")).distinct()
    links = cut_lineage(links)

    def state_of(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = state_of(links)
    for _ in range(max_rounds if seen[0] else 1):
        stars = _small_star(_large_star(links, seen[0]), seen[0])
        links = cut_lineage(stars.where(F.col("a") != F.col("b")).distinct())
        state = state_of(links)
        if state == seen or not state[0]:
            break
        seen = state
    else:
        raise RuntimeError(f"links still change after {max_rounds} rounds")
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
