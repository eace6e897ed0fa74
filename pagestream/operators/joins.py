"""Equi-joins that stay spread out when a few keys hold much of the rows."""

from math import ceil

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestream.session import shuffle_partitions


def hot_values(rows, column, share=0.02, tracked=2_000):
    """Values that hold at least `share` of all rows, each with its share.

    One pass with a bounded sketch per task; the answer has at most 1/share values.
    It only steers how rows are spread, never which rows are joined.
    """
    top = F.expr(f"approx_top_k(`{column}`, {ceil(1 / share)}, {tracked})")
    found = rows.agg(top.alias("top"), F.count(F.col(column)).alias("total")).first()
    return {
        item["item"]: item["count"] / found["total"]
        for item in found["top"] or []
        if item["item"] is not None and item["count"] >= share * found["total"]
    }


def hot_unless_adaptive(rows, column):
    """For a join whose hot values nobody gave.

    Adaptive execution cuts skewed partitions of a batch join from their measured
    sizes, without reading the rows twice. Only where it is off, look for hot values.
    """
    conf = rows.sparkSession.conf
    adaptive = all(
        conf.get(f"spark.sql.adaptive.{key}").lower() == "true" for key in ("enabled", "skewJoin.enabled")
    )
    return {} if adaptive or rows.isStreaming else hot_values(rows, column)


def _with_parts(rows, column, parts, name):
    """Add into how many pieces the rows of a value are cut, 1 for most values.

    The broadcast table has a row per hot value, so at most 1/share rows.
    """
    kind = rows.schema[column].dataType
    schema = T.StructType([T.StructField(column, kind), T.StructField(name, T.IntegerType())])
    table = rows.sparkSession.createDataFrame(list(parts.items()), schema)
    return rows.join(F.broadcast(table), column, "left").withColumn(
        name, F.coalesce(name, F.lit(1))
    )


def skew_join(left, right, on, how="inner", hot_left=None, hot_right=None,
              left_id=None, right_id=None):
    """Join on the columns `on` (the last of them may be skewed), `inner` or `left`.

    `hot_left` and `hot_right` map values of the last join column to their share of
    that side, as `hot_values` gives them. Rows of such a value are cut into pieces
    in proportion to the share, the other side is copied to each piece, so no task
    gets them all and every pair still meets exactly once. Only rows of hot values
    are copied. With nothing hot this is a plain join, and Spark picks broadcast or
    shuffle from the sizes it knows or, with adaptive execution, has measured.

    `left_id` and `right_id` are columns that differ from row to row. A repeated
    attempt of a task must put a row in the same piece, so without an id the side
    has to come from a scan without a shuffle in between, where the row number of
    the task serves.
    """
    on = list(on)
    if how == "left" and hot_right:
        raise ValueError("the right side of a left join cannot be cut")
    partitions = shuffle_partitions(left.sparkSession)
    pieces = []
    for side, shares, row_id in (("left", hot_left, left_id), ("right", hot_right, right_id)):
        # Less than a task's share of the rows needs no cutting.
        parts = {v: ceil(s * partitions) + 1 for v, s in (shares or {}).items() if s * partitions >= 1}
        if not parts:
            continue
        piece, count = f"_piece_of_{side}", f"_pieces_of_{side}"
        number = F.xxhash64(row_id) if row_id else F.monotonically_increasing_id()
        own = F.pmod(number, F.col(count)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(count) - 1))
        left, right = (
            _with_parts(rows, on[-1], parts, count).withColumn(piece, how_many).drop(count)
            for rows, how_many in ((left, own if side == "left" else every),
                                   (right, own if side == "right" else every))
        )
        pieces.append(piece)
    return left.join(right, on + pieces, how).drop(*pieces)
