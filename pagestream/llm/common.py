"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestream.session import shared_dir

KINDS = {"long": T.LongType(), "string": T.StringType(), "binary": T.BinaryType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "int": T.IntegerType()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` doesn't have, so extra columns never clash."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fold(name: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as empty text (fold 0)."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % parts


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` as a reliable checkpoint in the folder that spark.checkpoint.dir names.

    A local session without one (tests) gets a temporary folder; on a cluster that is an error.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def schema(text: str) -> T.StructType:
    """"a long, b string" as a schema, without a session."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in map(str.split, text.split(", "))])


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, as their Python needs it there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))


_shipped: set[str] = set()
