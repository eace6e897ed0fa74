"""From documents to token ids: five stages, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestream.llm import byte_bpe, decontaminate, secret_scan, simhash, toxicity
from pagestream.llm.common import cut_lineage, fold, free_name, ship, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that it predicts toxic go. It learns from the rows outside the held-out fold."""
    ship(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each group the document with the smallest id stays."""
    ship(spark)
    return simhash.keep_representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that hold a passage of the benchmark go."""
    ship(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: secrets are masked in the text; n_chars follows."""
    ship(spark)
    return secret_scan.redact_secrets(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit), exact (they decode to the text)."""
    ship(spark)
    name = free_name(docs, "tokens")
    out = byte_bpe.with_tokens(docs, *byte_bpe.default_files(), name)
    return out.select("doc_id", "lang", "source", F.col(name)["n_tokens"].alias("n_tokens"), F.col(name)["ids"].alias("ids"), F.col(name)["exact"].alias("exact"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", mask_secrets),
    ("byte-level BPE", tokenize),
]

#: No stage but the filters' joins can be said in SQL; tests compare the rows with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is kept in the shared checkpoint folder before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
