"""Quality rules and a hashed n-gram log-likelihood ratio, all in built-in expressions.

Pairs of neighbouring tokens (runs of letters and digits, and single other signs) are hashed
into buckets. Two multinomials over the buckets are counted, one over a bounded sample of the
trusted documents and one over the whole corpus; a document's score is the mean of
log(p_trusted / p_raw) over its pairs, and every document is judged by the same fixed
threshold on it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the multinomials: the model is this many doubles, at any size of the corpus.
BUCKETS = 16_384
#: The trusted multinomial is counted over no more documents than this, by a hash of their ids.
TRUSTED_ROWS = 20_000
#: Added to each bucket's count.
SMOOTHING = 1.0
#: A document is kept from this mean log ratio on.
THRESHOLD = -0.1
#: Base rules: fewest words, and the largest share of words in repeated windows, in percent.
MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8

_SPACE = r"[\x20\x09-\x0D]+"
#: In lower case: runs of a-z, 0-9 and all signs beyond ASCII; any other sign that isn't white space by itself.
_TOKEN = r"[a-z0-9\u0080-\x{10FFFF}]+|[^a-z0-9\u0080-\x{10FFFF}\x20\x09-\x0D]"


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`value` computed once per row: a generator's output is not repeated in later expressions."""
    return df.select("*", F.explode(F.array(F.struct(value.alias("v")))).alias(name))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0))


def _bucket(a: Column, b: Column) -> Column:
    return F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int")


def _from(values: Column, at: int) -> Column:
    return F.slice(values, at, F.size(values))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, though `use` names it more often."""
    return F.get(F.transform(F.array(value), use), 0)


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of the WINDOW = 8 words from each place: of 2, of twice 2, of twice 4 words."""
    def twice(hashes: Column, words_each: int) -> Column:
        return F.zip_with(hashes, _from(hashes, words_each + 1), lambda a, b: F.xxhash64(a, b))

    eights = _let(twice(words, 1), lambda twos: _let(twice(twos, 2), lambda fours: twice(fours, 4)))
    return F.slice(eights, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))  # the rest lacks words


def fit_ratio(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, `ratio`: the log ratio of each bucket, in order.

    Raw counts are over all documents; trusted ones over documents of at most TRUSTED_ROWS ids in
    `trusted`. They are combined per bucket on the map side, so no more than BUCKETS rows a
    task are shuffled, and no text.
    """
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = trusted.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(TRUSTED_ROWS)

    def counted(rows: DataFrame, name: str) -> DataFrame:
        tokens = _held(rows.select("text"), "t", tokens_of(F.col("text"))).select(F.col("t.v").alias("t"))
        pairs = tokens.select(F.inline(F.arrays_zip(F.col("t").alias("a"), _from(F.col("t"), 2).alias("b"))))
        pairs = pairs.toDF("a", "b").where("b is not null")
        return pairs.groupBy(_bucket(F.col("a"), F.col("b")).alias("bucket")).agg(F.count(F.lit(1)).alias(name))

    raw = counted(text, "raw")
    good = counted(text.join(F.broadcast(ids), "id", "left_semi"), "good")  # at most TRUSTED_ROWS ids
    counts = raw.join(good, "bucket", "left")  # a row for each bucket at most
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").select(
        "bucket", (F.coalesce("raw", F.lit(0)) + SMOOTHING).alias("raw"), (F.coalesce("good", F.lit(0)) + SMOOTHING).alias("good")
    )
    listed = filled.agg(
        F.sum("raw").alias("raw"), F.sum("good").alias("good"),
        F.array_sort(F.collect_list(F.struct("bucket", F.log(F.col("good") / F.col("raw")).alias("l")))).alias("by"),
    )
    shift = F.log(F.col("raw") / F.col("good"))
    return listed.select(F.transform("by", lambda x: x["l"] + shift).alias("ratio"))


def judge_quality(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) per row.

    A null or empty text has no word, score 0 and fails; a single token scores 0. Without trusted documents every ratio
    compares a flat distribution with the corpus. Windows are compared by a 64-bit hash of
    their words. Repeated rows each give a row; other columns are not read. Rows never meet,
    so nothing is shuffled but the counts of the model.
    """
    ratio = fit_ratio(docs, trusted, id_col, text_col).scalar()
    df = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    df = _held(df, "_w", words_of(F.col("_text")))
    words = F.col("_w.v")
    n = F.size(words)
    df = _held(df, "_h", window_hashes(words))
    hashes = F.col("_h.v")
    by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    has_repeat = F.size(F.array_distinct(hashes)) < F.size(hashes)
    df = _held(df, "_s", F.when(has_repeat, by_hash))
    ordered = F.col("_s.v")

    def twin(x: Column, i: Column) -> Column:
        before = F.get(ordered, i - 1)["h"]
        after = F.get(ordered, i + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    starts = F.sort_array(F.transform(F.filter(ordered, twin), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at"))
    covered = F.aggregate(
        starts, start,
        lambda acc, at: F.struct((acc["n"] + F.least(F.lit(WINDOW), at - acc["at"])).alias("n"), at.alias("at")),
        lambda acc: acc["n"],
    )
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = _held(df, "_l", lines)
    df = _held(df, "_t", tokens_of(F.col("_text")))
    tokens = F.col("_t.v")
    pairs = F.size(tokens) - 1
    ratios = F.zip_with(
        F.slice(tokens, 1, F.greatest(pairs, F.lit(0))), _from(tokens, 2),
        lambda a, b: F.get(F.col("_ratio"), _bucket(a, b)),
    )
    total = F.aggregate(ratios, F.lit(0.0), lambda acc, r: acc + r)
    df = df.withColumn("_ratio", ratio).select(
        id_col,
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l.v") - F.size(F.array_distinct("_l.v"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.when(pairs > 0, total / pairs).otherwise(0.0).alias("score"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return df.select("*", failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"))
