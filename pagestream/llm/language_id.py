"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ORDER bytes is counted over sampled texts and
then frozen. A byte costs -log2 of its share in the longest context that has seen it; each
longer context that was seen, but never before this byte, first pays an escape (method C:
as likely as the number of different bytes seen there, no exclusions). A text's code length
is exact under these statistics, over all of its bytes; the shortest wins.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestream.llm.common import schema

#: Bytes of the longest context.
ORDER = 4
#: The fit looks at no more texts of a language than this, by a hash of their ids, and at no more code points of them.
TEXTS_PER_LANGUAGE, CODES_PER_LANGUAGE = 400, 2_000_000
_TOGETHER = 200_000
UNKNOWN = "und"


class Level(NamedTuple):
    """Grams of one length: sorted keys, and costs in bits by language as this order's byte and as an escape."""

    keys: np.ndarray
    first: np.ndarray
    shift: int
    cost: np.ndarray


class Model(NamedTuple):
    languages: list[str]
    grams: list[Level]  # by length - 1: cost of the last byte of a gram known to some language
    escapes: list[Level]  # by length: cost of leaving the context
    unseen: float


def _keys(data: np.ndarray, length: int) -> np.ndarray:
    """The `length` bytes that end at each place, as one number; bytes before the start count as zero."""
    out = np.zeros(len(data), np.uint64)
    wide = data.astype(np.uint64)
    for back in range(length):
        out[back:] |= wide[:len(data) - back] << np.uint64(8 * back)
    return out


def _mixed(keys: np.ndarray) -> np.ndarray:
    return keys * np.uint64(0x9E3779B97F4A7C15)


def _level(keys: np.ndarray, cost: np.ndarray) -> Level:
    mixed = _mixed(keys)
    order = np.argsort(mixed)
    bits = max(1, int(np.ceil(np.log2(len(keys) + 1))) + 1)
    first = np.searchsorted(mixed[order] >> np.uint64(64 - bits), np.arange(2**bits + 1, dtype=np.uint64))
    return Level(mixed[order], first.astype(np.int32), 64 - bits, cost[order].astype(np.float32))


def _find(level: Level, keys: np.ndarray) -> np.ndarray:
    """Where each key is in the level, or -1."""
    mixed = _mixed(keys)
    slot = (mixed >> np.uint64(level.shift)).astype(np.int64)
    at, stop = level.first[slot], level.first[slot + 1]
    out = np.full(len(keys), -1, np.int32)
    open_ = np.flatnonzero(at < stop)
    while len(open_):
        here = at[open_]
        same = level.keys[here] == mixed[open_]
        out[open_[same]] = here[same]
        open_ = open_[~same]
        at[open_] += 1
        open_ = open_[at[open_] < stop[open_]]
    return out


def train(texts: dict[str, list[bytes]]) -> Model:
    """Counts the trees of all languages and freezes them as tables of costs."""
    languages = sorted(texts)
    pieces = [_joined(texts[lang]) for lang in languages]
    unseen = 8.0
    grams, escapes = [], []
    # Order -1: any byte, 8 bits. Each longer order builds on the costs of the one before.
    for length in range(1, ORDER + 2):
        counted = []
        for data, marks in pieces:
            keys = _keys(data, length)[marks[length - 1]]
            counted.append(np.unique(keys, return_counts=True))
        every = np.unique(np.concatenate([k for k, _ in counted])) if counted else np.zeros(0, np.uint64)
        context = every >> np.uint64(8)
        contexts, of = np.unique(context, return_inverse=True) if len(every) else (context, context.astype(int))
        cost = np.zeros((len(every), len(languages)))
        leave = np.zeros((len(contexts), len(languages)))
        for lang, (keys, counts) in enumerate(counted):
            n = np.zeros(len(every))
            n[np.searchsorted(every, keys)] = counts
            total = np.bincount(of, n, len(contexts))
            kinds = np.bincount(of, n > 0, len(contexts))
            with np.errstate(divide="ignore", invalid="ignore"):
                leave[:, lang] = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
                own = -np.log2(n / (total + kinds)[of])
            lower = _cost_below(grams, escapes, every, length, lang, unseen)
            cost[:, lang] = np.where(n > 0, own, leave[of, lang] + lower)
        grams.append(_level(every, cost))
        escapes.append(_level(contexts, leave))
    return Model(languages, grams, escapes, unseen)


def _cost_below(grams: list[Level], escapes: list[Level], keys: np.ndarray, length: int, lang: int, unseen: float) -> np.ndarray:
    """What the last byte costs in contexts shorter than length - 1."""
    out = np.zeros(len(keys))
    rest = np.arange(len(keys))
    for n in range(length - 1, 0, -1):
        key = keys[rest] & np.uint64((1 << (8 * n)) - 1)
        at = _find(grams[n - 1], key)
        known = at >= 0
        out[rest[known]] += grams[n - 1].cost[at[known], lang]
        rest = rest[~known]
        e = _find(escapes[n - 1], key[~known] >> np.uint64(8))
        out[rest[e >= 0]] += escapes[n - 1].cost[e[e >= 0], lang]
    out[rest] += unseen
    return out


def _joined(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """All bytes in a row, and for each context length the places that have as many bytes of their own text before."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return data, [np.flatnonzero(place >= n) for n in range(ORDER + 1)]


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits by text and language, over whole texts; a text's first bytes have shorter contexts."""
    out = np.zeros((len(texts), len(model.languages)))
    at, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text)
        size += len(text)
        if size >= _TOGETHER or i == len(texts) - 1:
            _add_lengths(model, held, out[at:i + 1])
            at, held, size = i + 1, [], 0
    return out


def _add_lengths(model: Model, texts: list[bytes], out: np.ndarray) -> None:
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    bits = np.zeros((len(data), len(model.languages)), np.float32)
    longest = _keys(data, ORDER + 1)
    place = np.minimum(np.arange(len(data)) - np.repeat(starts, sizes), ORDER)
    rest = np.arange(len(data))
    for n in range(ORDER + 1, 0, -1):
        ready = place[rest] >= n - 1
        wait, now = rest[~ready], rest[ready]
        key = longest[now] & np.uint64((1 << (8 * n)) - 1)
        found = _find(model.grams[n - 1], key)
        known = found >= 0
        bits[now[known]] += model.grams[n - 1].cost[found[known]]
        left = now[~known]
        e = _find(model.escapes[n - 1], key[~known] >> np.uint64(8))
        bits[left[e >= 0]] += model.escapes[n - 1].cost[e[e >= 0]]
        rest = np.concatenate([wait, left])
    bits[rest] += model.unseen
    full = np.flatnonzero(sizes)
    out[full] = np.add.reduceat(bits, starts[full], axis=0, dtype=np.float64)


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score): score is the language's share of 2 ** -bits; UNKNOWN and 0 without a letter.

    Of equal code lengths the language first in the alphabet wins.
    """
    lengths = code_lengths(model, [(t or "").encode() for t in texts])
    rows = []
    for text, bits in zip(texts, lengths):
        if not model.languages or not text or not any(map(str.isalpha, text)):
            rows.append((UNKNOWN, 0.0))
            continue
        best = int(np.argmin(bits))
        rows.append((model.languages[best], float(1 / np.exp2(np.minimum(bits[best] - bits, 0)).sum())))
    return rows


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The trees of every language in rows for which `usable` holds.

    The sample is TEXTS_PER_LANGUAGE texts of each language, the smallest by a hash, of whatever
    length; where they have more than CODES_PER_LANGUAGE code points, the fit reads so many. It
    is all that the driver gets. Repeated rows count once; a table without rows, or without
    texts, gives a model without languages. Hashes above a bar that follows from a language's
    number of texts never leave their task, so no task gathers a language.
    """
    rows = docs.where(usable & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.length(text_col).alias("size"),
    )
    keyed = rows.withColumn("h", F.xxhash64("id", F.xxhash64("text")))
    many = keyed.groupBy("lang").agg(F.approx_count_distinct("h").alias("many"))
    # About twice as many as wanted pass the bar: too few would, far from ever, only make the sample smaller.
    share = F.shiftrightunsigned("h", 11) / F.lit(float(2**53))
    near = keyed.join(F.broadcast(many), "lang").where(share * F.col("many") <= 2 * TEXTS_PER_LANGUAGE)
    near = near.select("lang", "h", "size").distinct()
    order = Window.partitionBy("lang").orderBy("h")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    chosen = near.withColumns({"n": F.row_number().over(order), "before": F.coalesce(before, F.lit(0))}).where(
        (F.col("n") <= TEXTS_PER_LANGUAGE) & (F.col("before") < CODES_PER_LANGUAGE)
    )
    picked = keyed.join(F.broadcast(chosen.select("lang", "h", "before")), ["lang", "h"])  # TEXTS_PER_LANGUAGE rows a language
    room = (F.lit(CODES_PER_LANGUAGE) - F.col("before")).cast("int")
    texts: dict[str, list[bytes]] = {}
    for lang, text in sorted(map(tuple, picked.select("lang", F.substring("text", F.lit(1), room)).distinct().collect())):
        texts.setdefault(lang, []).append(text.encode())
    return train(texts)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row; a null text or one without a letter is UNKNOWN.

    Repeated rows each give a row, an empty table none. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    @F.pandas_udf(schema("lang_pred string, score double"))
    def guess(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(predict(sent.value, texts.tolist()), columns=["lang_pred", "score"])

    return docs.select(F.col(id_col), guess(F.col(text_col)).alias("g")).select(id_col, "g.*")
