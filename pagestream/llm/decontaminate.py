"""Benchmark decontamination by the q-gram lemma.

Items are cut into overlapping windows. A window found in a text with at most k edits shares
at least |w| + 1 - q (k + 1) of its q-grams with it, on neighbouring diagonals (place in the
text minus place in the window). So shared q-grams are counted in overlapping diagonal bands,
bands that reach the bound are kept, and a banded alignment verifies each of them.

Texts are compared in lower case, with every run of signs other than letters and digits as one
space. Short windows use shorter grams, so the bound holds at the same rate of edits; those too
short for one edit must occur exactly, as whole words. The benchmark is the stated query set:
it goes to the tasks in blocks of bounded size. With more than one block a bitmap of all its
grams finds, in one pass over the texts, the few that may hold a window; only these meet the
blocks, one after another.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestream.llm.common import cut_lineage, free_name, schema

#: Code points of a gram; fewer for windows that could not keep the bound with so many.
Q = 10
#: Code points of a window; shorter items are one window.
WINDOW = 100
#: Edits allowed per code point of a window.
EDIT_RATE = 0.08
#: Code points of items sent to the tasks at a time.
BLOCK_CHARS = 2_000_000
#: Code points of texts looked at together in a task.
_TOGETHER = 50_000
_BITS = 23
#: Bits of the bitmap of all grams of a benchmark of many blocks, as a power of two.
_ALL_BITS = 27

RESULT = schema("item_id long, start long, end long, edits long, windows long")


def _fold_table() -> np.ndarray:
    """For each code point of the first two planes: the lower-case form, where it is one code point; 0 for no letter or digit."""
    out = np.zeros(0x20000, np.uint32)
    for code in range(len(out)):
        sign = chr(code)
        if sign.isalnum():
            low = sign.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


_FOLD: list[np.ndarray] = []


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, places): letters and digits in lower case, one space (32) between runs, and where each was."""
    if not _FOLD:
        _FOLD.append(_fold_table())
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _FOLD[0][np.minimum(raw, len(_FOLD[0]) - 1)]
    far = raw >= len(_FOLD[0])
    if far.any():
        low = low.copy()
        low[far] = [code if chr(code).isalnum() else 0 for code in raw[far].tolist()]
    letter = low != 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a run's first sign stands for it
    places = np.flatnonzero(keep)
    codes = low[places]
    codes[codes == 0] = 32
    return codes, places


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q codes from each place."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = [1]
    while len(base) <= q:
        base.append(base[-1] * 0x9E3779B97F4A7C15 % 2**64)
    one = codes.astype(np.uint64)
    if q == 10:
        two = one[:-1] * np.uint64(base[1]) + one[1:]
        four = two[:-2] * np.uint64(base[2]) + two[2:]
        eight = four[:-4] * np.uint64(base[4]) + four[4:]
        whole = eight[:n] * np.uint64(base[2]) + two[8:8 + n]
    else:
        whole = np.zeros(n, np.uint64)
        for at in range(q):
            whole += one[at:at + n] * np.uint64(base[q - 1 - at])
    return (whole ^ (whole >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Window(NamedTuple):
    item: int
    codes: np.ndarray
    edits: int
    q: int
    least: int


def windows_of(item: int, text: str | None) -> list[Window]:
    codes = normalised(text or "")[0]
    if len(codes) and codes[-1] == 32:
        codes = codes[:-1]
    if len(codes) and codes[0] == 32:
        codes = codes[1:]
    if not len(codes):
        return []
    size = min(WINDOW, len(codes))
    starts = sorted({*range(0, len(codes) - size + 1, WINDOW // 2), len(codes) - size})
    edits = int(size * EDIT_RATE)
    q = min(Q, size // (edits + 1))
    return [Window(item, codes[s:s + size], edits, q, size + 1 - q * (edits + 1)) for s in starts]


class Index:
    """Windows of a block of items, and where their grams are, by the length of the grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.windows = [w for item, text in items for w in windows_of(item, text)]
        self.grams = [Grams(self.windows, q) for q in sorted({w.q for w in self.windows}, reverse=True)]


class Grams:
    """The windows whose grams have q codes."""

    def __init__(self, windows: list[Window], q: int):
        self.windows, self.q = windows, q
        own = [i for i, w in enumerate(windows) if w.q == q]
        hashes = [gram_hashes(windows[i].codes, q) for i in own]
        at = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        order = np.argsort(at, kind="stable")
        self.grams = at[order]
        self.of = np.repeat(np.array(own, np.int32), [len(h) for h in hashes])[order]
        self.place = np.concatenate([*(np.arange(len(h), dtype=np.int32) for h in hashes), np.zeros(0, np.int32)])[order]
        self.marks = np.zeros(1 << _BITS, bool)
        self.marks[(at >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.least = min(windows[i].least for i in own)
        self.reach = max(len(windows[i].codes) + windows[i].edits for i in own)  # codes that a match can span
        self.sizes = np.array([w.least for w in windows])
        self.room = np.array([w.edits for w in windows])

    def whole_words(self, codes: np.ndarray, window: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Exact matches of windows without an edit, among hits of their first grams."""
        found, n = [], len(codes)
        for w, s in zip(window.tolist(), start.tolist()):
            target = self.windows[w].codes
            e = s + len(target)
            if e <= n and (s == 0 or codes[s - 1] == 32) and (e == n or codes[e] == 32) and (codes[s:e] == target).all():
                found.append((w, s, e, 0))
        return found

    def search(self, codes: np.ndarray, hashes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(window, start, end, edits) in `codes`: the best region of each window and band that is verified."""
        hit = np.flatnonzero(self.marks[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        low, high = np.searchsorted(self.grams, hashes[hit]), np.searchsorted(self.grams, hashes[hit], "right")
        many = high - low
        if many.sum() < self.least:
            return []
        text_at = np.repeat(hit, many)
        post = np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)
        window, place = self.of[post].astype(np.int64), self.place[post]
        diagonal = text_at - place
        exact = self.room[window] == 0
        found = []
        if exact.any():
            first = exact & (place == 0)
            found = self.whole_words(codes, window[first], text_at[first])
            window, diagonal = window[~exact], diagonal[~exact]
        # Each hit counts in the two bands of 2 (k + 1) diagonals that cover it: a match's diagonals lie in one.
        width = self.room[window] + 1
        band = np.floor_divide(diagonal, width)
        key = np.concatenate([window * 2**40 + (band + 2**20), window * 2**40 + (band + 2**20 - 1)])
        own, first, counts = np.unique(key, return_index=True, return_counts=True)
        full = counts >= self.sizes[np.concatenate([window, window])[first]]
        regions: list[list[int]] = []  # [window, first band, last band]; bands that overlap are aligned together
        for k in own[full].tolist():
            w, b = k >> 40, (k & (2**40 - 1)) - 2**20
            if regions and regions[-1][0] == w and b <= regions[-1][2] + 1 and b - regions[-1][1] < 4:
                regions[-1][2] = b
            else:
                regions.append([w, b, b])
        for w, b, b_last in regions:
            target, room = self.windows[w], int(self.room[w])
            region_from = max(0, b * (room + 1) - room)
            region = codes[region_from:(b_last + 2) * (room + 1) + len(target.codes) + room]
            best = aligned(target.codes, region, room) if shares_grams(target.codes, region, room) else None
            if best:
                found.append((w, region_from + best[0], region_from + best[1], best[2]))
        return found


def shares_grams(window: np.ndarray, region: np.ndarray, most: int, q: int = 4) -> bool:
    """The lemma again with short grams, on one region: rejects most of what only shares a phrase."""
    w, r = window.tobytes(), region.tobytes()
    step, have = window.itemsize, {r[i:i + q * region.itemsize] for i in range(0, len(r), region.itemsize)}
    shared = sum(w[i:i + q * step] in have for i in range(0, len(w) - (q - 1) * step, step))
    return shared >= len(window) + 1 - q * (most + 1)


def aligned(window: np.ndarray, region: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the part of `region` nearest to `window`, if within `most` edits.

    Banded: cells further from the region's diagonals than the edits allow are never
    computed. Of equal distances the first end counts. An exact copy is the band's plain
    diagonal and is looked for first.
    """
    m, n = len(window), len(region)
    if n < m - most:
        return None
    at = region.tobytes().find(window.tobytes())
    while at >= 0 and at % region.itemsize:
        at = region.tobytes().find(window.tobytes(), at + 1)
    if at >= 0:
        return at // region.itemsize, at // region.itemsize + m, 0
    spare = max(0, n - m) + most  # diagonals from -most to the last possible start
    w, r = window.tolist(), region.tolist()
    far = most + 1
    row, origin = {j: 0 for j in range(n + 1)}, {j: j for j in range(n + 1)}
    for i in range(1, m + 1):
        new, new_origin = {}, {}
        for j in range(max(0, i - most), min(n, i + spare) + 1):
            best, begin = far, -1
            if j and (d := row.get(j - 1, far)) < far:
                best, begin = d + (w[i - 1] != r[j - 1]), origin[j - 1]
            if (d := row.get(j, far) + 1) < best:
                best, begin = d, origin[j]
            if j and (d := new.get(j - 1, far) + 1) < best:
                best, begin = d, new_origin[j - 1]
            if best < far:
                new[j], new_origin[j] = best, begin
        row, origin = new, new_origin
        if not row:
            return None
    end = min(row, key=lambda j: (row[j], j), default=None)
    return None if end is None else (origin[end], end, row[end])


def merged(index: Index, hits: list[tuple[int, int, int, int]], places: np.ndarray, length: int) -> list[tuple]:
    """A row for each item: from the first to the last code point matched, fewest edits, distinct windows."""
    rows: dict[int, list] = {}
    for w, start, end, edits in hits:
        first = int(places[start])
        last = int(places[end - 1]) + 1 if end else 0
        row = rows.setdefault(index.windows[w].item, [first, last, edits, set()])
        row[0], row[1], row[2] = min(row[0], first), min(length, max(row[1], last)), min(row[2], edits)
        row[3].add(w)
    return [(item, a, b, e, len(ws)) for item, (a, b, e, ws) in sorted(rows.items())]


def search_texts(texts: list[str | None], index: Index) -> list[list[tuple]]:
    """For each text the rows of `merged`. Texts are hashed together, hits stay within a text."""
    return [merged(index, hits, places, length) if hits else [] for hits, places, length in _hits(texts, index)]


def _hits(texts: list[str | None], index: Index) -> Iterator[tuple[list, np.ndarray, int]]:
    held: list[tuple[np.ndarray, np.ndarray, int]] = []

    def flush() -> Iterator[tuple[list, np.ndarray, int]]:
        together = np.concatenate([np.zeros(0, np.uint32), *(c for c, _, _ in held)])
        found: list[list] = [[] for _ in held]
        for grams in index.grams:
            hashes = gram_hashes(together, grams.q)
            marked = np.concatenate([[0], np.cumsum(grams.marks[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])])
            at = 0
            for own, (codes, _, _) in zip(found, held):
                n = max(0, len(codes) - grams.q + 1)
                sums = marked[at:at + n + 1]
                reach = min(n, grams.reach)
                if n and (sums[reach:] - sums[:n + 1 - reach]).max() >= grams.least:
                    own += grams.search(codes, hashes[at:at + n])
                at += len(codes)
        yield from ((own, places, length) for own, (_, places, length) in zip(found, held))
        held.clear()

    size = 0
    for text in texts:
        codes, places = normalised(text or "")
        held.append((codes, places, len(text or "")))
        size += len(codes)
        if size >= _TOGETHER:
            yield from flush()
            size = 0
    yield from flush()


class Marks:
    """Which grams a whole benchmark has, in a bitmap of fixed size, by the length of the grams."""

    def __init__(self):
        self.bits: dict[int, np.ndarray] = {}
        self.least: dict[int, int] = {}
        self.reach: dict[int, int] = {}

    def add(self, index: Index) -> None:
        for grams in index.grams:
            q = grams.q
            bits = self.bits.setdefault(q, np.zeros(1 << (_ALL_BITS - 3), np.uint8))
            at = np.unique(grams.grams >> np.uint64(64 - _ALL_BITS)).astype(np.int64)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
            self.least[q] = min(self.least.get(q, 1 << 62), grams.least)
            self.reach[q] = max(self.reach.get(q, 0), grams.reach)

    def maybe(self, text: str | None) -> bool:
        """False where the text holds no window, for certain."""
        codes = normalised(text or "")[0]
        for q, bits in self.bits.items():
            at = (gram_hashes(codes, q) >> np.uint64(64 - _ALL_BITS)).astype(np.int64)
            if not len(at):
                continue
            sums = np.concatenate([[0], np.cumsum(bits[at >> 3] >> (at & 7) & 1, dtype=np.int64)])
            reach = min(len(at), self.reach[q])
            if (sums[reach:] - sums[:len(sums) - reach]).max() >= self.least[q]:
                return True
        return False


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[tuple[int, str], ...]]:
    """Items in order of their ids, in blocks of at most BLOCK_CHARS code points (or one item)."""
    block, size = [], 0
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    for item, text in items.distinct().orderBy("i", "t").toLocalIterator():
        if block and size + len(text) > BLOCK_CHARS:
            yield tuple(block)
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    if block:
        yield tuple(block)


def _sent_blocks(spark: SparkSession, benchmark: DataFrame, id_col: str, text_col: str) -> Iterator:
    """Each block as a broadcast that goes when the next is asked for."""
    for block in _blocks(benchmark, id_col, text_col):
        sent = spark.sparkContext.broadcast(block)
        yield sent
        sent.unpersist()


def _suspects(docs: DataFrame, benchmark: DataFrame, id_col: str, item_col: str, item_text_col: str, text_col: str, out: str) -> DataFrame:
    """`docs`, kept, with whether a text may hold a window of a benchmark of many blocks: one pass over all texts."""
    marks = Marks()
    for block in _blocks(benchmark, item_col, item_text_col):
        marks.add(Index(list(block)))
    sent = docs.sparkSession.sparkContext.broadcast(marks)  # a bitmap of fixed size for each length of grams

    @F.pandas_udf(T.BooleanType())
    def maybe(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.maybe(t) for t in texts], dtype=bool)

    return cut_lineage(docs.withColumn(out, maybe(F.col(text_col))))


def _more_than_one(benchmark: DataFrame, id_col: str, text_col: str) -> bool:
    blocks = _blocks(benchmark, id_col, text_col)
    return next(blocks, None) is not None and next(blocks, None) is not None


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(id, item_id, start, end, edits, windows) for each row and item that it holds a window of.

    start and end are code points of the text. Null and empty texts and items match nothing, nor
    does an item without a letter or digit. Repeated rows each give rows; other columns are not
    read. No shuffle: one pass over the texts, and with more than one block one more for each
    block over those texts that the first pass leaves.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    many = _more_than_one(benchmark, item_col, item_text_col)
    if many:
        narrow = _suspects(narrow, benchmark, "id", item_col, item_text_col, "text", "maybe").where("maybe").drop("maybe")
    kinds = T.StructType([*narrow.select("id").schema.fields, *RESULT.fields])
    parts = []
    for sent in _sent_blocks(docs.sparkSession, benchmark, item_col, item_text_col):
        found = narrow.mapInPandas(_searcher(sent), kinds)
        parts.append(cut_lineage(found) if many else found)
    if not parts:
        parts = [narrow.select("id", *(F.lit(None).cast(f.dataType).alias(f.name) for f in RESULT.fields)).where(F.lit(False))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("id", id_col)


def _searcher(sent):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(list(sent.value))  # once a task, and gone with it
        for batch in batches:
            rows = [
                (place, *row)
                for place, found in zip(batch.index, search_texts(batch["text"].tolist(), index)) for row in found
            ]
            out = pd.DataFrame(rows, columns=["place", *RESULT.names]).set_index("place")
            yield batch[["id"]].join(out, how="inner")[["id", *RESULT.names]]

    return search


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """`docs` without the rows whose text holds a window of an item; all columns and other rows stay.

    Null and empty texts stay. With more than one block the rows that may hold a window are cut
    down block by block, each cut written before the next.
    """
    spark = docs.sparkSession
    if not _more_than_one(benchmark, item_col, item_text_col):
        for sent in _sent_blocks(spark, benchmark, item_col, item_text_col):
            return docs.where(~_leaks(sent)(F.col(text_col)))
        return docs
    name = free_name(docs, "maybe")
    marked = _suspects(docs, benchmark, id_col, item_col, item_text_col, text_col, name)
    left = marked.where(F.col(name))
    for sent in _sent_blocks(spark, benchmark, item_col, item_text_col):
        left = cut_lineage(left.where(~_leaks(sent)(F.col(text_col))))
    return marked.where(~F.col(name)).unionByName(left).drop(name)


def _leaks(sent):
    @F.pandas_udf(T.BooleanType())
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(list(sent.value))  # once a task, and gone with it
        for texts in batches:
            yield pd.Series([bool(x) for x in search_texts(texts.tolist(), index)], dtype=bool)

    return leaks
