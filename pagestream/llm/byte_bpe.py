"""Byte-level BPE encoding by prefix dynamic programming, and decoding.

For each byte prefix of a piece the encoding's last token is stored. It is unique: of the
tokens that end at a byte, exactly one forms, with the last token of the prefix before it, a
pair that encodes to itself. The encoding is read backwards from the last prefix; appending
bytes only adds entries. An edit recomputes entries from its first changed byte on, until as
many in a row as the longest token has bytes agree with the old ones; the rest is copied.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestream.llm.common import schema

#: Bytes that a worker's table of pieces may take, about; its older half goes when it is full.
TABLE_BYTES = 24_000_000
#: Entries of the tables of pairs and of edges; a full table is started anew.
PAIR_ENTRIES, EDGE_ENTRIES = 50_000, 10_000


class PrefixEncoder:
    """Encodes byte strings by rank; `ranks` maps bytes to ids and holds all single bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._pairs: dict[int, bool] = {}
        # The two halves of each token: -2 not known yet, -1 none.
        self._halves = tuple(array("i", [-2]) * (max(self.tokens) + 1) for _ in range(2))
        self._edges: tuple[dict, dict] = ({}, {})

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made it; None for a byte or a token no merge reaches."""
        left, right = self._halves[0][token], self._halves[1][token]
        if left == -2:
            data, ranks = self.tokens[token], self.ranks
            rest = [data[i:i + 1] for i in range(len(data))]
            while len(rest) > 2:
                rank, at = min(
                    (ranks.get(rest[i] + rest[i + 1], 1 << 62), i) for i in range(len(rest) - 1)
                )
                if rank >= token:
                    break
                rest[at:at + 2] = [rest[at] + rest[at + 1]]
            left, right = (ranks[rest[0]], ranks[rest[1]]) if len(rest) == 2 else (-1, -1)
            self._halves[0][token], self._halves[1][token] = left, right
        return None if left == -1 else (left, right)

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The tokens that stand at one edge while it is merged, last first, each with the rank that ends it."""
        edges = self._edges[side]
        found = edges.get(token)
        if found is None:
            if len(edges) >= EDGE_ENTRIES:
                edges.clear()
            found, at, ends = [], token, 1 << 62
            while True:
                found.append((self.tokens[at], ends))
                split = self.parts(at)
                if split is None:
                    break
                at, ends = split[side], at
            edges[token] = found
        return found

    def stands(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side encode to themselves.

        They don't if, at some time while they are merged, what stands on both sides of the
        border merges first. Of equal ranks the one further left goes first.
        """
        get = self.ranks.get
        lefts, rights = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            (a, ends), (b, b_ends) = lefts[i], rights[j]
            rank = get(a + b)
            if rank is not None and rank < ends and rank <= b_ends:
                return False
            # back in time: undo the later of the two merges
            born_a = self._born(lefts, i)
            born_b = self._born(rights, j)
            if born_a < 0 and born_b < 0:
                return True
            if born_a >= born_b:
                i += 1
            else:
                j += 1

    @staticmethod
    def _born(edge: list[tuple[bytes, int]], at: int) -> int:
        """The rank of the merge that made this entry; -1 for a byte."""
        return edge[at + 1][1] if at + 1 < len(edge) else -1

    def _last(self, data: bytes, end: int, out: array) -> int:
        """The last token of data[:end], from the entries before it."""
        get, pairs, longest = self.ranks.get, self._pairs, self.longest
        for start in range(end - longest if end > longest else 0, end):
            token = get(data[start:end])
            if token is None:
                continue
            if start == 0:
                fits = end == 1 or self.parts(token) is not None
            else:
                key = out[start - 1] << 32 | token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= PAIR_ENTRIES:
                        pairs.clear()
                    fits = pairs[key] = self.stands(out[start - 1], token)
            if fits:
                return token
        raise ValueError("a byte has no token")

    def prefixes(self, data: bytes, last: array | None = None, keep: int = 0) -> array:
        """last[i]: the last token of data[:i + 1]; the first `keep` entries of `last` are used as they are."""
        out = array("l", last[:keep]) if last is not None else array("l")
        for end in range(len(out) + 1, len(data) + 1):
            out.append(self._last(data, end, out))
        return out

    def append(self, data: bytes, last: array, more: bytes) -> array:
        """The entries of data + more, from those of data."""
        return self.prefixes(data + more, last, len(data))

    def edit(self, last: array, data: bytes, changed: bytes) -> array:
        """The entries of `changed`, from those of `data`.

        What is before the first changed byte stays. Behind the last one an entry follows from
        the bytes of the longest token and the entries before these, so once that many agree
        with the old ones, all later ones do.
        """
        same, shorter = 0, min(len(data), len(changed))
        while same < shorter and data[same] == changed[same]:
            same += 1
        tail = 0
        while tail < shorter - same and data[len(data) - 1 - tail] == changed[len(changed) - 1 - tail]:
            tail += 1
        out, shift, agreed = array("l", last[:same]), len(data) - len(changed), 0
        for end in range(same + 1, len(changed) + 1):
            out.append(self._last(changed, end, out))
            kept = end > len(changed) - tail and out[-1] == last[end - 1 + shift]
            agreed = agreed + 1 if kept else 0
            if agreed >= self.longest:
                out.extend(last[end + shift:])
                break
        return out

    def read(self, last: array) -> list[int]:
        """The encoding, from its entries."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[out[-1]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        """A whole piece that is a token is that token, as with the public library."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.read(self.prefixes(data))


class BatchEncoder:
    """The same entries for many short pieces at once: a column of prefixes per step, in numpy.

    Tokens are found by a hash of their bytes (compared in full where the table is built);
    pairs in a table of fixed size that keeps the pair last seen in each slot.
    """

    WIDEST, SLOTS = 32, 19

    def __init__(self, encoder: PrefixEncoder):
        self.encoder = encoder
        top = max(encoder.tokens) + 1
        self.lengths = np.zeros(top, np.int64)
        for token, data in encoder.tokens.items():
            self.lengths[token] = len(data)
        self.starts = np.zeros(top, np.int64)
        self.starts[1:] = np.cumsum(self.lengths)[:-1]
        self.flat = np.frombuffer(b"".join(encoder.tokens.get(i, b"") for i in range(top)), np.uint8)
        self.reached = np.array([
            i in encoder.tokens and (self.lengths[i] == 1 or encoder.parts(i) is not None) for i in range(top)
        ])
        short = [(d, i) for d, i in encoder.ranks.items() if len(d) <= self.WIDEST]
        self.sizes = sorted({len(d) for d, _ in short})
        keys = np.zeros(len(short), np.uint64)
        for at, (data, _) in enumerate(short):
            h = 0
            for byte in data:
                h = (h * self.BASE + byte + 1) & 0xFFFFFFFFFFFFFFFF
            keys[at] = h
        keys = self._mixed(keys)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([i for _, i in short], np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two tokens share a hash")
        self.first = np.searchsorted(self.keys >> np.uint64(42), np.arange(2**22 + 1, dtype=np.uint64))
        self.widest_bin = int(np.diff(self.first).max())
        self.first = self.first.astype(np.int32)
        self.pair_keys = np.full(1 << self.SLOTS, -1, np.int64)
        self.pair_fits = np.zeros(1 << self.SLOTS, bool)

    BASE = 0x9E3779B97F4A7C15

    @staticmethod
    def _mixed(hashes: np.ndarray) -> np.ndarray:
        return (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)

    def _tokens(self, hashes: np.ndarray) -> np.ndarray:
        """The token of each hash, or -1."""
        hashes = self._mixed(hashes)
        low = self.first[(hashes >> np.uint64(42)).astype(np.int64)]
        out = np.full(len(hashes), -1, np.int64)
        for step in range(self.widest_bin):
            at = np.minimum(low + step, len(self.keys) - 1)
            same = self.keys[at] == hashes
            out[same] = self.ids[at[same]]
        return out

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        slot = ((key.astype(np.uint64) * np.uint64(self.BASE)) >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        fits, new = self.pair_fits[slot], self.pair_keys[slot] != key
        if new.any():
            pairs, where = np.unique(key[new], return_inverse=True)
            stands = self.encoder.stands
            known = np.array([stands(k >> 20, k & 0xFFFFF) for k in pairs.tolist()], bool)
            fits[new] = known[where]
            slots = ((pairs.astype(np.uint64) * np.uint64(self.BASE)) >> np.uint64(64 - self.SLOTS)).astype(np.int64)
            self.pair_keys[slots] = pairs
            self.pair_fits[slots] = known
            again = self.pair_keys[slots] == pairs  # of two new pairs in one slot, one stays
            self.pair_fits[slots[again]] = known[again]
        return fits

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids as little-endian bytes, for pieces of 1 to WIDEST bytes."""
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        out: list[bytes] = [b""] * len(pieces)
        for at in range(0, len(order), 20_000):
            part = order[at:at + 20_000]
            for i, ids in zip(part, self._encode([pieces[i] for i in part])):
                out[i] = ids
        return out

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        n, size = len(pieces), np.array([len(p) for p in pieces])
        width = int(size.max())
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        columns = np.ascontiguousarray(data.T).astype(np.uint64) + np.uint64(1)
        last = np.full((width + 1, n), -1, np.int64)
        for end in range(1, width + 1):
            todo = np.flatnonzero(size >= end)
            # hashes of the slices that end here, from the longest to the shortest
            hashes, power = np.zeros(len(todo), np.uint64), np.uint64(1)
            slices = []
            for length in range(1, end + 1):
                hashes = hashes + columns[end - length, todo] * power
                power = np.uint64(int(power) * self.BASE & 0xFFFFFFFFFFFFFFFF)
                slices.append(hashes)
            for length in [x for x in reversed(self.sizes) if x <= end]:
                if not len(todo):
                    break
                tokens = self._tokens(slices[length - 1])
                have = np.flatnonzero(tokens >= 0)
                if not len(have):
                    continue
                rows, tokens = todo[have], tokens[have]
                fits = self.reached[tokens] if length == end else self._fit(last[end - length, rows], tokens)
                last[end, rows[fits]] = tokens[fits]
                if fits.any():
                    rest = np.ones(len(todo), bool)
                    rest[have[fits]] = False
                    todo = todo[rest]
                    slices = [h[rest] for h in slices[:length - 1]]
        ids, at, k = [], size.copy(), 0
        rows = np.arange(n)
        count = np.zeros(n, np.int64)
        while len(rows):
            tokens = last[at[rows], rows]
            step = np.zeros(n, np.uint32)
            step[rows] = tokens
            ids.append(step)
            count[rows] += 1
            at[rows] -= self.lengths[tokens]
            rows = rows[at[rows] > 0]
        table = np.ascontiguousarray(np.stack(ids[::-1], axis=1).astype("<u4"))
        raw, wide = table.tobytes(), table.shape[1] * 4
        out = [raw[(i + 1) * wide - 4 * c:(i + 1) * wide] for i, c in enumerate(count.tolist())]
        get = self.encoder.ranks.get
        return [ids if (t := get(p)) is None else t.to_bytes(4, "little") for p, ids in zip(pieces, out)]

    def decode(self, ids: bytes) -> bytes:
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(tokens):
            return b""
        lengths = self.lengths[tokens]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.starts[tokens] - (ends - lengths), lengths)
        return self.flat[at].tobytes()


class Tokenizer:
    """Text to ids and back, with a rank file and a pattern that splits text into pieces."""

    #: Code points of text that are split before their new pieces are encoded together.
    TOGETHER = 200_000

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoder = PrefixEncoder(ranks)
        self.batch = BatchEncoder(self.encoder)
        self.split = regex.compile(pattern).findall
        # Pieces with their ids: the older half of the table, and the half that grows.
        self.old: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.taken = 0

    def _learn(self, new: set[str]) -> None:
        """Puts pieces into the table. It may outgrow its bound by the new pieces of one round."""
        if self.taken > TABLE_BYTES // 2:
            self.old, self.pieces, self.taken = self.pieces, {}, 0
        short, long = [], []
        for piece in new:
            if (ids := self.old.get(piece)) is not None:
                self.pieces[piece] = ids
                continue
            data = piece.encode()
            (short if len(data) <= BatchEncoder.WIDEST else long).append((piece, data))
        for (piece, _), ids in zip(short, self.batch.encode([d for _, d in short])):
            self.pieces[piece] = ids
        for piece, data in long:
            self.pieces[piece] = array("I", self.encoder.encode(data)).tobytes()
        # A string, its bytes and their place in the table take about 200 bytes beside what they hold.
        self.taken += sum(200 + 2 * len(p) + len(self.pieces[p]) for p in new)

    def encode_all(self, texts) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers; none for null or empty."""
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= self.TOGETHER:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        split = [self.split(t) for t in texts]
        new = {p for pieces in split for p in pieces if p not in self.pieces}
        if new:
            if self.taken > TABLE_BYTES // 2:
                new = {p for pieces in split for p in pieces}
            self._learn(new)
        known = self.pieces
        for pieces in split:
            yield b"".join(map(known.__getitem__, pieces))

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes | None) -> bytes:
        return self.batch.decode(ids) if ids else b""


@lru_cache(maxsize=2)
def tokenizer(rank_file: str, pattern: str) -> Tokenizer:
    """One per worker process; the file must be at the same place on every worker, as the package is."""
    return Tokenizer(rank_file, pattern)


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def with_tokens(docs: DataFrame, rank_file: str, pattern: str, out: str, text_col: str = "text") -> DataFrame:
    """`docs` with a struct of n_tokens, ids and exact.

    ids are little-endian unsigned 32-bit integers in a binary value, none for a null or empty
    text; exact tells that they decode to the text's bytes. Rows are independent: no shuffle.
    """

    @F.pandas_udf(schema("n_tokens long, ids binary, exact boolean"))
    def encode(texts: pd.Series) -> pd.DataFrame:
        own, rows = tokenizer(rank_file, pattern), []
        for text, ids in zip(texts, own.encode_all(texts)):
            rows.append((len(ids) // 4, ids, own.decode(ids) == (text or "").encode()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids", "exact"])

    return docs.withColumn(out, encode(F.col(text_col)))


def with_decoded(encoded: DataFrame, rank_file: str, pattern: str, out: str, ids_col: str = "ids") -> DataFrame:
    """`encoded` with the bytes that its ids stand for; none for null or no ids."""

    @F.pandas_udf(T.BinaryType())
    def decode(ids: pd.Series) -> pd.Series:
        return pd.Series(list(map(tokenizer(rank_file, pattern).decode, ids)), dtype=object)

    return encoded.withColumn(out, decode(F.col(ids_col)))


def digest_tokens(
    docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): ids are decoded again where they are made."""

    @F.pandas_udf(schema("n_tokens long, ids_sha256 string, decoded_sha256 string"))
    def digest(texts: pd.Series) -> pd.DataFrame:
        own, rows = tokenizer(rank_file, pattern), []
        for ids in own.encode_all(texts):
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), digest(F.col(text_col)).alias("d")).select(id_col, "d.*")
