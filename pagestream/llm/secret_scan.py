"""Secret scan by assignment-aware lexing.

A text is read as source or configuration: pairs of a name and a literal are lexed
(`name = "x"`, `"name": "x"`, `NAME=x`, `name := x`, `name: type = "x"`, joined parts), a name
set to a constant carries it on to where the name is the value, and each literal is scored by
how sensitive its target names are and how much it looks like a key or a passphrase. A name
set inside an indented block is known until a line with less indentation. Fixed patterns for
assignments, access keys and long hex runs are found beside it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestream.llm.common import free_name, schema

#: Kinds of spans, in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "literal")

# The base patterns.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

_NAME = re.compile(
    r"""(?<![\w$.-])(["']?)([A-Za-z_$][\w$.-]*)\1\]?[ \t]*(:=|=>|=(?![=>])|:(?![:/]))[ \t]*"""
)
_VALUE = re.compile(r""""((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`|([^\s"'`,;(){}\[\]<>&|+]+)""")
_JOIN = re.compile(r"[ \t]*\+[ \t]*(?=[\"'`\w$])")
_TYPED = re.compile(r"[ \t]*=(?!=)[ \t]*")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_PLACEHOLDER = re.compile(
    r"(?i)^(?:x+|\*+|\.+|none|null|true|false|undefined|changeme|example.*|your.*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*|todo.*|test|dummy.*|placeholder.*)$"
)
#: How sensitive a part of a target name is.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "pass": 0.8, "secret": 1.0,
    "token": 1.0, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.7,
    "authorization": 0.8, "bearer": 0.9, "signature": 0.6, "salt": 0.5, "privatekey": 1.0,
}
#: Parts that make a following "key" sensitive.
_KEY_OF = {"api", "access", "private", "secret", "signing", "encryption", "master", "account", "client", "auth"}
#: From here on a name is sensitive enough for words with blanks between them; so many words, none of these, make a passphrase.
PHRASE_OF, PHRASE_WORDS = 0.9, 4
# Words of messages and descriptions.
_PLAIN_WORDS = frozenset(
    "a an and are as at be by can cannot do does enter for forgot from has have if in incorrect invalid is it its least missing must my no not "
    "of on or our please required reset should that the this to too use used was wrong you your will with".split()
)
_PHRASE = re.compile(r"[A-Za-z0-9'_-]+(?:[ \t]+[A-Za-z0-9'_-]+)+")
_INDENT = re.compile(r"^([ \t]*)\S", re.MULTILINE)
#: A literal counts from this product of sensitivity and strength on.
THRESHOLD = 0.5


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    value_start: int


def sensitivity(name: str) -> float:
    """0 to 1: the most sensitive part of a name written in any case style."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    score = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    if any(a in _KEY_OF and b in ("key", "keys") for a, b in zip(parts, parts[1:])):
        score = max(score, 1.0)
    return score


def strength(literal: str, quoted: bool) -> float:
    """0 to 1: length, mix and entropy of a literal; 0 for placeholders, short ones and those with blanks.

    A bare word needs both letters and digits, so "secret: happiness" in prose is none.
    """
    if len(literal) < 8 or _PLACEHOLDER.match(literal) or any(map(str.isspace, literal)):
        return 0.0
    kinds = sum(map(bool, (re.search("[a-z]", literal), re.search("[A-Z]", literal), re.search(r"\d", literal), re.search(r"[^\w]", literal))))
    if not quoted and not (re.search(r"\d", literal) and re.search(r"[A-Za-z]", literal)):
        return 0.0
    counts = Counter(literal)
    bits = -sum(n / len(literal) * math.log2(n / len(literal)) for n in counts.values())
    return min(1.0, bits / 3.5 + 0.1 * (kinds - 1))


def is_passphrase(literal: str, name: str) -> bool:
    """Several different words under the name of a password, none of them a word of messages."""
    if not _PHRASE.fullmatch(literal) or sensitivity(name) < PHRASE_OF:
        return False
    words = literal.lower().split()
    return len(set(words)) >= PHRASE_WORDS and len(literal) >= 16 and _PLAIN_WORDS.isdisjoint(words)


def base_spans(text: str) -> list[Span]:
    found = []
    if ":" in text or "=" in text:
        found = [
            Span("assign", m.start(), m.end(), m.start(2))
            for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8
        ]
    if "AKIA" in text:
        found += [Span("access", m.start(), m.end(), m.start()) for m in _ACCESS.finditer(text)]
    found += [Span("hex", m.start(), m.end(), m.start()) for m in _HEX.finditer(text)]
    return found


def literal_spans(text: str) -> list[Span]:
    """Literals that reach a sensitive name, directly or by way of other names."""
    if ":" not in text and "=" not in text:
        return []
    known: dict[str, tuple] = {}
    scopes: list[tuple[int, str, tuple | None]] = []  # names set in blocks: indentation, and what they were before
    found: set[Span] = set()
    at = line = depth = 0
    while m := _NAME.search(text, at):
        for begun in _INDENT.finditer(text, line, m.end()):
            indent = len(begun[1])
            while scopes and scopes[-1][0] > indent:
                _, old, before = scopes.pop()
                if before is None:
                    known.pop(old, None)
                else:
                    known[old] = before
            line = begun.end()
            depth = indent
        name, pieces, pos = m[2], [], m.end()
        while v := _VALUE.match(text, pos):
            quote = v.lastindex or 0
            pos = v.end()
            if quote == 4:
                bare = v[4]
                if m[3] == ":" and not pieces and (t := _TYPED.match(text, pos)) and _IDENTIFIER.fullmatch(bare):
                    pos = t.end()
                    continue
                if _IDENTIFIER.fullmatch(bare) and bare in known:
                    pieces += known[bare]
                elif text[pos:pos + 1] not in ("(", "["):
                    stripped = bare.rstrip(".:!?")
                    pieces.append((stripped, v.start(4), v.start(4) + len(stripped), False))
            else:
                pieces.append((v[quote], v.start(quote), v.end(quote), True))
            if not (j := _JOIN.match(text, pos)):
                break
            pos = j.end()
        if pieces:
            for each in {name, name.rpartition(".")[2]}:
                if depth:
                    scopes.append((depth, each, known.get(each)))
                known[each] = tuple(pieces)
            whole = "".join(p[0] for p in pieces)
            quoted = any(p[3] for p in pieces)
            if sensitivity(name) * strength(whole, quoted) >= THRESHOLD or quoted and is_passphrase(whole, name):
                found.update(Span("literal", s, e, s) for _, s, e, _ in pieces if e > s)
        at = max(pos, m.end())
    return sorted(found, key=lambda s: s.start)


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind)))


def find_secrets(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans); a literal that lies in a base span isn't listed again."""
    text = text or ""
    base = _ordered(base_spans(text))
    more, at, reach = [], 0, 0
    for s in literal_spans(text):  # both in order of their starts
        while at < len(base) and base[at].start <= s.start:
            reach, at = max(reach, base[at].end), at + 1
        if s.end > reach:
            more.append(s)
    return base, _ordered(base + more)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redact(text: str | None, mask: str = "[SECRET]") -> str | None:
    """The text with every secret's value replaced; names of assignments stay."""
    if text is None:
        return None
    out, at = [], 0
    for start, end in sorted((s.value_start, s.end) for s in find_secrets(text)[1]):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


_SCHEMA = schema("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long")


@F.pandas_udf(_SCHEMA)
def _scan(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        base, spans = find_secrets(text)
        kinds = Counter(s.kind for s in spans)
        rows.append((
            kinds["assign"], kinds["access"], kinds["hex"],
            hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), kinds["literal"],
        ))
    return pd.DataFrame(rows, columns=_SCHEMA.names)


@F.pandas_udf(T.StringType())
def _redact(texts: pd.Series) -> pd.Series:
    return pd.Series([redact(t) for t in texts], dtype=object)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, counts of base spans, their digest, and all spans.

    A null or empty text has none. Repeated rows each give a row; other columns are not read.
    One pass, no shuffle.
    """
    return docs.select(F.col(id_col), _scan(F.col(text_col)).alias("found")).select(id_col, "found.*")


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """`docs` with secrets masked in the text, and the length column, if there is one, set anew."""
    new = free_name(docs, "redacted")
    out = docs.withColumn(new, _redact(F.col(text_col)))
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col(new).alias(c))
        elif c == length_col:
            changed = ~F.col(new).eqNullSafe(F.col(text_col))
            columns.append(F.when(changed, F.length(new)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return out.select(*columns)
