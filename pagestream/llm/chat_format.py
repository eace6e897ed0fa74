"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system message, then user and assistant in turn, ending with
the assistant. Dynamic programming over this automaton finds, for each conversation, the
cheapest way there: neighbouring turns of one role merge, turns are relabelled, empty messages
are put in. The repaired sequence is then rendered.

A step of the programme is a matrix of costs from state to state, and such matrices combine
(minimum and plus), so a conversation of any length may lie across many partitions: each
partition sums up its part, the parts of a conversation are chained, and each partition then
traces its own part. Only the first and last conversation of a partition can be cut.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestream.llm.common import cut_lineage, schema

ROLES = ("", "system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
UNKNOWN = 0
#: Other names of the roles; any other role has none.
NAMES = {
    "system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER,
    "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT,
}
#: Costs; the odd units settle which of two equally dear repairs is taken.
MERGE, INSERT, RELABEL, NAME_UNKNOWN = 101, 202, 303, 104
NEVER = 1 << 40

#: From a state to the role of the next message: what it costs beside relabelling.
_MOVE = {
    (START, SYSTEM): 0, (START, USER): 0, (START, ASSISTANT): INSERT,
    (SYSTEM, SYSTEM): MERGE, (SYSTEM, USER): 0, (SYSTEM, ASSISTANT): INSERT,
    (USER, USER): MERGE, (USER, ASSISTANT): 0,
    (ASSISTANT, USER): 0, (ASSISTANT, ASSISTANT): MERGE,
}
#: From the last state: what a legal end costs. START is a conversation without turns.
_END = (0, 2 * INSERT, INSERT, 0)


def _relabel(given: int, role: int) -> int:
    if given == role:
        return 0
    # Naming a turn that has no known role is cheap; user before assistant before system.
    extra = {USER: 0, ASSISTANT: 2, SYSTEM: 4}[role]
    return (RELABEL if given else NAME_UNKNOWN) + extra


_STEPS = [
    [(s, x, _relabel(given, x) + cost) for (s, x), cost in sorted(_MOVE.items())] for given in range(4)
]


def role_code(role: str | None) -> int:
    return NAMES.get((role or "").strip().lower(), UNKNOWN)


def _forward(codes: list[int], costs: tuple[int, ...]) -> tuple[list[tuple[int, ...]], tuple[int, ...]]:
    """For each turn the state before it by the state after it, and the costs of the states at the end."""
    back = []
    for given in codes:
        best, before = [NEVER] * 4, [START] * 4
        for s, x, cost in _STEPS[given]:
            total = costs[s] + cost
            if total < best[x]:
                best[x], before[x] = total, s
        back.append(tuple(before))
        costs = tuple(min(b, NEVER) for b in best)
    return back, costs


def _trace(back: list[tuple[int, ...]], state: int) -> list[int]:
    """The state before the first turn and after each, ending in `state`."""
    states = [state]
    for before in reversed(back):
        states.append(before[states[-1]])
    return states[::-1]


def repair(roles: list[str | None]) -> tuple[list[int], int]:
    """(states, cost) of a whole conversation: the role that each turn gets."""
    back, costs = _forward([role_code(r) for r in roles], (0, NEVER, NEVER, NEVER))
    last = min(range(4), key=lambda s: (costs[s] + _END[s], s))
    return _trace(back, last)[1:], costs[last] + _END[last]


class Part(NamedTuple):
    """What a partition has to know of a conversation that lies across several."""

    costs: tuple[int, ...]
    last: int
    before: int  # turns in parts before
    follows: int  # role of the first turn of the next part, or -1 at the end


def _segments(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[int, str | None, list[list]]]:
    """(partition, conversation, values by column) of consecutive rows of one conversation."""
    part, key, held, first = -1, None, [[] for _ in columns], True
    for batch in batches:
        keys = batch["key"].tolist()
        values = [batch[c].tolist() for c in columns]
        at = 0
        if keys:
            part = int(batch["part"].iloc[0])
        while at < len(keys):
            now = keys[at]
            stop = at
            while stop < len(keys) and keys[stop] == now:
                stop += 1
            if not first and now != key:
                yield part, key, held
                held = [[] for _ in columns]
            for column, some in zip(held, values):
                column.extend(some[at:stop])
            key, first, at = now, False, stop
    if not first:
        yield part, key, held


def _cut_candidates(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    """The first and the last segment of a partition."""
    last = None
    for k, segment in enumerate(_segments(batches, columns)):
        if k == 0:
            yield segment
        else:
            last = segment
    if last is not None:
        yield last


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part, key, (roles,) in _cut_candidates(batches, ["role_in"]):
        codes = [role_code(r) for r in roles]
        rows = [_forward(codes, tuple(0 if s == t else NEVER for t in range(4)))[1] for s in range(4)]
        yield pd.DataFrame({"part": [part], "key": [key], "n": [len(codes)], "costs": [",".join(str(c) for r in rows for c in r)]})


def _chain(ordered: DataFrame) -> dict[tuple[int, str], Part]:
    """Of conversations cut by partition borders: the costs before each part, and the state it ends in.

    The driver gets at most two rows for each partition, twice.
    """
    slim = ordered.select("part", "key", "role_in")
    parts = defaultdict(list)
    for r in slim.mapInPandas(_sums, schema("part long, key string, n long, costs string")).collect():
        parts[r["key"]].append((r["part"], r["n"], [list(map(int, r["costs"].split(",")))[4 * s:4 * s + 4] for s in range(4)]))
    entries, cut = {}, {k: sorted(v) for k, v in parts.items() if len(v) > 1}
    if not cut:
        return {}
    for key, pieces in cut.items():
        costs, before = (0, NEVER, NEVER, NEVER), 0
        for part, n, matrix in pieces:
            entries[part, key] = (costs, before)
            costs = tuple(min(min(costs[s] + matrix[s][t] for s in range(4)), NEVER) for t in range(4))
            before += n
        entries[None, key] = (costs, before)
    sent = ordered.sparkSession.sparkContext.broadcast(entries)

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, key, (roles,) in _cut_candidates(batches, ["role_in"]):
            if (part, key) in sent.value:
                back, _ = _forward([role_code(r) for r in roles], sent.value[part, key][0])
                traces = [_trace(back, t) for t in range(4)]
                told = ",".join(f"{t[0]}:{t[1]}" for t in traces)
                yield pd.DataFrame({"part": [part], "key": [key], "n": [0], "costs": [told]})

    traced = {}
    for r in slim.mapInPandas(ends, schema("part long, key string, n long, costs string")).collect():
        traced[r["part"], r["key"]] = [tuple(map(int, x.split(":"))) for x in r["costs"].split(",")]
    out = {}
    for key, pieces in cut.items():
        costs = entries[None, key][0]
        last, follows = min(range(4), key=lambda s: (costs[s] + _END[s], s)), -1
        for part, _, _ in reversed(pieces):
            costs, before = entries[part, key]
            out[part, key] = Part(costs, last, before, follows)
            last, follows = traced[part, key][last]
    return out


def _opening(role: int) -> str:
    return f"<|im_start|>{ROLES[role]}\n"


_CLOSING = "<|im_end|>\n"
_RESULT = "key string, pos long, turn string, role_in string, role string, action string, rendered string"


def _safe(text: str | None) -> str:
    """A text can't open or close a message."""
    return (text or "").replace("<|", "< |")


def pieces(key, turns, roles, texts, part: Part | None = None) -> Iterator[tuple]:
    """Rows (key, pos, turn, role_in, role, action, rendered); in order of pos their text is the conversation."""
    codes = [role_code(r) for r in roles]
    back, costs = _forward(codes, part.costs if part else (0, NEVER, NEVER, NEVER))
    last = part.last if part else min(range(4), key=lambda s: (costs[s] + _END[s], s))
    states = _trace(back, last)
    begin, follows = (part.before, part.follows) if part else (0, -1)
    for i, (turn, role, text, code) in enumerate(zip(turns, roles, texts, codes)):
        before, state = states[i], states[i + 1]
        after = states[i + 2] if i + 2 < len(states) else follows
        pos = (begin + i) * 4
        if _MOVE[before, state] == INSERT:
            yield key, pos, None, None, ROLES[USER], "insert", _opening(USER) + _CLOSING
        merge = before == state
        action = "merge" if merge else "keep"
        if code != state:
            action = "relabel" if not merge else "relabel,merge"
        rendered = ("\n\n" if merge else _opening(state)) + _safe(text) + ("" if after == state else _CLOSING)
        yield key, pos + 1, turn, role, ROLES[state], action, rendered
    if follows < 0 and turns:
        for k, role in enumerate({SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,)}.get(states[-1], ())):
            yield key, (begin + len(turns) - 1) * 4 + 2 + k, None, None, ROLES[role], "insert", _opening(role) + _CLOSING


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv, pos, turn, role_in, role, action, rendered): a row for each turn and each message put in.

    Turns of a conversation are taken by number, those without one last, equal ones by role and
    text; repeated rows are turns of their own. Null roles are unknown, null texts empty. Turns
    with a null conversation are one conversation. Other columns are not read.
    """
    kinds = {c: turns.schema[c].dataType for c in (conv_col, turn_col)}
    rows = turns.select(
        F.col(conv_col).cast("string").alias("raw"), F.col(turn_col).alias("at"),
        F.col(role_col).alias("role_in"), F.col(text_col).alias("text"),
    ).withColumn("key", F.coalesce(F.concat(F.lit("="), "raw"), F.lit("-"))).drop("raw")
    order = [
        F.col("key"), F.col("at").asc_nulls_last(), F.col("role_in"), F.col("text"),
        F.rand(1),  # only equal rows differ by it, so it deals them out and changes nothing
    ]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut_lineage(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .select(F.spark_partition_id().cast("long").alias("part"), "key", F.col("at").cast("string").alias("turn"), "role_in", "text")
    )
    sent = ordered.sparkSession.sparkContext.broadcast(_chain(ordered))

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for part, key, (at, roles, texts) in _segments(batches, ["turn", "role_in", "text"]):
            for row in pieces(key, at, roles, texts, sent.value.get((part, key))):
                held.append(row)
                if len(held) >= 5_000:
                    yield pd.DataFrame(held, columns=schema(_RESULT).names)
                    held = []
        yield pd.DataFrame(held, columns=schema(_RESULT).names)

    out = ordered.mapInPandas(render, schema(_RESULT))
    return out.select(
        F.when(F.col("key") != "-", F.substring("key", 2, 1 << 30)).cast(kinds[conv_col]).alias(conv_col), "pos",
        F.col("turn").cast(kinds[turn_col]).alias(turn_col), "role_in", "role", "action", "rendered",
    )
