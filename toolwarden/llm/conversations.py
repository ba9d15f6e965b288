"""Conversation structure repair: the cheapest edits that make turns alternate.

A repaired conversation reads, by the initials of its roles, ``(s?(ua)+)?``.
Keep costs 0, giving a row the role user or assistant 2, deleting it 3, putting
an empty user or assistant row anywhere 2, and a truncated row that stays 1
more; blank rows and repetitions must go.  Of equally cheap repairs the one
whose audit (the initials of its edits) is least in ASCII order is taken.

The search is depth-first branch and bound over a window of rows: an explicit
stack, lower bounds of what the rest of the window costs from each state of
the pattern, incumbents (cost, audit) for each state at its end, and a table of
the best prefix per row and state, which cuts every prefix that is worse.  What
is best for each state at the end of a window begins the next one, so the
result is that of one search over the whole conversation: prefixes that end
with the same row have the same number of row edits, hence of equal cost none
begins another, and the order of two prefixes is that of whatever follows.
An end state that costs more than another's with the insertions that lead from
one to the other is never needed, which bounds the search before all end
states are reached.

Rows move once, by conversation.  Spark sorts them (spilling where it must) and
a task reads them as a stream: it holds one window, four digests and the
edits so far, two bits of information per row.  A conversation's digest and
audit are sequential values of one row by their definition, so one
conversation is read by one task, but never collected.

Defined results: rows are ordered by turn (NULL first), then role and text, so
ties and repeated rows have one order; a NULL role or text is one space; the
initial of an empty role is empty and fits nowhere; a NULL ``conv_id`` is a
conversation of its own; a conversation with nothing but dropped rows has
zeros, an empty audit and the digest of the empty string; an empty table gives
no rows; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows searched at a time.
WINDOW = 64
KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 2, 2, 3, 1
#: States of the pattern: nothing yet, behind a system row, a user row, an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state behind an inserted row or one with a new role: the turn that is due.
DUE = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state behind a row that keeps its role.
KEPT = {
    ("s", NOTHING): SYSTEM, ("u", NOTHING): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER,
    ("a", USER): ASSISTANT,
}
#: What it costs to complete a conversation in each state, by insertions.
TAIL = (0, 2 * INSERT, INSERT, 0)
#: Insertions that lead from one state to another (no way leads back to nothing or system).
SWITCH = {(a, b): 0 for a in STATES for b in STATES if a == b} | {
    (NOTHING, USER): INSERT, (NOTHING, ASSISTANT): 2 * INSERT, (SYSTEM, USER): INSERT,
    (SYSTEM, ASSISTANT): 2 * INSERT, (USER, ASSISTANT): INSERT, (ASSISTANT, USER): INSERT,
}
BLANK, DUPLICATE, CUT, FINE = "blank", "duplicate", "truncated", ""

RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of ``conv_id, turn, role, text`` with faults by ``crc32(conv_id:turn) % 20``: 0 drops a
    row (``copy`` is 0: it only says that its conversation exists), 1 empties its text, 2 takes
    sentence ends out, 3 repeats it, 4 makes it the user's."""
    blank = F.lit(" ")
    name = F.concat_ws(
        ":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank)
    )
    kind = F.crc32(name.cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), blank)
    copies = F.when(kind == 0, F.array(F.lit(0))).when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), blank)).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(copies).alias("copy"),
    )


def whole(rows: DataFrame) -> DataFrame:
    """Rows as they are, in the form that :func:`repair` takes."""
    blank = F.lit(" ")
    return rows.select(
        "conv_id", "turn",
        *[F.coalesce(F.col(c).cast("string"), blank).alias(c) for c in ("role", "text")],
        F.lit(1).alias("copy"),
    )


def fault(text: Column, earlier: Column) -> Column:
    """The first fault of a row; ``earlier`` says that its role and text came before."""
    body = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return (
        F.when(body == "", BLANK)
        .when(earlier, DUPLICATE)
        .when(~F.substring(body, -1, 1).isin(".", "!", "?"), CUT)
        .otherwise(FINE)
    )


def ordered(rows: DataFrame) -> DataFrame:
    """The rows with ``fault``, one conversation after the other, each in order, moved once.

    Both windows below work on the partitioning by conversation."""
    moved = rows.repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", "text", F.col("copy") > 0).orderBy(F.col("turn").asc_nulls_first(), "copy")
    seen = moved.withColumn("fault", fault(F.col("text"), F.row_number().over(same) > 1))
    return seen.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy")


def bounds(rows: list[tuple[str, str]], last: bool) -> list[list[int]]:
    """From each row and state, what the rest of the window costs at least."""
    after = list(TAIL) if last else [0, 0, 0, 0]
    out = [after]
    for initial, kind in reversed(rows):
        here = []
        for state in STATES:
            best = DELETE + after[state]
            if kind not in (BLANK, DUPLICATE):
                extra = TRUNCATED if kind == CUT else 0
                best = min(best, REROLE + extra + after[DUE[state]])
                kept = KEPT.get((initial, state))
                if kept is not None:
                    best = min(best, KEEP + extra + after[kept])
            here.append(best)
        for state in (USER, ASSISTANT, USER, SYSTEM, NOTHING):
            here[state] = min(here[state], INSERT + here[DUE[state]])
        out.append(here)
        after = here
    return out[::-1]


def search(
    rows: list[tuple[str, str]], entries: dict[int, tuple[int, int]], last: bool
) -> dict[int, tuple[int, int, str]]:
    """The best ``cost, rank, audit`` for each state at the end of a window of ``initial, fault``.

    ``entries`` has cost and rank of the prefix that leads to each state at its
    beginning; ranks order these prefixes by audit."""
    n, rest = len(rows), bounds(rows, last)
    best: dict[int, tuple[int, int, str]] = {}
    limit = [float("inf")] * 4
    table: dict[tuple[int, int], tuple[int, int, str]] = {}
    ends = (NOTHING, ASSISTANT) if last else tuple(STATES)
    stack = [
        (cost, rank, "", 0, state)
        for state, (cost, rank) in sorted(entries.items(), key=lambda e: (e[1][0] + rest[0][e[0]], e[1][1]), reverse=True)
    ]
    while stack:
        cost, rank, audit, i, state = stack.pop()
        least = cost + rest[i][state]
        if all(least > limit[x] or (x in best and least == best[x][0] and (rank, audit) > best[x][1:] and not best[x][2].startswith(audit)) for x in ends):
            continue
        key = (cost, rank, audit)
        known = table.get((i, state))
        if known is not None and known <= key:
            continue
        table[i, state] = key
        if i == n and state in ends and (state not in best or key < best[state]):
            best[state] = key
            limit[state] = min(limit[state], cost)
            if not last:
                for (a, b), more in SWITCH.items():
                    if a == state:
                        limit[b] = min(limit[b], cost + more)
        steps = []
        if i < n or last:
            steps.append((cost + INSERT, audit + "I", i, DUE[state]))
        if i < n:
            initial, kind = rows[i]
            steps.append((cost + DELETE, audit + "D", i + 1, state))
            if kind not in (BLANK, DUPLICATE):
                extra = cost + (TRUNCATED if kind == CUT else 0)
                steps.append((extra + REROLE, audit + "R", i + 1, DUE[state]))
                kept = KEPT.get((initial, state))
                if kept is not None:
                    steps.append((extra + KEEP, audit + "K", i + 1, kept))
        steps.sort(key=lambda s: (s[0] + rest[s[2]][s[3]], s[1]), reverse=True)
        stack.extend((c, rank, a, j, s) for c, a, j, s in steps)
    return best


@dataclass
class Prefix:
    """The best edits that lead to a state: cost, their audit as a chain, and the digest so far."""

    cost: int
    audit: tuple | None
    digest: object
    rows: int

    def then(self, window: list[tuple[str, str, str]], state: int, audit: str, cost: int) -> Prefix:
        """This prefix and the edits of a window of ``role, text, fault``, beginning in ``state``."""
        digest, out, rows = self.digest.copy(), self.rows, iter(window)
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(rows)[:2]
            if edit == "D":
                continue
            state = KEPT[role[:1], state] if edit == "K" else DUE[state]
            if edit != "K":
                role = ROLES[state]
            digest.update(f"{chr(10) if out else ''}{role}:{text}".encode())
            out += 1
        return Prefix(cost, (self.audit, audit), digest, out)


class Conversation:
    """One conversation as its rows come."""

    def __init__(self, key) -> None:
        self.key = key
        self.best = {NOTHING: (Prefix(0, None, hashlib.sha256(), 0), 0)}
        self.window: list[tuple[str, str, str]] = []
        self.counts = {BLANK: 0, DUPLICATE: 0, CUT: 0, FINE: 0}
        self.illegal = 0
        self.initial: str | None = None
        self.first = self.turn = None
        self.turns = 0

    def add(self, turn, role: str, text: str, kind: str) -> None:
        if len(self.window) == WINDOW:
            self.close(False)
        self.window.append((role, text, kind))
        self.counts[kind] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None:
            if self.turns == 0:
                self.first = turn
            if self.turns == 0 or turn != self.turn:
                self.turns += 1
            self.turn = turn

    def close(self, last: bool) -> None:
        """Search the window; its best prefixes begin the next one."""
        rows = [(role[:1], kind) for role, _, kind in self.window]
        entries = {s: (p.cost, rank) for s, (p, rank) in self.best.items()}
        state_of = {rank: s for s, (_, rank) in self.best.items()}
        found = search(rows, entries, last)
        order = sorted(found, key=lambda s: found[s][1:])
        self.best = {
            s: (self.best[state_of[found[s][1]]][0].then(self.window, state_of[found[s][1]], found[s][2], found[s][0]), rank)
            for rank, s in enumerate(order)
        }
        self.window = []

    def result(self) -> list:
        self.close(True)
        prefix = min((p.cost, rank, p) for p, rank in self.best.values())[2]
        parts, at = [], prefix.audit
        while at is not None:
            at, part = at
            parts.append(part)
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        c = self.counts
        return [
            gaps, c[BLANK], c[DUPLICATE], c[CUT], self.illegal, prefix.cost,
            "".join(reversed(parts)), prefix.digest.hexdigest(),
        ]


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: its faults, and the cheapest edits as cost, audit and digest.

    ``rows`` is what :func:`damaged` or :func:`whole` gives."""
    schema = T.StructType([rows.schema["conv_id"], *RESULT.fields])
    types = [to_arrow_type(f.dataType) for f in schema.fields]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        done: list[list] = []

        def packed() -> pa.RecordBatch:
            arrays = [pa.array(c, t) for c, t in zip(zip(*done), types, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for key, turn, role, text, copy, kind in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or now.key != key:
                    if now is not None:
                        done.append([now.key, *now.result()])
                    now = Conversation(key)
                if copy:
                    now.add(turn, role, text, kind)
            if len(done) >= 1000:
                yield packed()
        if now is not None:
            done.append([now.key, *now.result()])
        if done:
            yield packed()

    return ordered(rows).select("conv_id", "turn", "role", "text", "copy", "fault").mapInArrow(run, schema)


def edits(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """The edits themselves, one row each: ``conv_id, step, edit, role, text`` (the row as it was;
    NULL for an insertion), in the order of ``step``."""
    turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "copy")
    numbered = rows.where("copy > 0").withColumn("row", F.row_number().over(turn))
    steps = (
        repaired.where("audit <> ''")
        .select(F.col("conv_id").alias("_conv"), "audit", F.posexplode(F.split("audit", "")).alias("step", "edit"))
        .where("edit <> ''")
        .withColumn("_row", F.when(F.col("edit") != "I", F.length(F.replace(F.substring("audit", F.lit(1), F.col("step") + 1), F.lit("I"), F.lit("")))))
    )
    return steps.join(
        numbered, F.col("_conv").eqNullSafe(F.col("conv_id")) & (F.col("_row") == F.col("row")), "left"
    ).select(F.col("_conv").alias("conv_id"), "step", "edit", "role", "text")
