"""Hierarchical packing of token sequences into windows of several lengths.

A document longer than ``WIDTH`` gives full windows; its rest, and every shorter
document, is routed to the smallest tier that holds it.  Each tier opens windows
of its own size, longest pieces first, after the gaps of longer windows have
been filled with the largest pieces that fit.  What remains open is closed with
the pieces of a few dissolved short windows, cut to measure, so that all windows
but one are exactly full and at a power of two.  Sequences are dealt to step
groups in turn, so every group gets the same mix of tiers and patterns.

The plan is made from the histogram of piece lengths, at most ``WIDTH - 1``
counts whatever the size of the corpus; it says for ranges of ranks of a length
where those pieces go.  Ranks come from counts per written file part, so a
length that a third of all documents has is ranked by all tasks together.  The
documents are tokenized once, into the shared folder.

Defined results: a NULL or empty text is the end token alone; repeated rows are
packed as often as they occur; a NULL ``doc_id`` is packed under NULL; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import stored

WIDTH = 4096
TIERS = (512, 1024, 2048, 4096)
END_ID = 2
#: Sequences of one training step.
STEP = 256
#: Code points tokenized at a time.
AT_ONCE = 1 << 20


@dataclass
class Plan:
    """Where the pieces of each length go.

    ``places[t]``: (first rank, count, first sequence, offset, window) of whole
    pieces, by first rank; ``streams[t]``: (first rank, stream position) of the
    pieces that are cut; ``gaps``: (stream position, count, size, first sequence,
    offset, window) of the gaps they fill."""

    places: dict[int, list[tuple[int, int, int, int, int]]] = field(default_factory=lambda: defaultdict(list))
    streams: dict[int, tuple[int, int]] = field(default_factory=dict)
    gaps: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0


def tier(length: int) -> int:
    return next(w for w in TIERS if length <= w)


def plan(histogram: dict[int, int], first: int) -> Plan:
    """Pack pieces (length: count) into windows, numbered from ``first`` on."""
    #: open windows by gap: [count, window, pieces]
    by_gap: dict[int, list[list]] = defaultdict(list)
    open_gaps: list[int] = []

    def put(gap: int, count: int, window: int, pieces: tuple[int, ...]) -> None:
        if gap not in by_gap:
            insort(open_gaps, gap)
        by_gap[gap].append([count, window, pieces])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(open_gaps, max(length, 1))
            if at == len(open_gaps):
                put(tier(length) - length, left, tier(length), (length,))
                break
            gap = open_gaps[at]
            group = by_gap[gap][-1]
            used = min(left, group[0])
            group[0] -= used
            if not group[0]:
                by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap]
                    open_gaps.pop(at)
            put(gap - length, used, group[1], (*group[2], length))
            left -= used
    groups = [(window, gap, count, pieces) for gap, found in by_gap.items() for count, window, pieces in found]
    # Dissolve short, poorly filled windows until their pieces fill all other gaps.
    groups.sort(key=lambda g: (g[0], -g[1], g[3]))
    to_fill = sum(g[1] * g[2] for g in groups)
    stream, cut, whole = 0, defaultdict(int), []
    for window, gap, count, pieces in groups:
        content = window - gap
        need = min(count, max(0, -(-(to_fill - stream) // window)))
        stream += need * content
        to_fill -= need * gap
        for p in pieces:
            cut[p] += need
        if count > need:
            whole.append((window, gap, count - need, pieces))
    out = Plan(sequences=first)
    taken: dict[int, int] = defaultdict(int)
    position = 0
    for window, gap, count, pieces in whole:
        offset = 0
        for p in pieces:
            out.places[p].append((taken[p], count, out.sequences, offset, window))
            taken[p] += count
            offset += p
        if gap:
            out.gaps.append((position, count, gap, out.sequences, offset, window))
            position += gap * count
        out.sequences += count
    if stream > position:  # less than a window: the only one that is padded
        out.gaps.append((position, 1, WIDTH, out.sequences, 0, WIDTH))
        out.sequences += 1
    position = 0
    for length in sorted(cut, reverse=True):
        if cut[length]:
            out.streams[length] = (taken[length], position)
            position += cut[length] * length
    return out


TOKENS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("part", T.LongType()),
    T.StructField("n", T.LongType()), T.StructField("full", T.LongType()),
    T.StructField("full_before", T.LongType()), T.StructField("tail", T.IntegerType()),
    T.StructField("tail_rank", T.LongType()), T.StructField("ids", T.BinaryType()),
])


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """Each document's ids with the end id (16-bit numbers), its full windows and rest,
    and how many of these came before it in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = tokens.word_encoder(path), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        before = 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= AT_ONCE):
                    size += len(texts[to])
                    to += 1
                found = encoder.encode(texts[at:to])
                n = np.array([len(f) for f in found], np.int64) + 1
                full, tail = np.divmod(n, WIDTH)
                ranks = []
                for t in tail.tolist():
                    ranks.append(seen[t])
                    seen[t] += 1
                earlier = before + np.cumsum(full) - full
                before += int(full.sum())
                end = np.array([END_ID], "<u2").tobytes()
                raw = [f.astype("<u2").tobytes() + end for f in found]
                values = [ids[at:to], [part] * len(n), n, full, earlier, tail.astype(np.int32), ranks, raw]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, ARROW, strict=True)], schema=ARROW)
                at = to

    ARROW = pa.schema([
        ("doc_id", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("full", pa.int64()),
        ("full_before", pa.int64()), ("tail", pa.int32()), ("tail_rank", pa.int64()), ("ids", pa.binary()),
    ])
    return stored(docs.select("doc_id", "text").mapInArrow(run, TOKENS), "token-ids")


def _cut(plan: Plan, length: int, rank: int) -> list[tuple[int, int, int, int, int]]:
    """(start in the piece, length, sequence, offset, window) of the parts of one piece."""
    first, position = plan.streams.get(length, (rank + 1, 0))
    if rank < first:
        places = plan.places[length]
        at = bisect_left(places, (rank + 1,)) - 1
        lowest, _, sequence, offset, window = places[at]
        return [(0, length, sequence + rank - lowest, offset, window)]
    at = position + (rank - first) * length
    end, out, start = at + length, [], 0
    i = bisect_left(plan.gaps, (at + 1,)) - 1
    while at < end:
        base, count, size, sequence, offset, window = plan.gaps[i]
        k, inside = divmod(at - base, size)
        if k >= count:
            i += 1
            continue
        taken = min(size - inside, end - at)
        out.append((start, taken, sequence + k, offset + inside, window))
        start += taken
        at += taken
    return out


PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()), T.StructField("window", T.IntegerType()),
    T.StructField("step_group", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
])


def pack(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """One row per piece of a document: where it starts, its length and the CRC-32 of its ids
    (as 32-bit numbers), its sequence and offset there, the window and the step group, and the ids."""
    held = tokenized(docs, path)
    parts = held.groupBy("part").agg(F.sum("full").alias("full"))
    in_order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    fulls = parts.select("part", F.coalesce(F.sum("full").over(in_order), F.lit(0)).alias("full_base"))
    sizes = held.groupBy("part", "tail").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = sizes.select("part", "tail", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("rank_base"))
    bases = ranks.join(fulls, "part")
    totals = parts.agg(F.sum("full").alias("full")).first()
    histogram = {r["tail"]: r["c"] for r in sizes.where("tail > 0").groupBy("tail").agg(F.sum("c").alias("c")).collect()}
    first = totals["full"] or 0
    made = plan(histogram, first)
    steps = max(1, -(-made.sequences // STEP))
    names = PIECES.names if with_ids else PIECES.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n != "ids"}
            raw = batch.column(batch.schema.names.index("ids"))
            rows: dict[str, list] = {n: [] for n in names}
            size = 0
            for i in range(batch.num_rows):
                ids = np.frombuffer(raw[i].as_buffer(), "<u2").astype("<u4")
                n, full = columns["n"][i], columns["full"][i]
                base = columns["full_base"][i] + columns["full_before"][i]
                pieces = [(k * WIDTH, WIDTH, base + k, 0, WIDTH) for k in range(full)]
                tail = columns["tail"][i]
                if tail:
                    rank = columns["rank_base"][i] + columns["tail_rank"][i]
                    pieces += [(full * WIDTH + s, *rest) for s, *rest in _cut(made, tail, rank)]
                for start, length, sequence, offset, window in pieces:
                    own = ids[start : start + length]
                    values = (
                        columns["doc_id"][i], start, length, zlib.crc32(own), n,
                        sequence, offset, window, sequence % steps, own,
                    )
                    for name, v in zip(names, values, strict=False):
                        rows[name].append(v)
                    size += length
                if size > AT_ONCE:
                    yield _batch(rows, names)
                    rows, size = {n: [] for n in names}, 0
            yield _batch(rows, names)

    joined = held.join(bases, ["part", "tail"])
    return joined.mapInArrow(run, T.StructType([PIECES[n] for n in names]))


def _batch(rows: dict[str, list], names: list[str]) -> pa.RecordBatch:
    def column(name: str) -> pa.Array:
        if name != "ids":
            return pa.array(rows[name], pa.int32() if name == "window" else pa.int64())
        ends = np.cumsum([0, *map(len, rows[name])]).astype(np.int32)
        flat = np.concatenate(rows[name]) if rows[name] else np.zeros(0, np.uint32)
        return pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int32)))

    return pa.RecordBatch.from_arrays([column(n) for n in names], names=list(names))
