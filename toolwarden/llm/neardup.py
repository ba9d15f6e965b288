"""MinHash near-duplicates by a signature-coordinate inverted join.

A document is the set of its 5-word shingles.  Its signature has ``COORDINATES``
coordinates; coordinate *k* of two documents is equal with the probability of
their Jaccard similarity.  Documents are posted under each (coordinate, value),
and documents that agree in at least ``MATCHES`` coordinates are compared on
their full sets.  At a similarity of exactly 0.75 fewer than ``MATCHES`` of
``COORDINATES`` agree with a probability below 2e-6, above it less often.

* Equal sets become one class first, so copies cost nothing further.
* *Skip*: a posting that nobody shares cannot be matched.  A document with fewer
  than ``MATCHES`` shared postings has no partner and is skipped with all of
  them; that makes other postings unshared, so the rule is applied twice.
* *Prefix*: of *m* shared postings, two documents with ``MATCHES`` in common
  share one of the *m - MATCHES + 1* rarest, so only these are joined.
* *Merging*: each posting list first links its members to its smallest member.
  Members that are in one component by then need no comparison.  What still
  crosses components is compared within the limits that lengths set: pairs of
  short lists by a join, long lists in blocks: the members outside the largest
  component of a list against all of it, each pair under its first common posting,
  and only links that connect something leave a block.  So a group of near copies
  costs its size, with some strays beside it, too, and no link between components
  is lost.  A block is bounded by its members and by their shingles.  What costs
  more than its size is a long list of documents that are nearly, but not linked:
  its blocks are compared with each other, in as many tasks.

Links are confirmed on the full sets (as 64-bit shingle hashes).  Only
documents that may have a partner are read a second time.

Defined results: a text without words (or NULL) has an empty set and stands
alone; with one to four words the whole sequence is its only shingle; repeated
rows are equal sets and share a component; a row whose ``doc_id`` is NULL is
linked with nothing, has no component and is kept; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, free_name, spanning, stored

SHINGLE = 5
#: Two sets are linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
COORDINATES = 96
MATCHES = 51
#: Posting lists of more members choose their first partner at random, and are compared in blocks.
LONG = 16
#: Members of a block, and shingles of all of them, on average.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Words hashed at a time, and words remembered.
WORDS_AT_ONCE = 1 << 17
CACHE = 200_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = _mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * _STEP)
    return base[:n], base[n:] | np.uint64(1)


class Shingler:
    """Shingle sets of texts as sorted 64-bit hashes; remembers the hashes of words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def hashes(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        found = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            found.append(h)
        h = np.array(found, np.uint64)
        size = min(SHINGLE, len(h))
        out = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            out = _mixed(out * _STEP + h[i : len(h) - size + 1 + i])
        return np.unique(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``COORDINATES`` 32-bit values per non-empty set."""
    xor, times = _seeds(COORDINATES)
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((COORDINATES, len(sets)), np.uint32)
    for k in range(COORDINATES):
        out[k] = np.minimum.reduceat((flat ^ xor[k]) * times[k], starts) >> np.uint64(32)
    return np.ascontiguousarray(out.T)


def _fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)


SIGNED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("rid", T.LongType()),
    T.StructField("n_shingles", T.LongType()), T.StructField("f1", T.LongType()),
    T.StructField("f2", T.LongType()), T.StructField("signature", T.ArrayType(T.IntegerType())),
])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler, row = Shingler(), TaskContext.get().partitionId() << 33

    def made(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        nonlocal row
        full = [s for s in sets if len(s)]
        values = iter(signatures(full).view(np.int32)) if full else iter(())
        prints = [_fingerprint(s) if len(s) else (None, None) for s in sets]
        rids = list(range(row, row + len(sets)))
        row += len(sets)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array(rids, pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()),
                pa.array([next(values) if len(s) else None for s in sets], pa.list_(pa.int32())),
            ],
            names=SIGNED.names,
        )

    for batch in batches:
        ids, sets, size = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc_id)
            sets.append(shingler.hashes(text))
            size += len(sets[-1])
            if size >= WORDS_AT_ONCE:
                yield made(ids, sets)
                ids, sets, size = [], [], 0
        if ids:
            yield made(ids, sets)


def _shared(tokens: DataFrame) -> DataFrame:
    """``rid, token, df``: the postings of documents that have at least MATCHES shared ones."""
    df = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    live = tokens.join(df, "token")
    enough = live.groupBy("rid").agg(F.count("*").alias("m")).where(F.col("m") >= MATCHES)
    return live.join(enough, "rid")


def postings(classes: DataFrame) -> DataFrame:
    """``rid, token, df, rank, m``: shared postings, rarest first, of documents that may have a partner."""
    coordinates = classes.select("rid", F.posexplode("signature").alias("k", "v"))
    tokens = coordinates.select("rid", (F.shiftleft(F.col("k").cast("long"), 32) + F.col("v") + (1 << 31)).alias("token"))
    first = stored(_shared(tokens).select("rid", "token"), "shared")
    return stored(_shared(first).select("rid", "token", "df", "m"), "postings")


def _prefix(live: DataFrame) -> DataFrame:
    """``rid, prefix``: the m - MATCHES + 1 rarest postings of each document."""
    rare = F.array_sort(F.collect_list(F.struct("df", "token")))
    lists = live.groupBy("rid").agg(rare.alias("p"))  # at most COORDINATES each
    cut = F.slice("p", 1, F.size("p") - (MATCHES - 1))
    return lists.select("rid", F.transform(cut, lambda x: x.token).alias("prefix"))


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose lengths allow a link and whose signatures agree in MATCHES coordinates."""
    one = classes.select(F.col("rid").alias("a"), F.col("n_shingles").alias("n_a"), F.col("signature").alias("t_a"))
    two = classes.select(F.col("rid").alias("b"), F.col("n_shingles").alias("n_b"), F.col("signature").alias("t_b"))
    met = pairs.join(one, "a").join(two, "b").where(
        (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT)
        & (F.size(F.filter(F.zip_with("t_a", "t_b", lambda x, y: x == y), lambda same: same)) >= MATCHES)
    )
    return met.select("a", "b")


_SETS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("f1", T.LongType()),
    T.StructField("f2", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType())),
])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            hashes = shingler.hashes(text)
            if len(hashes):
                f1, f2 = _fingerprint(hashes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id], pa.int64()), pa.array([f1], pa.int64()), pa.array([f2], pa.int64()), pa.array([np.sort(hashes.view(np.int64))], pa.list_(pa.int64()))],
                    names=_SETS.names,
                )


def full_sets(rids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``rid, shingles``: the full sets of some classes, from a second reading of their documents."""
    wanted = classes.join(rids, "rid").select("rid", "doc_id", "f1", "f2")
    texts = docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    found = texts.mapInArrow(_sets, _SETS).join(wanted, ["doc_id", "f1", "f2"]).dropDuplicates(["rid"])
    return stored(found.select("rid", "shingles"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that are linked on their full sets."""
    one = sets.select(F.col("rid").alias("a"), F.col("shingles").alias("s_a"))
    two = sets.select(F.col("rid").alias("b"), F.col("shingles").alias("s_b"))
    same = F.size(F.array_intersect("s_a", "s_b"))
    return (
        pairs.join(one, "a").join(two, "b")
        .where(same * 100 >= (F.size("s_a") + F.size("s_b") - same) * PERCENT)
        .select("a", "b")
    )


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, one after the other, and the end of each list."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = whole.value_lengths().to_numpy(zero_copy_only=False)
    return whole.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)


class _Side:
    """A block of a posting list as arrays."""

    def __init__(self, table: pa.Table):
        self.rid, self.component, self.size = (table[n].to_numpy().copy() for n in ("rid", "component", "n_shingles"))
        self.stray = table["stray"].to_numpy().astype(bool)
        self.signature = _lists(table["signature"])[0].reshape(len(self.rid), -1)
        flat, ends = _lists(table["prefix"])
        self.posted = np.zeros((len(self.rid), COORDINATES), bool)
        self.posted[np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), flat >> 32] = True
        self.shingles, self.ends = _lists(table["shingles"])
        self.starts = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends


def _linked(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between two blocks of a posting list that connect different components.

    The left block holds members outside the largest component of the list, the right one any; two
    of the former are compared once.  A pair that shares several postings is looked at under the
    first coordinate only."""
    a, b = [], []
    if left.num_rows and right.num_rows:
        one, two = _Side(left), _Side(right)
        own = left["token"][0].as_py() >> 32
        for k in range(len(one.rid)):
            fits = (
                (two.component != one.component[k])
                & (~two.stray | (two.rid > one.rid[k]))
                & (np.minimum(two.size, one.size[k]) * 100 >= np.maximum(two.size, one.size[k]) * PERCENT)
            )
            near = np.flatnonzero(fits)
            agree = two.signature[near] == one.signature[k]
            near, agree = near[keep := agree.sum(axis=1) >= MATCHES], agree[keep]
            near = near[(agree & two.posted[near] & one.posted[k]).argmax(axis=1) == own]
            if not len(near):
                continue
            mine = one.shingles[one.starts[k] : one.ends[k]]
            sizes = two.size[near]
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            flat = np.concatenate([two.shingles[two.starts[j] : two.ends[j]] for j in near])
            place = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            common = np.add.reduceat((mine[place] == flat).astype(np.int64), at)
            for j in near[common * 100 >= (len(mine) + sizes - common) * PERCENT]:
                from_, to = two.component[j], one.component[k]
                if from_ != to:
                    a.append(min(one.rid[k], two.rid[j]))
                    b.append(max(one.rid[k], two.rid[j]))
                    two.component[two.component == from_] = to
                    one.component[one.component == from_] = to
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _hubs(lists: DataFrame) -> DataFrame:
    """``token, a``: the member that the others of a posting list are compared with first.  Long
    lists, which often have the same members, take different ones."""
    drawn = F.min(F.struct(F.xxhash64("token", "rid").alias("h"), "rid"))
    of = lists.groupBy("token").agg(F.count("*").alias("size"), F.min("rid").alias("least"), drawn.alias("drawn"))
    return of.select("token", F.when(F.col("size") > LONG, F.col("drawn.rid")).otherwise(F.col("least")).alias("a"))


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _crossing(lists: DataFrame, prefix: DataFrame, parts: DataFrame, slim: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across components between members of one posting list."""
    named = lists.join(parts, "rid", "left").select("rid", "token", F.coalesce("component", "rid").alias("component"))
    mixed = (
        named.groupBy("token")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"))
        .where("lo <> hi")
    )
    member = stored(named.join(mixed.select("token", "size"), "token"), "members")
    # Short lists: at most LONG / 2 pairs a member.
    short = member.where(F.col("size") <= LONG)
    other = short.select("token", F.col("rid").alias("b"), F.col("component").alias("component_b"))
    pairs = short.withColumnRenamed("rid", "a").join(other, "token").where("a < b AND component <> component_b")
    few = _confirmed(stored(_agreeing(pairs.select("a", "b").distinct(), slim), "agreeing"), sets)
    # Long lists: members outside the largest component of their list against all, in blocks with
    # their full sets, dealt by a hash of the member.
    long = member.where(F.col("size") > LONG).join(slim.select("rid", "n_shingles", "signature"), "rid")
    groups = long.groupBy("token", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    largest = F.max(F.struct("n", "component"))
    of = groups.groupBy("token").agg(
        largest["component"].alias("main"), F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight"),
        F.max_by("n", F.struct("n", "component")).alias("main_n"), F.max_by("weight", F.struct("n", "component")).alias("main_weight"),
    )

    def blocks(n, weight):
        return F.greatest(F.ceil(n / BLOCK), F.ceil(weight / BLOCK_SHINGLES), F.lit(1)).cast("int")

    cut = of.select(
        "token", "main",
        blocks(F.col("all_n") - F.col("main_n"), F.col("all_weight") - F.col("main_weight")).alias("stray_blocks"),
        blocks(F.col("all_n"), F.col("all_weight")).alias("blocks"),
    )
    rows = long.join(cut, "token").withColumn("stray", F.col("component") != F.col("main")).drop("main")
    rows = stored(rows.join(prefix, "rid").join(sets, "rid"), "blocks")
    dealt = F.xxhash64("rid")
    left = rows.where("stray").withColumn("x", F.pmod(dealt, F.col("stray_blocks")).cast("int"))
    left = left.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = rows.withColumn("y", F.pmod(dealt, F.col("blocks")).cast("int"))
    right = right.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("stray_blocks") - 1)))
    names = [F.col(c).alias(f"{c}_") for c in ("token", "x", "y")]
    right = right.select(*names, *(F.col(c).alias(c) for c in rows.columns if c != "token"))
    many = left.groupBy("token", "x", "y").cogroup(right.groupBy("token_", "x_", "y_")).applyInArrow(_linked, "a bigint, b bigint")
    return few.union(many)


def links(docs: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets, and links between classes enough for the components."""
    equal = (
        signed.where("n_shingles > 0")
        .groupBy("f1", "f2")
        .agg(F.min("rid").alias("rid"), F.min("doc_id").alias("component_doc"))
    )
    classes = stored(signed.join(equal.select("rid", "component_doc"), "rid"), "classes")
    slim = classes.select("rid", "n_shingles", "signature")
    prefix = stored(_prefix(postings(classes)), "prefix")
    sets = full_sets(prefix.select("rid"), classes, docs)
    lists = prefix.select("rid", F.explode("prefix").alias("token"))
    stars = lists.join(_hubs(lists), "token").where("a <> rid").select(*_ordered("a", "rid")).distinct()
    starred = _confirmed(stored(_agreeing(stars, slim), "agreeing"), sets)
    first = stored(spanning(starred).select(F.col("x").alias("a"), F.col("y").alias("b")), "links")
    parts = components(first).withColumnRenamed("node", "rid")
    return classes, first.union(_crossing(lists, prefix, parts, slim, sets))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row: the size of its set, the smallest
    id reachable over links, and whether that is its own."""
    slim = docs.select("doc_id", F.col(f"`{text}`").alias("text"))
    signed = stored(slim.where("doc_id IS NOT NULL").mapInArrow(_sign, SIGNED), "signed")
    classes, found = links(slim, signed)
    joined = components(stored(found, "all-links")).withColumnRenamed("node", "rid")
    owner = classes.select("rid", "f1", "f2", "component_doc").join(joined, "rid", "left")
    owner = owner.withColumn("component", F.coalesce("component", "rid"))
    smallest = owner.groupBy("component").agg(F.min("component_doc").alias("component_id"))
    owner = owner.join(smallest, "component").select("f1", "f2", "component_id")
    rows = (
        signed.select("doc_id", "n_shingles", "f1", "f2")
        .join(owner, ["f1", "f2"], "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    )
    nameless = slim.where("doc_id IS NULL").select("doc_id", "text")
    nameless = nameless.mapInArrow(_sign, SIGNED).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.union(nameless).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: of each component the document with the smallest id, one row of it."""
    names = docs.columns
    kept = find(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi")
    print_ = free_name("text_hash", names)
    named = named.withColumn(print_, F.xxhash64("text")).dropDuplicates(["doc_id", print_])
    return named.select(names).union(docs.where("doc_id IS NULL").select(names))
