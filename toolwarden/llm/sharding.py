"""Sharding by Hilbert-curve order: runs of the curve are cut into shards of equal row counts.

Each document is a point in a grid of ``SIDE`` steps along three metadata
dimensions: source, language and size of the text.  The index of its cell on the
Hilbert curve orders the documents, so a shard (a run of the curve) covers a
compact part of the grid, and a reader that filters on any of the dimensions
skips most files.  Copies of a text take the smallest source and language among
them, so equal texts share a cell, and a cell is ordered by a hash of the text
first: copies stay together unless a cut falls among them.

The law is ``rows``: shard sizes differ by one row at most.  The global rank of
a row is the rows of earlier cells, plus those of earlier buckets of its cell,
plus its place in its bucket.  Cells are at most ``SIDE ** 3``; a bucket is some
bits of the text's hash and a salt from the row, so no task holds a hot cell or
a hot group of copies, and no row is moved to learn the cuts.

Defined results: a NULL text has 8 bytes and the checksum of nothing; NULL
metadata are a value of their own; repeated rows get slots of their own; a NULL
``doc_id`` is placed by its other columns; an empty table gives no rows; a column
named as a result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, once, stored, with_results

BITS = 4
SIDE = 1 << BITS
DIMENSIONS = 3
SHARDS = 24
LAW = "rows"
#: Buckets of a cell: by hash of the text, and by salt.
HASHED, SALTS = 64, 16


def hilbert(axes: list[Column], bits: int = BITS) -> Column:
    """The index on the Hilbert curve of a point with these integer coordinates.

    Skilling's transform (2004): undo the rotations and reflections of the
    curve from the highest bit down, take the Gray code, interleave the bits.
    It is computed as SQL in a few steps of 64-bit integers."""
    n = len(axes)
    x = F.array(*[a.cast("long") for a in axes])

    def at(i: int):
        return lambda v: F.element_at(v, i + 1)

    def turn(i: int, q: int, p: int):
        def step(v: Column) -> Column:
            first, own = at(0)(v), at(i)(v)
            flip = own.bitwiseAND(F.lit(q)) != 0
            swap = first.bitwiseXOR(own).bitwiseAND(F.lit(p))
            new_first = F.when(flip, first.bitwiseXOR(F.lit(p))).otherwise(first.bitwiseXOR(swap))
            new_own = F.when(flip, own).otherwise(own.bitwiseXOR(swap)) if i else new_first
            return F.array(*[new_own if j == i else new_first if j == 0 else at(j)(v) for j in range(n)])

        return step

    for level in range(bits - 1, 0, -1):
        for i in range(n):
            x = F.transform(F.array(x), turn(i, 1 << level, (1 << level) - 1))[0]

    def gray(v: Column) -> Column:
        out = [at(0)(v)]
        for i in range(1, n):
            out.append(at(i)(v).bitwiseXOR(out[-1]))
        return F.array(*out)

    x = F.transform(F.array(x), gray)[0]

    def mask(v: Column) -> Column:
        t = F.lit(0).cast("long")
        for level in range(bits - 1, 0, -1):
            q = 1 << level
            t = F.when(at(n - 1)(v).bitwiseAND(F.lit(q)) != 0, t.bitwiseXOR(F.lit(q - 1))).otherwise(t)
        return F.array(*[at(i)(v).bitwiseXOR(t) for i in range(n)])

    x = F.transform(F.array(x), mask)[0]

    def weave(v: Column) -> Column:
        out = F.lit(0).cast("long")
        for level in range(bits):
            for i in range(n):
                bit = F.shiftright(at(i)(v), level).bitwiseAND(F.lit(1))
                out = out + F.shiftleft(bit, level * n + (n - 1 - i))
        return out

    return F.transform(F.array(x), weave)[0]


def _axes(lang: Column, source: Column, size: Column) -> list[Column]:
    """Coordinates: source and language by a hash of the name, size by its logarithm."""
    named = [F.pmod(F.xxhash64(F.coalesce(c.cast("string"), F.lit("\x00"))), F.lit(SIDE)) for c in (source, lang)]
    scaled = F.least(F.lit(SIDE - 1), F.greatest(F.lit(0), F.floor(F.log2(size.cast("double")) - 5)))
    return [*named, scaled]


def write(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the documents in folders by shard, each in the order of the curve."""
    placed = place(docs, shards, with_text=True)
    ordered = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)


def place(docs: DataFrame, shards: int = SHARDS, with_text: bool = False) -> DataFrame:
    """``docs`` (texts only if asked for, as they move with the rows) with
    ``size, text_crc32, law, shard, slot, grown_shard``."""
    names = [n for n in docs.columns if with_text or n.lower() != "text"]
    lower = {n.lower(): n for n in names}

    def given(name: str) -> Column:
        return F.col(f"`{lower[name]}`").cast("string") if name in lower else F.lit(None).cast("string")

    text = F.coalesce(F.col("`text`"), F.lit(""))
    rows = docs.select(
        *carried(names),
        F.col("doc_id").cast("long").alias("id"),
        given("lang").alias("lang"),
        given("source").alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("hash"),
    )
    rows = stored(rows, "sizes")  # every text is read once
    shared = rows.groupBy("hash", "size").agg(
        F.min(F.struct("source", "lang")).alias("least"), F.count("*").alias("copies")
    ).where("copies > 1")
    # Copies may be a third of all rows under one key: both sides are shuffled, and adaptive
    # execution splits a large partition of the rows against its one row here.
    rows = rows.join(shared.select("hash", "size", "least"), ["hash", "size"], "left").withColumn(
        "least", F.coalesce("least", F.struct("source", "lang"))
    )
    salt = F.pmod(F.xxhash64("id", "source", "lang"), F.lit(SALTS))
    bucket = F.pmod(F.col("hash"), F.lit(HASHED)) * SALTS + salt
    rows = once(
        rows,
        cell=hilbert(_axes(F.col("least.lang"), F.col("least.source"), F.col("size"))),
        bucket=bucket,
    )
    rows = stored(rows, "cells")
    counts = rows.groupBy("cell", "bucket").agg(F.count("*").alias("c"))
    cells = counts.groupBy("cell").agg(F.sum("c").alias("c"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # SIDE ** 3 rows at most
    everything = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.select("cell", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("cell_base"), F.sum("c").over(everything).alias("all_rows"))
    within = Window.partitionBy("cell").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counts.withColumn("bucket_base", F.coalesce(F.sum("c").over(within), F.lit(0)))
        .join(cells, "cell")
        .select("cell", "bucket", (F.col("bucket_base") + F.col("cell_base")).alias("base"), "all_rows")
    )
    order = Window.partitionBy("cell", "bucket").orderBy("hash", "id", "source", "lang")
    ranked = rows.withColumn("place", F.row_number().over(order) - 1).join(starts, ["cell", "bucket"])
    rank = F.col("base") + F.col("place")
    # The first all_rows % shards shards have one row more.
    least, more = F.floor(F.col("all_rows") / shards), F.col("all_rows") % shards
    in_more = rank < more * (least + 1)
    shard = F.when(in_more, F.floor(rank / (least + 1))).otherwise(
        more + F.floor((rank - more * (least + 1)) / F.greatest(least, F.lit(1)))
    )
    slot = F.when(in_more, rank % (least + 1)).otherwise((rank - more * (least + 1)) % F.greatest(least, F.lit(1)))
    results = {
        "size": F.col("size"), "text_crc32": F.col("crc"), "law": F.lit(LAW),
        "shard": shard.cast("int"), "slot": slot.cast("long"), "grown_shard": F.lit(None).cast("int"),
    }
    return ranked.select(*with_results(names, results))
