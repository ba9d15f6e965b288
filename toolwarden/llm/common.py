"""What several corpus operators share: table reading, shared folder, columns, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from toolwarden.plans.workspace import shared_folder

#: The word separators of every word rule here: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a regular expression.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table below ``spark.checkpoint.dir`` and continue from the files.

    It cuts the lineage and survives the loss of any executor; rows keep the
    values that a task gave them, so row numbers made by tasks are safe to use
    only behind it."""
    path = f"{shared_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like :func:`stored`, the rows dealt over buckets by ``key``: a grouping by ``key`` takes
    them as they lie, without a shuffle.

    The buckets are known to the catalog only, so the table is entered there, resolved, and
    taken out again; the files stay."""
    spark = df.sparkSession
    table = f"llm_{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(table)
    rows = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return rows


def carried(names: list[str]) -> list[Column]:
    """The columns of a table under names that no step of an operator uses."""
    return [F.col(f"`{n}`").alias(f"_in{i}") for i, n in enumerate(names)]


def with_results(names: list[str], results: dict[str, Column]) -> list[Column]:
    """The carried columns under their own names, each replaced by the result of the same name
    if there is one, then the other results."""
    lower = {r.lower(): r for r in results}
    kept = [
        results[lower[n.lower()]].alias(n) if n.lower() in lower else F.col(f"_in{i}").alias(n)
        for i, n in enumerate(names)
    ]
    present = {n.lower() for n in names}
    return kept + [c.alias(n) for n, c in results.items() if n.lower() not in present]


def new_text(names: list[str], text: Column) -> dict[str, Column]:
    """A changed text, and its length if the table has one."""
    changed = {"text": text}
    if "n_chars" in names:
        changed["n_chars"] = F.coalesce(F.length(text), F.lit(0)).cast("bigint")
    return changed


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions refer to but never evaluate again.

    Lambda functions evaluate what they capture for every element, and the
    optimizer moves a column that is used once into its user; the output of a
    one-row generator is not moved."""
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))


def words(text: Column) -> Column:
    """The words of a text, none for NULL."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE_RUN)
    )


#: Links of which a task keeps a spanning forest at a time.
FOREST = 1 << 18


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each stretch of links those that join what the ones before left apart."""
    parent: dict = {}
    read = 0
    for batch in batches:
        kept_x, kept_y = [], []
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = x, y
            while (up := parent.get(a, a)) != a:
                parent[a] = a = parent.get(up, up)
            while (up := parent.get(b, b)) != b:
                parent[b] = b = parent.get(up, up)
            if a != b:
                parent[a] = b
                kept_x.append(x)
                kept_y.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(kept_x, batch.schema.types[0]), pa.array(kept_y, batch.schema.types[1])], names=["x", "y"])
        read += batch.num_rows
        if read >= FOREST:
            parent, read = {}, 0


def spanning(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """``x, y``: links with the same components, of which every task has left out those that close a
    circle, so that members with many links to the same few nodes do not carry all of them on."""
    links = edges.select(F.col(src).alias("x"), F.col(dst).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return links.mapInArrow(_forest, links.schema)


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """``node, component``: the smallest node reachable from each node of ``edges``.

    Every round passes the smallest label over each link to both its ends and
    to the node that the end points to, then shortens the pointers, so rounds
    grow with the logarithm of a path.  Labels live in the shared folder."""
    forest = stored(spanning(edges, src, dst), "forest")
    links = stored(forest.union(forest.select("y", "x")), "links")
    labels = stored(
        links.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select(
            "node", F.least("node", "m").alias("component")
        ),
        "labels",
    )
    while True:
        far = labels.select(F.col("node").alias("y"), F.col("component").alias("c"))
        offers = (
            links.join(far, "y")
            .groupBy(F.col("x").alias("node"))
            .agg(F.min("c").alias("c"))
            .join(labels, "node")
        )
        proposed = (
            offers.select(F.explode(F.array("node", "component")).alias("node"), "c")
            .groupBy("node")
            .agg(F.min("c").alias("c"))
        )
        hooked = labels.join(proposed, "node", "left").select(
            "node", "component", F.least("component", F.coalesce("c", "component")).alias("now")
        )
        hooked = stored(hooked, "hooked")
        up = hooked.select(F.col("node").alias("now"), F.col("now").alias("above"))
        labels = stored(
            hooked.join(up, "now").select(
                "node", F.least("now", "above").alias("component"), F.col("component").alias("was")
            ),
            "labels",
        )
        if labels.where("component <> was").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")


def free_name(wanted: str, names: list[str]) -> str:
    """``wanted``, lengthened until no column has that name."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def appended(df: DataFrame, fields: T.StructType, compute: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """All columns of ``df`` and those that ``compute`` gives for each Arrow batch.

    ``compute`` gets a record batch and returns one list or array per field.
    Rows stay where they are: no shuffle, and a batch is the only state."""
    schema = T.StructType([*df.schema.fields, *fields.fields])
    types = [to_arrow_type(f.dataType) for f in fields.fields]
    names = [f.name for f in fields.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added = [
                a if isinstance(a, pa.Array) else pa.array(a, t)
                for a, t in zip(compute(batch), types, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added], names=[*batch.schema.names, *names]
            )

    return df.mapInArrow(run, schema)
