"""What the operators of this package share: tables, lineage cuts, components, distributed ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of the contracts, as a Java or RE2 class; a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def let(value: Column, use) -> Column:
    """use(value), with value worked out once, however often use refers to it, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def packed(docs: DataFrame, *needed: str, apart: str = "") -> DataFrame:
    """The needed columns of docs, and all others, or all but `apart`, as the struct _row: no name of docs can clash with
    what is added."""
    return docs.select(*[F.col(f"`{c}`") for c in needed], F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != apart]).alias("_row"))


def unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """docs' columns again, from _row; those named in `changed` get new values, of their old type."""
    kinds = dict(docs.dtypes)
    return rows.select(*[(changed[c].cast(kinds[c]) if c in changed else F.col("_row").getField(c)).alias(c) for c in docs.columns])


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: a cut of the lineage that survives lost executors.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Deletes the files of stored() that these tables read, once no table in use reads them any more; they would fill the
    shared folder until the driver ends, through all later stages."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[-1].startswith("stored-"):
                at = jvm.org.apache.hadoop.fs.Path(folder)
                at.getFileSystem(conf).delete(at, True)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which the cluster sizes to its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """From here on the session's Arrow batches have at most so many rows: each task holds a whole batch outside its heap, in
    buffers that grow by doubling, and once more in its Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    spark.conf.set(key, rows if now <= 0 else min(now, rows))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), by alternating large and small stars.

    Returns (id, root) for each vertex of an edge between two different vertices; root is the smallest vertex of its
    component. Null ends and loops are ignored. Every round is a grouped minimum, combined before its shuffle, and an
    equi-join with it, which adaptive execution may split where a vertex is hot; rounds grow with the logarithm of the
    vertices.
    """
    e = stored(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    while True:
        n, heads = e.agg(F.count("*"), F.countDistinct("u")).first()
        if n == heads and e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = stored(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        e = stored(
            large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    )


def running_total(df: DataFrame, keys: list[str], order: list[str], amount: str, blocks: int, name: str = "before") -> DataFrame:
    """Adds the sum of `amount` over the rows of the same keys that come before, in `order`; `order` starts with a hash.

    order[0] is a column of evenly spread hashes below 2 ** 60: its ranges cut every key into `blocks` blocks in order,
    so a hot key is dealt over many tasks. Totals of blocks, one small row for each key and block, give each block its
    start. Null keys form a group of their own. `blocks` must grow with the input.
    """
    block = F.least(F.lit(blocks - 1), F.floor(F.col(order[0]).cast("double") / F.lit(float(1 << 60)) * F.lit(float(blocks))).cast("int"))
    cut = df.withColumn("_block", block)
    ahead = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*keys, "_block").agg(F.sum(amount).alias("_sum"))
    starts = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).cast("long").alias("_start"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.withColumn(name, F.coalesce(F.sum(amount).over(inside), F.lit(0)).cast("long"))
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(starts, same).withColumn(name, F.col(name) + F.col("_start")).drop("_b", "_block", "_start", *[f"_k{i}" for i in range(len(keys))])


def spread(*columns: Column) -> Column:
    """A hash below 2 ** 60 of the columns' text, the same in other engines: the first 15 hex digits of the MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])), 1, 15), 16, 10).cast("long")
