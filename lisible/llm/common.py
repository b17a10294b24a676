"""Shared pieces: table access, tables written to the shared folder, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space and words of the text contracts: only these six ASCII characters separate words.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Rows of texts that a worker has as Python objects at a time.
SLICE = 500
#: What operators keep in a worker from task to task, by name: a function that empties it.
KEPT: dict[str, Callable[[], None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local one is set only where there is one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lisible-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lisible/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back, so lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, SLICE at a time: whole batches of texts, as Python objects, are several times their own size."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def hand_back(name: str = "") -> None:
    """Gives the memory that this worker does not need back to the system: what operators but the named one keep in it,
    and what is free but held by allocators.

    Workers live on from task to task and stage to stage, so both would count until the last stage has ended.
    """
    for other, empty in KEPT.items():
        if other != name:
            empty()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, other C libraries need not
    if trim:
        trim(0)


def handing_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], name: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that calls hand_back() as its task begins and ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hand_back(name)
        try:
            yield from run(batches)
        finally:
            hand_back(name)

    return whole


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def drop_path(spark: SparkSession, path: str) -> None:
    p, fs = _file_system(spark, path)
    fs.delete(p, True)


def put_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    p, fs = _file_system(spark, path + ".new")
    out = fs.create(p, True)
    out.write(text.encode())
    out.close()
    fs.rename(p, _file_system(spark, path)[0])


def read_file(spark: SparkSession, path: str) -> str:
    p, fs = _file_system(spark, path)
    opened = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(opened)).decode()
    finally:
        opened.close()


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished files and folders in a folder."""
    p, fs = _file_system(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in names if not n.endswith(".new"))


def with_fields(df: DataFrame, *more: tuple[str, T.DataType]) -> T.StructType:
    """The schema of df and further columns after it."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in more)])


def free_column(df: DataFrame, base: str) -> str:
    """A column name that df does not have yet, case ignored."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def connected_components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """(u, v) pairs of longs → (node, root): root is the smallest node of the component.

    Alternating large-star and small-star steps (Kiveris et al., 2014): the number of edges never grows and each
    step is a pre-aggregated minimum and an equi-join with a written table, which adaptive execution can split
    when one node has very many neighbours. Stops when every component is a star, often before the first round.
    """
    spark = edges.sparkSession
    paths: list[str] = []

    def put(df: DataFrame, what: str) -> DataFrame:
        path = scratch_path(spark, f"{name}-{what}")
        df.write.parquet(path)
        paths.append(path)
        return spark.read.schema(df.schema).parquet(path)

    def star(e: DataFrame, large: bool) -> DataFrame:
        """Large: neighbours above u go to u's minimum. Small: u and its neighbours below go to their minimum."""
        if large:
            both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = put(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        joined = both.join(low, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return put(out.where("u <> v").distinct(), "edges")

    def settled(e: DataFrame) -> bool:
        """Every u has one v, and no v is a u: each component is a star around its smallest node."""
        n, n_u = e.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
        return n == n_u and e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()

    now = put(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for turn in range(max_rounds + 1):
        if settled(now):
            break
        if turn == max_rounds:
            raise RuntimeError(f"{name}: components did not settle in {max_rounds} rounds")
        old = list(paths)
        now = star(star(now, True), False)
        for p in old:
            drop_path(spark, p)
        del paths[: len(old)]
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
