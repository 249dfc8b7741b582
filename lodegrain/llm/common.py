"""Shared plumbing: scratch tables on the cluster's shared folder, size checks, splitters."""

from __future__ import annotations

import ctypes
import json
import math
import os
import re
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="lodegrain-")
    return _LOCAL_FOLDERS[app]


class Scratch:
    """Tables written to the shared folder, so that no later step depends on an executor that may be lost.

    ``keep`` writes and rereads a frame; ``drop`` removes a table that nothing reads any more. The
    tables behind a returned (lazy) frame stay until ``release`` is called on its scratch.
    """

    live: list["Scratch"] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/lodegrain/{name}-{uuid.uuid4().hex}"
        Scratch.live.append(self)

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        self.drop()
        if self in Scratch.live:
            Scratch.live.remove(self)


def release_all() -> None:
    """Remove all scratch tables; call when every result made so far has been written."""
    for s in list(Scratch.live):
        s.release()


def small_join(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int, limit: int = 200_000) -> DataFrame:
    """Join with the right side broadcast if its counted rows are within limit, else by shuffle."""
    return left.join(F.broadcast(right) if rows <= limit else right, on, how)


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """Rows of counts with the largest n, most of them at most, without a sort: those above a limit that a histogram of n gives."""
    steps = 64  # to a doubling, so that ties and near ties stay out together
    level = F.floor(F.log2("n") * steps).cast("int")
    held, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect(), reverse=True):
        held += r["rows"]
        if held > most:
            break
        least = r["level"]
    return counts.filter(level >= least) if least is not None else counts.limit(0)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application."""
    sc = spark.sparkContext
    if not any(os.path.basename(f) == "lodegrain.zip" for f in sc._python_includes):
        top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        path = os.path.join(tempfile.mkdtemp(prefix="lodegrain-"), "lodegrain.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(os.path.join(top, "lodegrain")):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, top))
        sc.addPyFile(path)


def free_memory() -> None:
    """Give memory that a worker no longer uses back, as it may live on beside tasks of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with this package at hand on the executors."""
    ship(df.sparkSession)

    def run(batches):
        yield from function(batches)
        free_memory()

    return df.mapInArrow(run, schema)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from driver values without Python on the executors."""
    names = [p.strip().split()[0] for p in schema.split(",")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    fields = ", ".join(f"{p.strip().split()[0]}: {p.strip().split()[1]}" for p in schema.split(","))
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{fields}>>")).alias("r")).select("r.*")


def rank_of(value: Column, splitters: list[int]) -> Column:
    """How many of the sorted long splitters are <= value: two scans of about sqrt(n) literals."""
    if not splitters:
        return F.lit(0)
    step = max(1, math.isqrt(len(splitters)))
    runs = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    tops = F.from_json(F.lit(json.dumps([r[0] for r in runs])), "array<bigint>")
    nested = F.from_json(F.lit(json.dumps(runs)), "array<array<bigint>>")
    top = F.size(F.filter(tops, lambda x: x <= value))
    within = F.size(F.filter(F.try_element_at(nested, top), lambda x: x <= value))
    return F.when(top == 0, F.lit(0)).otherwise((top - 1) * F.lit(step) + within)


def free_name(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cumulative(values: list[float]) -> list[float]:
    out, total = [], 0
    for v in values:
        out.append(total)
        total += v
    return out


__all__ = ["Scratch", "commonest", "free_memory", "free_name", "map_arrow", "ship", "release_all", "small_join", "literal_rows", "rank_of", "cumulative", "shared_folder"]
