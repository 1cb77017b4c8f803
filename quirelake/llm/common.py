"""Shared helpers: tables in the cluster's shared folder, and word splitting of whole texts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that end a word: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
BITS_PER_KEY, BITS = 16, 1 << 29
_OWN: dict[str, str] = {}
#: Paths of the tables that stand, in the order they were made.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary folder if everything runs in this one process, as in tests; else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors share; it is unset, and {master} runs executors elsewhere")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="quirelake-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        found = f"file://{_OWN[app]}"
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/quirelake-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors, is computed once. It stays until drop(), release() or the end of a scratch() block."""
    path = new_path(df.sparkSession, tag)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quirelake_path = path
    _MADE.append(path)
    return out


def reread(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What was appended at path, as a table like those of written(); empty if nothing was."""
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._quirelake_path = path
    _MADE.append(path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by written() that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_quirelake_path", None):
            delete(df.sparkSession, path)
            if path in _MADE:
                _MADE.remove(path)


def keep(df: DataFrame) -> DataFrame:
    """df, whose table release() then leaves alone."""
    if (path := getattr(df, "_quirelake_path", None)) in _MADE:
        _MADE.remove(path)
    return df


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes all tables made since the first `since` ones that still stand. Results that read them must have been written or collected."""
    while len(_MADE) > since:
        delete(spark, _MADE.pop())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what written() makes inside the block at its end, but for tables passed to keep()."""
    since = len(_MADE)
    try:
        yield
    finally:
        release(spark, since)


class Bitmap:
    """A set of hashed keys that never misses one and takes in others at a small rate: bit `key mod size` of each key is set."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys.view(np.uint64) & np.uint64(64 * len(self.words) - 1)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def bitmap(keys: DataFrame, column: str):
    """Broadcast Bitmap of a column of 64-bit hashes: BITS_PER_KEY bits a key, BITS (64 MB) at most whatever the table's size; a fuller one only takes in more other keys."""
    bits = 1 << min(BITS.bit_length() - 1, max(6, (BITS_PER_KEY * keys.count()).bit_length()))
    at = keys.select(F.col(column).bitwiseAND(F.lit(bits - 1)).alias("at"))
    rows = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("b")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(Bitmap(words))


def word_blocks(data: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """Words of UTF-8 data in order, a list for each block of about size bytes, so that a very long text
    never has all of its words in memory at once. bytes.split() splits at just the six SPACES."""
    at = 0
    while at < len(data):
        if len(data) - at <= size:
            end = len(data)
        else:
            m = _SPACE.search(data, at + size)
            end = m.start() if m else len(data)
        if words := (data if end - at == len(data) else data[at:end]).split():
            yield words
        at = end
