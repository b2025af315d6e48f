"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut as cut_lineage
from ..operators.lineage import ensure_checkpoint_dir  # noqa: F401
from ..operators.lineage import shared_path as table_path

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def lower_ascii(text: str) -> str:
    """Lower-case A-Z only; other letters stay as they are."""
    return text.translate(_LOWER) if not text.isascii() else text.lower()


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (wraps modulo 2**64)."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Memo word -> 64-bit hash as a Python int; emptied when it reaches its bound."""

    def __init__(self, bound: int = 400_000) -> None:
        super().__init__()
        self.bound = bound

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage, so that shuffle files that nothing reads any more go before the next ones come."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts lineage like a checkpoint, and readers take only the columns they need."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrow(df: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """Only the named columns, so that extra columns with clashing names never matter."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c) for c in cols])


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def record_batch(names: list[str], columns: list, types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
