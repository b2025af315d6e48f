"""Sources beyond Spark's own: vector files, test reports, trace exports, blobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TYPES = {"f32": "<f4", "i8": "i1", "i32": "<i4"}


def vector_files(spark: SparkSession, path: str, kind: str, dims: int) -> DataFrame:
    """Raw row-major vector files -> (file, row, vector)."""
    dtype = np.dtype(_TYPES[kind])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                if len(content) % (dims * dtype.itemsize):
                    raise ValueError(f"{file}: length is no multiple of a row")
                m = np.frombuffer(content, dtype).reshape(-1, dims)
                for a in range(0, len(m), 10_000):
                    part = m[a : a + 10_000]
                    yield pd.DataFrame({"file": file, "row": np.arange(a, a + len(part)), "vector": list(part.astype(float))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row long, vector array<double>")


def junit(spark: SparkSession, path: str) -> DataFrame:
    """JUnit XML files -> (classname, name, time, failed)."""
    cases = spark.read.format("xml").option("rowTag", "testcase").schema("_classname string, _name string, _time double, failure string").load(path)
    return cases.select(F.col("_classname").alias("classname"), F.col("_name").alias("name"), F.col("_time").alias("time"), F.col("failure").isNotNull().alias("failed"))


def spans(lines: DataFrame, col: str) -> DataFrame:
    """OTLP JSON lines -> (service, name, path, status, ms)."""
    attr = "array<struct<key:string,value:struct<stringValue:string,intValue:string>>>"
    schema = f"struct<resourceSpans:array<struct<resource:struct<attributes:{attr}>,scopeSpans:array<struct<spans:array<struct<name:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{attr}>>>>>>>"
    get = lambda a, k: F.element_at(F.filter(a, lambda x: x["key"] == k), 1)["value"]
    r = lines.select(F.explode(F.from_json(col, schema)["resourceSpans"]).alias("r"))
    r = r.select(get(F.col("r.resource.attributes"), "service.name")["stringValue"].alias("service"), F.explode("r.scopeSpans").alias("s")).select("service", F.explode("s.spans").alias("s"))
    return r.select("service", F.col("s.name").alias("name"), F.parse_url(get(F.col("s.attributes"), "http.url")["stringValue"], F.lit("PATH")).alias("path"), get(F.col("s.attributes"), "http.status_code")["intValue"].cast("int").alias("status"), ((F.col("s.endTimeUnixNano").cast("double") - F.col("s.startTimeUnixNano").cast("double")) / 1e6).alias("ms"))


def blob(chunks: DataFrame) -> DataFrame:
    """(blob_id, idx, bytes) -> (blob_id, n, size, sha256) with the chunks in order."""
    g = chunks.groupBy("blob_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.hex("bytes").alias("h")))).alias("c"))
    whole = F.unhex(F.array_join(F.transform("c", lambda x: x["h"]), ""))
    return g.select("blob_id", F.size("c").alias("n"), F.length(whole).alias("size"), F.sha2(whole, 256).alias("sha256"))
