"""Readers and writers of line records: strict JSON lines, tolerant unions, atomic sinks and sheets."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridelta.session import path_exists


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a fixed schema. Blank lines are skipped; anything that isn't an object is kept as a row with ``_bad`` and
    ``_file``, so that the caller can refuse it with its place."""
    bad = "_bad"
    full = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    df = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path)
    return df.withColumn("_file", F.col("_metadata.file_path"))


def strict_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """As ``read_lines``, failing on the first bad line."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tolerant(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An empty table where there is no file."""
    return strict_lines(spark, path, schema) if path_exists(spark, path) else spark.createDataFrame([], schema)


def union_files(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """Files in the order given: file_idx keeps it."""
    parts = [strict_lines(spark, p, schema).withColumn("file_idx", F.lit(i)) for i, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, parts)


def edge_lists(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The edges of graph documents, one a row, each with its kind."""
    edge = "array<struct<id:string,head:string,relation:string,tail:string,start:string,end:string>>"
    df = spark.read.schema(f"edges {edge}").option("multiLine", True).json(path)
    return df.select(F.explode("edges").alias("e")).select("e.*", F.lit(kind).alias("kind"))


def write_lines(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines, nulls written out; the committer makes the folder whole or not at all."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", "false").json(path)


def write_by(df: DataFrame, path: str, keys: Sequence[str], overwrite: bool = False) -> None:
    """Parquet in a folder for each key; rows are gathered by key first, so a key has few files."""
    df.repartition(*keys).write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*keys).parquet(path)


def write_sheet(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """CSV with a header; arrays and structs as JSON."""
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("quoteAll", True).csv(path)


def fingerprint(spark: SparkSession, paths: Sequence[str], config: dict) -> str:
    """One hash of files and configuration, names of secrets left out."""
    one = F.concat_ws(":", F.regexp_extract("path", "([^/]*)$", 1), F.sha2("content", 256))
    files = spark.read.format("binaryFile").load(list(paths)).select(one.alias("f")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("f")), "\n"), 256)).first()[0]
    plain = {k: v for k, v in sorted(config.items()) if not any(w in k.lower() for w in ("key", "token", "secret", "password"))}
    return hashlib.sha256(json.dumps([files, plain], sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def path_library(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, id, nodes, hops) of the paths in JSON documents {hops, paths: [{id, nodes: [{qid}]}]} that a glob names."""
    df = spark.read.schema("hops int, paths array<struct<id:string,nodes:array<struct<qid:string>>>>").option("multiLine", True).json(pattern)
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]*)$", 1).alias("file"), "hops", F.explode("paths").alias("p")).select("file", "p.id", F.col("p.nodes.qid").alias("nodes"), "hops")


def write_report(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A report of one row as one indented JSON file; more rows are an error. The file appears whole or not at all."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a report has one row")
    _put(df.sparkSession, path, json.dumps(rows[0].asDict(recursive=True), ensure_ascii=False, indent=2, default=str) + "\n", overwrite)


def write_summary(df: DataFrame, path: str, overwrite: bool = False, most: int = 10_000) -> None:
    """A small table as one CSV file with a header and a byte order mark, as spreadsheet programs want it."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a summary has at most {most} rows")
    out = io.StringIO()
    sheet = csv.writer(out)
    sheet.writerow(df.columns)
    sheet.writerows(["" if v is None else v for v in r] for r in rows)
    _put(df.sparkSession, path, "\ufeff" + out.getvalue(), overwrite)


def _put(spark: SparkSession, path: str, text: str, overwrite: bool) -> None:
    """Write one small file on whatever file system the path names: beside it first, then by its name."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    to, by = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(to) and not overwrite:
        raise FileExistsError(path)
    stream = fs.create(by, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if overwrite:
        fs.delete(to, False)
    if not fs.rename(by, to):
        raise OSError(f"{path} can't be put in place")
