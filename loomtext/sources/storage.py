"""Where intermediate files go, and readers that tolerate untidy delimited files."""

from __future__ import annotations

import csv
import io
import tempfile
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the cluster's shared folder; a temporary one only in local mode without a name."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="loomtext-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted, with a header; quotes are doubled and line breaks kept."""
    df.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def write_marked_csv(df: DataFrame, path: str) -> None:
    """One file with a byte order mark, for spreadsheet programs. A single task writes
    it, so it is for reports; write_csv is for whole corpora."""
    marked = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    write_csv(marked.coalesce(1), path)


def word_list(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The distinct lower-case words of several text files."""
    lines = spark.read.text(paths)
    words = lines.select(F.explode(F.split(F.lower("value"), r"\s+")).alias("word"))
    return words.where("word <> ''").distinct()


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, encoding: str = "UTF-8") -> DataFrame:
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
    return reader.option("encoding", encoding).csv(path)


def read_strings(spark: SparkSession, path: str | list[str], columns: list[str], encoding: str = "UTF-8") -> DataFrame:
    """Every column a string, missing values blank."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return read_csv(spark, path, schema, encoding).na.fill("")


def detect_encoding(head: bytes) -> str:
    """The first of UTF-8 and GB18030 that the bytes allow (a cut-off character is no error)."""
    for name in ("utf-8", "gb18030"):
        try:
            head.decode(name)
            return name
        except UnicodeDecodeError as e:
            if e.start > len(head) - 4 and len(head) > 8:
                return name
    return "latin-1"


def read_any_encoding(spark: SparkSession, path: str, columns: list[str], head: int = 1 << 16) -> DataFrame:
    """Strings out of files that may each be UTF-8 (marked or not), GB18030 or Latin-1; Spark's
    own reader knows the first alone, so other files are decoded whole by the workers."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    files = spark.read.format("binaryFile").load(path)
    odd = [r.path for r in files.select("path", F.substring("content", 1, head).alias("head")).collect() if detect_encoding(bytes(r.head)) != "utf-8"]  # one row a file
    plain = [r.path for r in files.select("path").collect() if r.path not in odd]

    def decode(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                records = list(csv.reader(io.StringIO(content.decode(detect_encoding(content), "replace"), newline="")))[1:]
                found = [pa.array([r[i] if i < len(r) else "" for r in records], pa.string()) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays(found, columns)

    parts = [read_strings(spark, plain, columns)] if plain else []
    if odd:
        parts.append(spark.read.format("binaryFile").load(odd).select("content").mapInArrow(decode, schema))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch(spark, "csv")
    write_csv(df, path)
    return read_csv(spark, path, df.schema)


def _path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, store = _path(spark, path)
    return bool(store.exists(found))


def delete(spark: SparkSession, path: str) -> None:
    found, store = _path(spark, path)
    store.delete(found, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    found, store = _path(spark, path)
    if not store.rename(found, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} can't take the name {to}")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` kept in shared storage, for plans that use it more than once."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
