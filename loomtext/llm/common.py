"""Shared storage, table access and byte-level tokenising for the operators.

Intermediate tables go to the folder named in ``spark.checkpoint.dir``, which
driver and executors share, so a lost executor costs only its running tasks.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode without a name (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="loomtext-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/loomtext"


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back: lineage ends here and the
    shuffle files that led to it can go at once."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of shared storage, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote, once nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles() if "/loomtext/" in f}:
        delete(df.sparkSession, folder)


#: Tables of at most so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: A key that holds more than one in HOT_SHARE of all rows, and more than HOT_ROWS, is joined by broadcast.
HOT_SHARE, HOT_ROWS = 1000, 1000


def few(df: DataFrame) -> DataFrame:
    """``df`` (narrow, already written), marked for a broadcast if its size allows one."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def join_keys(rows: DataFrame, keys: DataFrame, key: str | list[str], n: str) -> DataFrame:
    """``rows`` joined with ``keys``, a written table with one row for each key and, in its
    column ``n``, how many of the rows have it. The rows of hot keys (fewer than HOT_SHARE)
    are joined where they lie, so no key's rows meet in one task."""
    total, most = keys.agg(F.sum(n), F.max(n)).first()
    bar = max(HOT_ROWS, (total or 0) // HOT_SHARE)
    if (most or 0) <= bar:
        return rows.join(keys.hint("merge"), key)  # the keys grow with the data
    name = F.xxhash64(*([key] if isinstance(key, str) else key))
    hot = [r[0] for r in keys.where(F.col(n) > bar).select(name).collect()]
    return rows.where(~name.isin(hot)).join(keys.where(~name.isin(hot)).hint("merge"), key).unionByName(rows.where(name.isin(hot)).join(F.broadcast(keys.where(name.isin(hot))), key))


def held_out(id_col: str, folds: int) -> F.Column:
    """True where crc32 of the id as text leaves remainder 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 1, F.lit(False))


def hashed_share(id_col: str, seed: str) -> F.Column:
    """A reproducible number in [0, 1) for each id."""
    text = F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(2**32)


def trim() -> None:
    """Give freed memory back to the system, where the C library can: workers live on."""
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


# --- bytes and words -------------------------------------------------------

#: Lower-cased ASCII letters, digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Everything but the six ASCII white-space characters.
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, *range(0x09, 0x0E)]] = False
#: bytes.translate table: words of the ALNUM class in lower case, all else a space.
ALNUM_SPACED = bytes(ord(chr(b).lower()) if b < 128 and ALNUM[b] else b if ALNUM[b] else 32 for b in range(256))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def byte_column(col: pa.Array) -> pa.Array:
    """Texts as UTF-8 bytes; null becomes empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "") if col.null_count else col
    return col.cast(pa.binary())


def alnum_words(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM_SPACED).split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D
_SLICE = 1 << 19
_POWERS = np.concatenate([[U64(1)], np.cumprod(np.full(_SLICE, _BASE, U64))])
_INVERSE = np.concatenate([[U64(1)], np.cumprod(np.full(_SLICE, pow(_BASE, -1, 2**64), U64))])


def _hash_slice(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each word of one slice, from prefix sums."""
    low, high = int(starts[0]), int(ends[-1])
    n = high - low
    if n > _SLICE:  # a single word longer than the slice: fold its parts together
        h = U64(0)
        for at in range(low, high, _SLICE):
            part = data[at : min(high, at + _SLICE)]
            h = mix(np.array([h + (_BYTE[part] * _POWERS[: len(part)]).sum(dtype=U64)], U64))[0]
        return np.array([h], U64)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[data[low:high]] * _POWERS[:n], out=sums[1:])
    own = (sums[ends - low] - sums[starts - low]) * _INVERSE[starts - low]
    return mix(own + (ends - starts).astype(U64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[starts:ends], in slices of bounded size."""
    out, i, n = np.empty(len(starts), U64), 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SLICE, side="right")))
        out[i:j] = _hash_slice(data, starts[i:j], ends[i:j])
        i = j
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each run of ``kind`` bytes; runs end with their row."""
    inside = kind[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = (inside[0], False) if len(data) else (False, False)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    edge[1:-1] = inside[1:] & (~inside[:-1] | cut[1:-1])
    starts = np.flatnonzero(edge[:-1])
    stop = np.empty(len(data), bool)
    stop[-1] = inside[-1]
    stop[:-1] = inside[:-1] & (~inside[1:] | cut[1:-1])
    ends = np.flatnonzero(stop) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return rows, starts, ends


def row_chunks(col: pa.Array, max_bytes: int = 1 << 20, max_rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, one past the last, bytes, offsets) of groups of whole rows."""
    col = byte_column(col)
    if not len(col):
        return
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(col):
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1
        j = min(max(i + 1, j), i + max_rows, len(col))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def hashed_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each word."""
    rows, starts, ends = word_bounds(data, offsets, kind)
    return rows, word_hashes(_LOWER[data] if lower else data, starts, ends)


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def local_file(uri: str) -> str | None:
    """The path behind a file: URI, None for any other store."""
    found = re.match(r"(?:file:/*)?(/[^:]*)$", uri)
    return "/" + found[1].lstrip("/") if found else None
