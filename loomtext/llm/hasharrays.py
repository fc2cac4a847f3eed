"""Sorted hash arrays in shared storage, memory-mapped by the workers that read them.

A table is cut into files by the top of its 64-bit keys; each file holds the sorted
keys and then one array for each value column. Files in a store that isn't mounted
are fetched once by each worker into an unlinked temporary file.
"""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, local_file, shared_path

FILE_ROWS = 1 << 20


def _place(keys: np.ndarray, files: int) -> np.ndarray:
    return ((keys.astype(U64) >> U64(32)) * U64(files) >> U64(32)).astype(np.int64)


def save_file(path: str, blob: bytes) -> None:
    """Under a name of this attempt's own first, so that a repeated task does no harm."""
    local, own = local_file(path), f"{path}.{uuid.uuid4().hex}"
    if local:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        own = local_file(own)
        with open(own, "wb") as f:
            f.write(blob)
        os.replace(own, local)
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(name), recursive=True)
    temp = f"{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temp) as f:
        f.write(blob)
    store.move(temp, name)


def map_file(path: str) -> np.ndarray | None:
    """The file's bytes, memory-mapped; None where there is no such file."""
    local = local_file(path)
    if local:
        return np.asarray(np.memmap(local, np.uint8, "r")) if os.path.exists(local) else None
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    if store.get_file_info(name).type == fs.FileType.NotFound:
        return None
    with tempfile.TemporaryFile() as held:
        with store.open_input_stream(name) as f:
            while block := f.read(1 << 24):
                held.write(block)
        held.flush()
        return np.frombuffer(mmap.mmap(held.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)


class HashArrays:
    """Where a table's files are: (path, rows) by file number, and its value types."""

    def __init__(self, folder: str, files: int, paths: dict[int, tuple[str, int]], types: list[tuple[str, str]]):
        self.folder, self.files, self.paths, self.types, self._open = folder, files, paths, types, {}
        rows = [paths[n][1] if n in paths else 0 for n in range(files)]
        self._before = np.append(0, np.cumsum(rows)).astype(np.int64)

    def __getstate__(self):
        return self.folder, self.files, self.paths, self.types

    def __setstate__(self, state):
        self.__init__(*state)

    def _columns(self, n: int) -> tuple[np.ndarray, ...]:
        if n not in self._open:
            path, rows = self.paths[n]
            raw, at, out = map_file(path), 0, []
            for kind in (U64, *(np.dtype(t) for _, t in self.types)):
                size = rows * np.dtype(kind).itemsize
                out.append(raw[at : at + size].view(kind))
                at += size
            self._open[n] = tuple(out)
        return self._open[n]

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """The place of each of the sorted keys among all of the table's."""
        out = np.zeros(len(keys), np.int64)
        cuts = np.searchsorted(_place(keys, self.files), np.arange(self.files + 1))
        for n in self.paths:
            a, b = cuts[n], cuts[n + 1]
            if a < b:
                out[a:b] = self._before[n] + np.searchsorted(self._columns(n)[0], keys[a:b])
        return out

    def find(self, keys: np.ndarray) -> list[np.ndarray]:
        """The value columns for sorted keys; 0 where a key isn't there."""
        out = [np.zeros(len(keys), t) for _, t in self.types]
        cuts = np.searchsorted(_place(keys, self.files), np.arange(self.files + 1))
        for n in self.paths:
            a, b = cuts[n], cuts[n + 1]
            if a == b:
                continue
            own, *values = self._columns(n)
            at = np.minimum(np.searchsorted(own, keys[a:b]), len(own) - 1)
            hit = own[at] == keys[a:b]
            for target, value in zip(out, values, strict=True):
                target[a:b][hit] = value[at[hit]]
        return out


def write_arrays(df: DataFrame, label: str, types: list[tuple[str, str]]) -> HashArrays:
    """Write ``df`` (key long, distinct, and the columns of ``types``) as sorted files."""
    spark, folder, names = df.sparkSession, shared_path(df.sparkSession, label), [n for n, _ in types]
    files = max(1, -(-df.count() // FILE_ROWS))

    def save(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["file"].iloc[0])
        keys = rows["key"].to_numpy().view(U64)
        order = np.argsort(keys)
        path = f"{folder}/{n:06d}.bin"
        save_file(path, b"".join([keys[order].tobytes(), *[rows[k].to_numpy()[order].astype(t).tobytes() for k, t in types]]))
        return pd.DataFrame({"file": [n], "path": [path], "rows": [len(rows)]})

    top = F.shiftrightunsigned("key", 32)
    placed = df.select("key", *names, F.shiftright(top * files, 32).cast("int").alias("file"))
    found = placed.groupBy("file").applyInPandas(save, "file int, path string, rows long").collect()  # one row a file
    return HashArrays(folder, files, {r["file"]: (r["path"], r["rows"]) for r in found}, types)
