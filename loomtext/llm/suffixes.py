"""Passages that repeat across documents, by sparse suffix arrays (operator 2).

Of the suffixes of all texts (in words), only those that start at a minimiser stay:
the position of the least KGRAM-word hash in some window of WINDOW such positions.
Equal content selects equal positions, so any two copies of KGRAM + WINDOW - 1 words
hold a common one. Suffixes whose first k-gram occurs in one document alone are
dropped; the rest are range-sorted, split anywhere (a hot passage too), and compared
with the neighbours that belong to other documents. Each match is then extended to
the right and to the left; one of LEAST words or more is a repeat, and the repeats of
successive minimisers merge into whole passages. Neighbours suffice for rows whose whole
context stands in another document. For a k-gram with several contexts, each LEAST words
around it are also compared by grouping on their left and right parts, so what is found
doesn't depend on the order of the sort or on the number of neighbours.

Neighbours at a range's edge are handed over to the range beside it. A row holds no
more context than lies between minimisers, so rows stay small however long texts are.

Cases: null and short texts have no repeats; repeats within one document, or among
rows that share its id, don't count; rows with a null id are left out; equal rows are
copies of one passage, in whatever order they come; a text of any length is hashed whole,
in memory proportional to it; an empty table gives an empty result; documents without
repeats give no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _INVERSE, _POWERS, ALNUM, U64, hashed_words, join_keys, materialise, mix, remove, row_chunks

KGRAM, WINDOW, LEAST = 26, 25, 50
#: Suffix rows for each range of the sort.
RANGE_ROWS = 150_000
#: Neighbours compared on each side; more give more partners, not more passages.
NEAR = 4

_PART = 1 << 18


def kgram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i : i + k] for each i, from prefix sums over slices."""
    n = len(words) - k + 1
    out = np.empty(max(n, 0), U64)
    for i in range(0, max(n, 0), _PART):
        part = words[i : i + _PART + k - 1]
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(part * _POWERS[: len(part)], out=sums[1:])
        m = len(part) - k + 1
        out[i : i + m] = mix((sums[k:] - sums[:-k]) * _INVERSE[:m])
    return out


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """min(values[i : i + w]) for each i, by doubling."""
    size, out = 1, values
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(out) - (w - size)], out[w - size :]) if w > size else out


def minimisers(rows: np.ndarray, words: np.ndarray, k: int = KGRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Word index (over all rows) and k-gram hash of each selected position."""
    if len(words) < k + w - 1:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    hashes = kgram_hashes(words, k)
    place = np.arange(len(hashes), dtype=U64)
    low = U64((1 << 24) - 1)
    picked = []
    for i in range(0, len(hashes) - w + 1, 1 << 23):  # the position has 24 bits
        part = hashes[i : i + (1 << 23) + w - 1]
        least = window_minima((part & ~low) | (low - place[: len(part)]), w)
        whole = rows[i : i + len(least)] == rows[i + k + w - 2 : i + k + w - 2 + len(least)]
        picked.append((low - (least[whole] & low)).astype(np.int64) + i)
    at = np.unique(np.concatenate(picked))
    return at, hashes[at]


def selected(docs: DataFrame) -> DataFrame:
    """(doc, gram, places): a document's minimisers by k-gram, so that a line which it
    repeats a thousand times is one row."""

    def scan(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in row_chunks(batch.column(1)):
                rows, words = hashed_words(data, offsets, ALNUM)
                at, grams = minimisers(rows, words)
                first = np.searchsorted(rows, np.arange(j - i))
                order = np.lexsort((grams, rows[at]))
                at, grams = at[order], grams[order]
                own = rows[at]
                new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (grams[1:] != grams[:-1]))) if len(at) else np.zeros(0, np.int64)
                places = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)).astype(np.int32)), pa.array((at - first[own]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][own[new]]), pa.array(grams[new].view(np.int64)), places], ["doc", "gram", "places"])

    return docs.select("doc", "text").mapInArrow(scan, "doc long, gram long, places array<int>")


#: at: the places in the document that share all of the rest.
SUFFIX = "gram long, right binary, left binary, doc long, at array<int>"
SIDE = (LEAST - KGRAM) * 4


def _context(short: np.ndarray, at: int, n: int) -> tuple[bytes, bytes]:
    """The words after a k-gram, and those before it in reverse, as 4-byte hashes."""
    right = short[at + KGRAM : min(n, at + LEAST)]
    left = short[max(0, at - LEAST + KGRAM) : at][::-1]
    return right.tobytes(), left.tobytes()


def suffixes(docs: DataFrame) -> DataFrame:
    """SUFFIX rows of the documents (doc, text, places)."""

    def scan(batches):
        for batch in batches:
            ids, places = batch.column(0).to_pylist(), batch.column(2)
            for i, _, data, offsets in row_chunks(batch.column(1), max_rows=1):
                _, words = hashed_words(data, offsets, ALNUM)
                at = np.sort(places[i].values.to_numpy())
                at = at[at + KGRAM <= len(words)]
                grams = kgram_hashes(words, KGRAM)[at].view(np.int64)
                short = (words >> U64(32)).astype(">u4")
                found: dict = {}
                for a, gram in zip(at.tolist(), grams.tolist(), strict=True):
                    found.setdefault((gram, *_context(short, a, len(words))), []).append(a)
                columns = list(zip(*found, strict=True)) or [()] * 3
                kinds = (pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], pa.array([ids[i]] * len(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int32()))],
                    ["gram", "right", "left", "doc", "at"],
                )

    return docs.select("doc", "text", "places").mapInArrow(scan, SUFFIX)


class Suffixes:
    """Columns of sorted suffix rows."""

    def __init__(self, gram, right, left, doc, at):
        self.gram, self.right, self.left, self.doc, self.at = gram, right, left, doc, at

    @classmethod
    def read(cls, batch: pa.RecordBatch) -> Suffixes:
        col = lambda k: batch.column(batch.schema.get_field_index(k))
        side = lambda k: np.frombuffer(b"".join(x.ljust(SIDE + 4, b"\0") for x in col(k).to_pylist()), np.uint32).reshape(-1, SIDE // 4 + 1).copy()
        return cls(col("gram").to_numpy(), cls._ended(side("right"), col("right")), cls._ended(side("left"), col("left")), col("doc").to_numpy(), cls._lists(col("at").to_pylist()))

    @staticmethod
    def _lists(values: list) -> np.ndarray:
        out = np.empty(len(values), object)
        out[:] = values
        return out

    @staticmethod
    def _ended(words: np.ndarray, col: pa.Array) -> np.ndarray:
        """The last column holds the row's length, since a text may end within."""
        words[:, -1] = [len(x) // 4 for x in col.to_pylist()]
        return words

    def take(self, at) -> Suffixes:
        return Suffixes(self.gram[at], self.right[at], self.left[at], self.doc[at], self.at[at])

    def join(self, other: Suffixes) -> Suffixes:
        return Suffixes(*(np.concatenate(x) for x in zip(vars(self).values(), vars(other).values(), strict=True)))

    def runs(self) -> np.ndarray:
        """First index of each run of rows of one k-gram and document."""
        return np.flatnonzero(np.append(True, (self.gram[1:] != self.gram[:-1]) | (self.doc[1:] != self.doc[:-1])))

    def edge(self, last: bool) -> Suffixes:
        """The rows that a neighbouring part can need: the nearest of each of NEAR runs."""
        first = self.runs()
        return self.take(np.append(first[1:], len(self.doc))[-NEAR - 1 :] - 1 if last else first[: NEAR + 1])


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each pair of rows."""
    size = np.minimum(a[:, -1], b[:, -1])
    differ = a[:, :-1] != b[:, :-1]
    found = np.where(differ.any(1), differ.argmax(1), differ.shape[1])
    return np.minimum(found, size).astype(np.int64)


def matches(s: Suffixes, fresh: int = 0) -> tuple[np.ndarray, ...]:
    """(doc, start, end, other) of each row's repeats with near rows of different
    documents; of each pair, one row at least has index ``fresh`` or more."""
    n, first = len(s.doc), s.runs()
    run = np.searchsorted(first, np.arange(n), side="right") - 1
    out = []
    for back in range(1, NEAR + 1):
        for j in (first[run] - back, np.append(first[1:], n)[run] - 1 + back):
            i = np.flatnonzero((j >= 0) & (j < n))
            j = j[i]
            good = (s.gram[i] == s.gram[j]) & (s.doc[i] != s.doc[j]) & (np.maximum(i, j) >= fresh)
            i, j = i[good], j[good]
            right, left = _common(s.right[i], s.right[j]), _common(s.left[i], s.left[j])
            long = KGRAM + right + left >= LEAST
            i, j, right, left = i[long], j[long], right[long], left[long]
            out.append((i, left, right, s.doc[j]))
    x, left, right, other = (np.concatenate(c) for c in zip(*out, strict=True))
    _, once = np.unique((x * LEAST + left) * LEAST + right, return_index=True)  # one partner for each extent
    x, left, right, other = x[once], left[once], right[once], other[once]
    row, start, size = [], [], []
    for n, (places, back, width) in enumerate(zip(s.at[x], left.tolist(), (KGRAM + left + right).tolist(), strict=True)):
        for a, b in _joined(places, width):
            row.append(n)
            start.append(a - back)
            size.append(b - a)
    row, start, size = (np.array(c, np.int64) for c in (row, start, size))
    return s.doc[x[row]], start, start + size, other[row]


def _joined(places: list[int], width: int):
    """Spans of ``width`` at sorted places, those that touch joined."""
    begin = end = None
    for at in places:
        if end is not None and at <= end:
            end = at + width
            continue
        if end is not None:
            yield begin, end
        begin, end = at, at + width
    if end is not None:
        yield begin, end


FOUND = "part int, head boolean, turn int, gram long, right binary, left binary, doc long, at array<int>, start long, end long, other long"
_TYPES = [pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64()]
_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in zip(_NAMES, _TYPES, strict=True)], _NAMES)


def _match_rows(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return _rows(len(found[0]), doc=found[0], start=found[1], end=found[2], other=found[3])


def _edge_rows(s: Suffixes, part: int, head: bool) -> pa.RecordBatch:
    n = len(s.doc)
    side = lambda x: [row[: row[-1]].tobytes() for row in x]
    return _rows(n, part=[part] * n, head=[head] * n, turn=list(range(n)), gram=s.gram, right=side(s.right), left=side(s.left), doc=s.doc, at=s.at.tolist())


def _compared(batches):
    """Repeats within one sorted range, and the range's edges."""
    tail, part, head = None, TaskContext.get().partitionId(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = Suffixes.read(batch)
        if head is None or len(head.runs()) <= NEAR:
            head = rows.edge(False) if head is None else head.join(rows.edge(False)).edge(False)
        held = 0 if tail is None else len(tail.doc)
        rows = rows if tail is None else tail.join(rows)
        yield _match_rows(matches(rows, held))
        tail = rows.edge(True)
    if tail is not None:
        yield _edge_rows(head, part, True)
        yield _edge_rows(tail, part, False)


def _across(rows):
    """Repeats between the end of one range and the beginning of the next."""
    rows = rows.sort_values(["head", "turn"])
    batch = pa.RecordBatch.from_pandas(rows[["gram", "right", "left", "doc", "at"]], schema=pa.schema([("gram", pa.int64()), ("right", pa.binary()), ("left", pa.binary()), ("doc", pa.int64()), ("at", pa.list_(pa.int32()))]), preserve_index=False)
    return _match_rows(matches(Suffixes.read(batch))).select(["doc", "start", "end", "other"]).to_pandas()


def windows(sparse: DataFrame) -> DataFrame:
    """doc, start, end, other: the repeats of contexts that one document alone has. Each
    LEAST words around a k-gram are a left and a right part of its context; they repeat
    if the least and the greatest document that hold both parts differ."""
    sided = sparse.withColumn("side", F.xxhash64("right", "left"))
    several = sided.groupBy("gram").agg(F.min("side").alias("low"), F.max("side").alias("high"), F.count(F.lit(1)).alias("n"))
    several = materialise(several.where("low <> high").select("gram", "n"), "several")
    rows = materialise(join_keys(sided, several, "gram", "n").drop("n"), "contexts")
    extents = materialise(rows.groupBy("gram", "side").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.first("right").alias("right"), F.first("left").alias("left")), "extents")
    span = LEAST - KGRAM
    back = F.expr(f"explode(filter(sequence(0, {span}), n -> 4 * n <= length(left) AND 4 * ({span} - n) <= length(right)))").alias("back")
    part = F.expr(f"xxhash64(back, substring(left, 1, 4 * back), substring(right, 1, 4 * ({span} - back)))").alias("part")
    keyed = extents.select("*", back).select("gram", "side", "low", "high", "back", part)
    one = F.count(F.when(F.col("low") == F.col("high"), 1)).alias("n")
    shared = keyed.groupBy("gram", "part").agg(F.min("low").alias("least"), F.max("high").alias("greatest"), one)
    shared = materialise(shared.where("least <> greatest AND n > 0"), "shared")
    alone = join_keys(keyed.where("low = high").select("gram", "side", F.col("low").alias("doc"), "back", "part"), shared, ["gram", "part"], "n")
    other = F.when(F.col("least") < F.col("doc"), F.col("least")).otherwise(F.col("greatest"))
    hits = alone.groupBy("gram", "side", "doc").agg(F.collect_set("back").alias("backs"), F.min(other).alias("other"))  # LEAST - KGRAM + 1 at most
    ends = lambda step: F.expr(f"array_sort(filter(backs, n -> NOT array_contains(backs, n + {step})))")
    runs = F.explode(F.arrays_zip(ends(-1).alias("first"), ends(1).alias("last"))).alias("run")
    found = rows.select("gram", "side", "doc", "at").join(hits, ["gram", "side", "doc"]).select("doc", "at", "other", runs)
    found = found.select("doc", F.explode("at").alias("place"), "other", "run")
    out = materialise(found.select("doc", (F.col("place") - F.col("run.last")).cast("long").alias("start"), (F.col("place") - F.col("run.first") + LEAST).cast("long").alias("end"), "other"), "windows")
    for used in (rows, extents, several, shared):
        remove(used)
    return out


def repeats(docs: DataFrame) -> DataFrame:
    """doc, start, end (in words, end exclusive), other: matches with suffix neighbours
    and, for contexts of one document alone, with any document."""
    spark = docs.sparkSession
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), "text")
    grams = materialise(selected(docs), "minimisers")
    shared = grams.groupBy("gram").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count(F.lit(1)).alias("n"))
    shared = materialise(shared.where("low <> high").select("gram", "n"), "shared")
    held = join_keys(grams, shared, "gram", "n")
    places = held.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))  # no more than the text has words
    sparse = materialise(suffixes(docs.join(places, "doc")), "suffixes")
    remove(grams)
    remove(shared)
    count = sparse.count()
    order = ["gram", "right", "left", "doc", "at"]
    ranges = max(1, -(-count // RANGE_ROWS), min(spark.sparkContext.defaultParallelism, -(-count // 5000)))
    ordered = sparse.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    found = materialise(ordered.mapInArrow(_compared, FOUND), "repeats")
    apart = windows(sparse)
    remove(sparse)
    edges = found.where("part IS NOT NULL")
    # One row for each range: the sort in one task is of these alone.
    turn = edges.select("part").distinct().withColumn("place", F.row_number().over(Window.orderBy("part")))
    between = edges.join(turn, "part").withColumn("border", F.when(F.col("head"), F.col("place") - 1).otherwise(F.col("place")))
    handed = between.groupBy("border").applyInPandas(_across, "doc long, start long, end long, other long")
    return found.where("part IS NULL").select("doc", "start", "end", "other").unionByName(handed).unionByName(apart)


def _merged(spans: DataFrame) -> DataFrame:
    """The sorted spans of each document, those that touch joined."""
    shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        for batch in batches:
            out = []
            for spans in batch.column(2).to_pylist():
                done: list[dict] = []
                for span in spans:
                    if done and span["start"] <= done[-1]["end"]:
                        done[-1]["end"] = max(done[-1]["end"], span["end"])
                    else:
                        done.append(span)
                out.append(done)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, shape)], ["doc", "partners", "passages"])

    return spans.select("doc", "partners", "spans").mapInArrow(scan, "doc long, partners array<long>, passages array<struct<start:long,end:long>>")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_passages, n_words (in repeats), passages (start:end in words, comma-
    joined) and partners (the neighbouring documents that share one) of each document
    that repeats LEAST words or more of another."""
    spans = repeats(docs).groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"), F.sort_array(F.collect_set("other")).alias("partners"))
    return _merged(spans).select(
        F.col("doc").alias("doc_id"),
        F.size("passages").cast("long").alias("n_passages"),
        F.aggregate("passages", F.lit(0).cast("long"), lambda n, p: n + p["end"] - p["start"]).alias("n_words"),
        F.array_join(F.transform("passages", lambda p: F.concat_ws(":", p["start"].cast("string"), p["end"].cast("string"))), ",").alias("passages"),
        "partners",
    )
