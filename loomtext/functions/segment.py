"""Dictionary segmentation of Han text: the best path through the words a text can hold.

Every run of Han characters is cut so that the product of its words' relative frequencies
is largest; characters that no word covers stand alone. Runs of Latin letters and digits
are words, each other character is one. Forced phrases enter the dictionary with a count
that outweighs their parts. A text is cut by itself, in Arrow batches; only the dictionary,
whose size is the caller's, is broadcast.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLOCK = re.compile(r"\s+|\S+")
_PIECE = re.compile(r"[一-鿿]+|[A-Za-z0-9]+(?:[.%][A-Za-z0-9]+)*%?|\S|\s+")
#: Count of a forced phrase.
FORCED = 100_000
#: Cuts that a worker remembers, of blocks of so many characters at most; no result depends on them.
REMEMBERED, SHORT = 100_000, 64


class Segmenter:
    def __init__(self, counts: Mapping[str, int], forced: Iterable[str] = ()):
        words = dict(counts) | {w: max(FORCED, counts.get(w, 0)) for w in forced}
        self.longest = max(map(len, words), default=1)
        total = math.log(max(sum(words.values()), 1))
        self.cost = {w: total - math.log(n) for w, n in words.items() if n > 0}
        self.alone = total + 1.0
        self.odd = {w for w in words if w and not re.fullmatch(r"[一-鿿]+", w)}
        lengths: dict[str, set[int]] = {}
        heads: dict[str, set[str]] = {}
        for w in self.odd:
            lengths.setdefault(w[:1], set()).add(len(w))
            head = _BLOCK.match(w)[0]
            if head != w:
                heads.setdefault(head[-1], set()).add(head)
        self.lengths = {c: sorted(n, reverse=True) for c, n in lengths.items()}
        self.heads = {c: tuple(sorted(h)) for c, h in heads.items()}
        self.known: dict[str, list[str]] = {}

    def cut(self, text: str) -> list[str]:
        """Blocks (white space, or none) are cut alone, as often as they come but once, unless a
        word may go on beyond the block's end."""
        out: list[str] = []
        at = 0
        while at < len(text):
            block = _BLOCK.match(text, at)[0]
            if block.endswith(self.heads.get(block[-1], ())):
                end, words = self._piece(text, at)
                out += words
                at = end
                continue
            words = self.known.get(block)
            if words is None:
                words, i = [], 0
                while i < len(block):
                    i, more = self._piece(block, i)
                    words += more
                if len(block) <= SHORT:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    self.known[block] = words
            out += words
            at += len(block)
        return out

    def _piece(self, text: str, at: int) -> tuple[int, list[str]]:
        """The end of the piece at a place, and its words: the longest word of the dictionary that
        isn't all Han, or else a run."""
        for n in self.lengths.get(text[at], ()):
            word = text[at : at + n]
            if word in self.odd:
                return at + len(word), [word]
        run = _PIECE.match(text, at)[0]
        return at + len(run), self._path(run) if "一" <= run[0] <= "鿿" else [run]

    def _path(self, run: str) -> list[str]:
        """Shortest path from the run's end; of equal ones the longer first word wins."""
        n = len(run)
        best: list[tuple[float, int]] = [(0.0, n)] * (n + 1)
        for i in range(n - 1, -1, -1):
            choice = (self.cost.get(run[i], self.alone) + best[i + 1][0], i + 1)
            for j in range(i + 2, min(n, i + self.longest) + 1):
                cost = self.cost.get(run[i:j])
                if cost is not None and cost + best[j][0] <= choice[0]:
                    choice = (cost + best[j][0], j)
            best[i] = choice
        out, at = [], 0
        while at < n:
            out.append(run[at : best[at][1]])
            at = best[at][1]
        return out


def segmented(df: DataFrame, text: str, counts: Mapping[str, int], forced: Iterable[str] = (), name: str = "words") -> DataFrame:
    """df with the words of a text column; null has none."""
    shared = df.sparkSession.sparkContext.broadcast((dict(counts), list(forced)))
    at, names = df.columns.index(text), [*df.columns, name]

    def scan(batches):
        cutter = Segmenter(*shared.value)
        for batch in batches:
            words = [cutter.cut(t or "") for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.list_(pa.string()))], names)

    return df.mapInArrow(scan, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.StringType()))]))


# What a token is, and the forms that are none.
VALID, NUMBER = r"^[\x{4e00}-\x{9fff}A-Za-z0-9.%]+$", r"^\d+(?:\.\d+)?(?:%|[wk])?$"
FORMAT, REPEATED = r"^(?:p\d+|jpe?g|png|gif|webp|h{2,}|em{2,})$", r"^([\x{4e00}-\x{9fff}])\1{2,}$"


def kept_tokens(words: Column, stopwords: Iterable[str] = (), singles: Iterable[str] = ()) -> Column:
    """The words in lower case that are no stopwords, format names, numbers, odd symbols,
    single characters (but ``singles``) or one character over and over."""
    lowered = F.transform(words, lambda w: F.lower(F.trim(w)))
    stop, single = list(stopwords), list(singles)

    def good(w):
        out = F.regexp_like(w, F.lit(VALID)) & ~F.regexp_like(w, F.lit(FORMAT)) & ~F.regexp_like(w, F.lit(NUMBER)) & ~F.regexp_like(w, F.lit(REPEATED))
        out = out & ((F.length(w) > 1) | (w.isin(single) if single else F.lit(False)))
        return out & ~w.isin(stop) if stop else out

    return F.filter(lowered, good)


def analysed(df: DataFrame, text: str, counts: Mapping[str, int], title: str | None = None, forced: Iterable[str] = (), stopwords: Iterable[str] = (), singles: Iterable[str] = ()) -> DataFrame:
    """df with analysis_text (the title first, if there is one), tokens (joined by spaces) and token_count."""
    from .cleaning import clean_formatting, stripped, text_of

    body = F.concat(stripped(title), F.lit("。"), text_of(text)) if title else text_of(text)
    cut = segmented(df.withColumn("analysis_text", clean_formatting(body)), "analysis_text", counts, forced, "_words")
    kept = kept_tokens(F.col("_words"), stopwords, singles)
    return cut.withColumn("_kept", kept).select(*df.columns, "analysis_text", F.array_join("_kept", " ").alias("tokens"), F.size("_kept").alias("token_count"))
