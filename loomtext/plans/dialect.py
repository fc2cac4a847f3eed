"""SQL in two spellings: Spark's, which runs, and the portable one of the checks."""

from __future__ import annotations

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Portable:
    def t(self, name: str) -> str:
        return name

    def lit(self, pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def all_of(self, text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, {self.lit(pattern)})"

    def has(self, text: str, pattern: str) -> str:
        return f"regexp_matches({text}, {self.lit(pattern)})"

    def sub(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, {self.lit(pattern)}, '{by}', 'g')"

    def first(self, text: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({text}, {self.lit(pattern)}, {group})"

    def each(self, array: str) -> str:
        return f"unnest({array})"

    def size(self, array: str) -> str:
        return f"len({array})"

    def ties(self, order: str, key: str) -> str:
        """Equal rows in the order of a key where Spark runs; the portable order leaves them open."""
        return order

    def quantile(self, x: str, q: float) -> str:
        return f"quantile_cont({x}, {q})"

    def unique(self, array: str) -> str:
        return f"list_distinct({array})"

    def spread(self, low: str, high: str) -> str:
        """Integers from low to high, both included."""
        return f"range({low}, {high} + 1)"

    def part(self, array: str, start: str, n: str) -> str:
        return f"{array}[{start}:{start} + {n} - 1]"

    def text(self, array: str, sep: str) -> str:
        return f"array_to_string({array}, '{sep}')"

    def split(self, text: str, sep: str) -> str:
        return f"string_split({text}, '{sep}')"

    def gathered(self, x: str) -> str:
        return f"list_sort(list(DISTINCT {x}))"

    def json(self, text: str, key: str) -> str:
        return f"json_extract_string({text}, '$.{key}')"

    def stamp(self, ts: str, fmt: str) -> str:
        return f"strftime({ts}, '{dict(month='%Y-%m', day='%Y-%m-%d')[fmt]}')"

    def letters(self, text: str = "text") -> str:
        return self.all_of(f"lower({text})", r"\p{L}+")

    def words(self, where: str = "true") -> str:
        """A subquery with one row a word: doc_id, lang, source, w."""
        return f"(SELECT doc_id, lang, source, {self.each(self.letters())} AS w FROM {self.t('documents')} WHERE {where})"


class Spark(Portable):
    def t(self, name: str) -> str:
        return f"loomtext_{name}"

    def lit(self, pattern: str) -> str:
        return "r'" + pattern + "'"

    def all_of(self, text, pattern):
        return f"regexp_extract_all({text}, {self.lit(pattern)}, 0)"

    def has(self, text, pattern):
        return f"regexp_like({text}, {self.lit(pattern)})"

    def sub(self, text, pattern, by):
        return f"regexp_replace({text}, {self.lit(pattern)}, '{by}')"

    def each(self, array):
        return f"explode({array})"

    def size(self, array):
        return f"size({array})"

    def ties(self, order, key):
        return f"{order}, {key}"

    def quantile(self, x, q):
        return f"percentile({x}, {q})"

    def unique(self, array):
        return f"array_distinct({array})"

    def spread(self, low, high):
        return f"CASE WHEN {high} >= {low} THEN sequence({low}, {high}) ELSE array() END"

    def part(self, array, start, n):
        return f"slice({array}, {start}, {n})"

    def text(self, array, sep):
        return f"array_join({array}, '{sep}')"

    def split(self, text, sep):
        return f"split({text}, r'\\Q{sep}\\E')"

    def gathered(self, x):
        return f"array_sort(collect_set({x}))"

    def json(self, text, key):
        return f"get_json_object({text}, '$.{key}')"

    def stamp(self, ts, fmt):
        return f"date_format({ts}, '{dict(month='yyyy-MM', day='yyyy-MM-dd')[fmt]}')"
