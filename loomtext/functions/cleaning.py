"""Text cleaning as column expressions, for any text column.

White space and word characters are those of Unicode. Null is an empty text; nothing
here looks at more than one row. Only the decoding of all entities leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons
from .matching import quoted
from .text import html_unescape, named_entities

_URL = r"(?i)(?:https?://|www\.|(?:[A-Za-z0-9-]+\.)+(?:com|cn|net|org|edu|gov|io)/)[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%+\-]+"
_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
_MARKUP = r"</?[A-Za-z][A-Za-z0-9]*(?:(?U)\s+[^<>]*?)?(?U)\s*/?>"
_INVISIBLE = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{feff}\x00]"


def text_of(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def without(c: Column, *patterns: str, by: str = " ") -> Column:
    return reduce(lambda text, p: F.regexp_replace(text, F.lit(p), F.lit(by)), patterns, c)


def squeezed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(without(c, r"(?U)\s+"))


def stripped(c: Column | str) -> Column:
    """Null as blank, no white space at the ends."""
    return F.regexp_replace(text_of(c), F.lit(r"(?U)^\s+|\s+$"), F.lit(""))


def clean_html(c: Column | str, entities: Sequence[str] | None = None) -> Column:
    """Entities decoded first, so markup written as entities goes too; then scripts, styles,
    tags, addresses and spare white space. All entities are decoded, those without a semicolon
    too, or only the names given in ``entities`` with one."""
    plain = html_unescape(text_of(c)) if entities is None else named_entities(text_of(c), entities)
    bare = without(plain, r"(?is)<script.*?>.*?</script>", r"(?is)<style.*?>.*?</style>", "<[^>]+>", r"(?U)https?://\S+")
    return squeezed(bare)


def strip_tags(c: Column | str) -> Column:
    return squeezed(without(text_of(c), "<[^>]+>"))


def remove_footers(c: Column | str, patterns: Sequence[str] = lexicons.FOOTERS) -> Column:
    """Each pattern in turn, in any case, with its bounded tail (never past a line's end)."""
    return squeezed(without(text_of(c), *(f"(?i){p}" for p in patterns)))


def duplicate_key(c: Column | str, marks: str = lexicons.MARKS) -> Column:
    """The text in lower case without white space and punctuation."""
    return F.lower(without(text_of(c), r"(?U)\s+", f"[{quoted(marks)}]", by=""))


def clean_web_text(c: Column | str) -> Column:
    """Han, Latin letters and digits alone, in runs with one space between."""
    return squeezed(without(text_of(c), r"(?U)https?://\S+|www\.\S+", "<[^>]+>", r"[^\x{4e00}-\x{9fff}A-Za-z0-9]"))


def is_error_value(c: Column | str) -> Column:
    return F.upper(stripped(c)).isin(*lexicons.ERROR_VALUES)


def clean_formatting(c: Column | str, on_error: str = "raise") -> Column:
    """Links, addresses, markup, labels and invisible characters removed, tags between two
    hash marks unwrapped. A spreadsheet's error value fails the query, or (``on_error`` =
    'null') gives null."""
    text = without(html_unescape(text_of(c)), f"(?s){lexicons.TRAILER}(?U)\\s*\\|.*$", by="")
    text = without(text, quoted(lexicons.ARTICLE_LABEL), _URL, _EMAIL, _MARKUP)
    text = without(F.regexp_replace(text, F.lit("#([^#]+)#"), F.lit(" $1 ")), "|".join(map(quoted, lexicons.UI_LABELS)))
    text = squeezed(without(text, _INVISIBLE, by=""))
    wrong = F.raise_error(F.lit("an error value of a spreadsheet stands for a text")).cast("string") if on_error == "raise" else F.lit(None).cast("string")
    return F.when(is_error_value(c), wrong).otherwise(text)


def clean_post(c: Column | str, hashes: str = " ") -> Column:
    """A social post without addresses, mentions and video labels; hash marks become ``hashes``
    ('#' keeps them)."""
    text = without(text_of(c), r"(?U)https?://\S+", "网页链接", r"(?U)L[\w\x{4e00}-\x{9fff}]+的微博视频", r"(?U)@[\w\x{4e00}-\x{9fff}\-]+")
    return squeezed(F.replace(text, F.lit("#"), F.lit(hashes)))


def script_only(c: Column | str, script: str = "Han") -> Column:
    """The characters of one script, in order."""
    return without(text_of(c), rf"\P{{Is{script}}}+", by="")


def mainly(c: Column | str, letters: str = r"[\x{3400}-\x{9fff}]", least: int = 200, share: float = 0.6) -> Column:
    """Whether a text has at least ``least`` of the letters, and they are ``share`` of them and the Latin ones."""
    own, latin = F.regexp_count(text_of(c), F.lit(letters)), F.regexp_count(text_of(c), F.lit("[A-Za-z]"))
    return (own >= least) & (own / F.greatest(own + latin, F.lit(1)) >= share)


def other_letter(c: Column | str) -> Column:
    """The first letter that is neither Han nor Latin; blank if there is none."""
    return F.regexp_extract(text_of(c), r"(?=\p{L})[^\p{IsHan}\p{IsLatin}]", 0)


def has_kana(c: Column | str) -> Column:
    return F.regexp_like(text_of(c), F.lit(r"[\x{3040}-\x{30ff}\x{31f0}-\x{31ff}\x{ff66}-\x{ff9f}]"))


def normalised_label(c: Column | str) -> Column:
    """1, 0 or -1 in any of their spellings; null for undecided and not relevant."""
    text = stripped(c)
    return F.when(text.isin("1", "1.0", "+1"), 1).when(text.isin("-1", "-1.0"), -1).when(text.isin("0", "0.0"), 0)


def keyword_list(c: Column | str, separator: str = ";", by: str = "|", missing: Sequence[str] = ("", "nan", "none", "null")) -> Column:
    """A delimited list with stripped, distinct items in their order, without missing ones."""
    items = F.transform(F.split(text_of(c), quoted(separator)), stripped)
    return F.array_join(F.array_distinct(F.filter(items, lambda w: ~F.lower(w).isin(*missing))), by)
