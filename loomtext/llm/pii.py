"""Personal data: patterns propose, checksums confirm, context adjusts (operator 8).

Kinds, in the order in which spans are listed: email, ip, card, phone, iban, ssn,
passport, account, secret. The first four are the base kinds, proposed by fixed patterns
and confirmed by their checks (ip: parts to 255; card: Luhn; phone: digit count). The
others are the method's own: iban has its country's length and the mod-97 remainder, ssn
the ranges that are issued, secret a mix of letters and digits. A span's score starts
from the strength of its check, rises where a word of its kind stands within REACH
characters before or after it, and falls where a word stands that speaks for another
meaning. The method's spans are kept from a score of ENOUGH, so those whose pattern is
weak need their context; they give way to spans of stronger kinds that they overlap.
Base spans stay at any score.

Matches are leftmost and do not overlap within a kind; a base match that fails its check
is dropped whole. Offsets count code points, end exclusive. Cases: null and empty
texts have no spans; repeated rows are separate; a text of any length is scanned whole;
an empty table gives an empty result; other columns are ignored (and kept by the mask).
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trim

# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: IP's matches, since none starts inside a run of digits; a long run is tried once only.
IP_SCAN = re.compile(r"(?<![0-9])" + IP.pattern)
IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?=\x20?[A-Z0-9])")
SSN = re.compile(r"(?<![0-9A-Za-z-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9A-Za-z-])")
PASSPORT = re.compile(r"(?<![0-9A-Za-z])[A-Z]{1,2}[0-9]{6,9}(?![0-9A-Za-z])")
ACCOUNT = re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{8,12}(?![0-9A-Za-z]|[.-][0-9])")
SECRET = re.compile(r"(?<![0-9A-Za-z_/+-])[0-9A-Za-z_+/-]{20,200}(?![0-9A-Za-z_/+-])")
DIGIT = re.compile(r"[0-9]")

# The length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
COUNTRY = {c: n for n, codes in IBAN_LENGTHS.items() for c in codes.split()}

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "passport", "account", "secret")
BASE_KINDS = KINDS[:4]
#: Strength of the check alone, before any context.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.7, "ssn": 0.4, "passport": 0.35, "account": 0.3, "secret": 0.35}
CONTEXT = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "payment", "debit"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer", "konto"),
    "ssn": (r"ssn\b", "social security", r"tax id\b", "national id", "taxpayer"),
    "passport": ("passport", "reisepass", "pasaporte", "passeport", "travel document"),
    "account": (r"account\b", r"acct\b", "konto", "cuenta", "routing", r"iban\b"),
    "secret": ("password", "passwd", r"pwd\b", "secret", r"token\b", r"api.?key\b", r"private.?key\b", r"access.?key\b", "bearer", "credential"),
}
#: Words that speak for another meaning.
AGAINST = {
    "ip": ("version", "release"),
    "ssn": ("part no", "model", "isbn"),
    "passport": ("part no", "model", "flight"),
    "account": ("order", "invoice", "isbn", "ticket", "serial", "followers"),
    "secret": ("commit", "checksum", "sha1", "sha256", "md5", "digest", "revision", "integrity"),
}
_any = lambda words: re.compile(r"\b(?:" + "|".join(words) + r")", re.IGNORECASE)
NEAR, FAR = {k: _any(w) for k, w in CONTEXT.items()}, {k: _any(w) for k, w in AGAINST.items()}
REACH, BONUS, MALUS, ENOUGH = 40, 0.2, 0.2, 0.5


def luhn(digits: str) -> bool:
    """The usual mod-10 check, from the right, every second digit doubled."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Country and check digits move to the end, letters count from 10; remainder 1."""
    code = iban.replace(" ", "")
    if not 15 <= len(code) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def _email_spans(text: str):
    """EMAIL's matches, found from the '@' signs: the local part is the longest run
    before the sign that no earlier match has taken."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def _is_ip(found: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in found.split("."))


def proposals(text: str):
    """(kind, start, end) of the confirmed spans, kind by kind."""
    if "@" in text:
        yield from (("email", *span) for span in _email_spans(text))
    if not DIGIT.search(text):
        return
    for m in IP_SCAN.finditer(text):
        if _is_ip(m[0]):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            yield "card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span()
    yield from (("iban", *span) for span in _iban_spans(text))
    for m in SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield "ssn", *m.span()
    for kind, pattern in (("passport", PASSPORT), ("account", ACCOUNT)):
        yield from ((kind, *m.span()) for m in pattern.finditer(text))
    for m in SECRET.finditer(text):
        if DIGIT.search(m[0]) and any(c.isalpha() for c in m[0]) and len(set(m[0])) >= 10:
            yield "secret", *m.span()


def _iban_spans(text: str):
    """A country code and as many letters and digits as the country's IBAN has, with single
    spaces between, if the remainder is right and no letter or digit follows."""
    free = 0
    for m in IBAN.finditer(text):
        at, left = m.start(), COUNTRY.get(m[1], 0)
        if not left or at < free:
            continue
        while at < len(text) and left:
            if text[at] != " ":
                if not (text[at].isascii() and (text[at].isdigit() or text[at].isupper())):
                    break
                left -= 1
            elif text[at - 1] == " ":
                break
            at += 1
        if not left and not text[at : at + 1].isalnum() and mod97(text[m.start() : at]):
            yield m.start(), at
            free = at


def scored_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start."""
    out, weak, text = [], [], text or ""
    for kind, start, end in proposals(text):
        around = text[max(0, start - REACH) : start] + "\n" + text[end : end + REACH]
        score = PRIOR[kind] + BONUS * bool(NEAR[kind].search(around))
        if kind in FAR and FAR[kind].search(around):
            score -= MALUS
        if kind in BASE_KINDS or score >= ENOUGH:
            (out if PRIOR[kind] >= ENOUGH else weak).append((kind, start, end, min(1.0, max(0.0, score))))
    taken: list[tuple[int, int]] = []  # apart from each other
    for _, start, end, _ in sorted(out, key=lambda s: s[1]):
        if taken and start < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(end, taken[-1][1]))
        else:
            taken.append((start, end))
    for span in sorted(weak, key=lambda s: (-PRIOR[s[0]], s[1])):
        at = bisect.bisect(taken, span[1:3])
        if (not at or taken[at - 1][1] <= span[1]) and (at == len(taken) or span[2] <= taken[at][0]):
            taken.insert(at, span[1:3])
            out.append(span)
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and its scored spans."""
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scan(batches):
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in scored_spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, shape)], ["doc_id", "found"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {key}, found {SPANS}")


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts by base kind, the base digest, all spans as text and the highest score."""
    found = find_pii(docs)
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(kind) for kind in BASE_KINDS],
        F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", text), ",").alias("spans"),
        F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


def mask(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; of spans that
    overlap, the one that starts first (then the longest) names the whole stretch."""
    if not text or not (spans := sorted(scored_spans(text), key=lambda s: (s[1], -s[2]))):
        return text
    out, done = [], 0
    for kind, start, end, _ in spans:
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def mask_pii(docs: DataFrame) -> DataFrame:
    """The documents with masked texts and their new length; all rows and columns stay."""
    names, at = docs.columns, docs.columns.index("text")

    def scan(batches):
        for batch in batches:
            texts = pa.array([mask(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else batch.column(i) for i in range(len(names))], names)
        trim()

    out = docs.mapInArrow(scan, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out

