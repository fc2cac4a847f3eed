"""The method's own spans of personal data against plain searches."""

import random
import re

import pytest

from loomtext.llm import pii


def plain_ibans(text):
    """Every start and end tried: a known country's length, its remainder, no letter or digit around."""
    out, free = [], 0
    for start in range(len(text)):
        if start < free or (start and text[start - 1].isalnum() and text[start - 1].isascii()):
            continue
        for end in range(start + 15, min(len(text), start + 70) + 1):
            found = text[start:end]
            code = found.replace(" ", "")
            if not re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]+", code) or not re.fullmatch(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])+", found):
                continue
            if len(code) != pii.COUNTRY.get(code[:2]) or text[end : end + 1].isalnum():
                continue
            if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                out.append((start, end))
                free = end
                break
    return out


def iban(rng):
    country = rng.choice(["DE", "FR", "NO", "MT", "AT"])
    own = "".join(rng.choice("0123456789") for _ in range(pii.COUNTRY[country] - 4))
    check = 98 - int("".join(str(int(c, 36)) for c in own + country + "00")) % 97
    code = f"{country}{check:02d}{own}"
    return rng.choice([code, " ".join(code[i : i + 4] for i in range(0, len(code), 4))])


def test_ibans_by_brute_force():
    rng, total = random.Random(3), 0
    for _ in range(400):
        parts = [rng.choice([iban(rng), iban(rng)[:-1] + "0", "EUR", "BIC", "12", "x", "AB12", iban(rng).lower(), "."]) for _ in range(6)]
        text = rng.choice([" ", "", ", "]).join(parts)
        assert list(pii._iban_spans(text)) == plain_ibans(text)
        total += len(plain_ibans(text))
    assert total > 150


@pytest.mark.parametrize("tail", ["BIC", "EUR", "1234", ""])
def test_what_follows_an_iban_does_no_harm(tail):
    assert pii.scored_spans(f"AT61 1904 3002 3457 3201 {tail}")[0][:3] == ("iban", 0, 24)


CASES = [
    ("ssn", "SSN: {}", "call {} now", "123-45-6789"),
    ("passport", "passport no. {}", "part no {} of", "X1234567"),
    ("account", "account number {}", "some {} things", "12345678"),
    ("secret", 'password = "{}"', "commit {} fixes", "f1d2d2f924e986ac86fdf7b36c94bcdf32beec15"),
    ("secret", "Bearer {}", "integrity checksum token {}", "eyJhbGciOiJIUzI1NiIsInR5cCI6"),
]


@pytest.mark.parametrize("kind, near, apart, value", CASES)
def test_context_decides(kind, near, apart, value):
    text = near.format(value)
    assert [(k, text[a:b]) for k, a, b, _ in pii.scored_spans(text)] == [(kind, value)]
    assert pii.mask(text) == near.format(f"[{kind.upper()}]")
    assert pii.scored_spans(apart.format(value)) == []
    far = "x" * 10 + " " + near.split("{}")[0] + "y " * 40 + value
    assert pii.scored_spans(far) == []


def test_weak_spans_give_way():
    text = "account card 4111 1111 1111 1111 and account +49 123456789012"
    assert [s[0] for s in pii.scored_spans(text)] == ["card", "phone"]


def test_spans_by_the_rule():
    """Every proposal is kept exactly if it is a base one or scores enough and stands free."""
    rng = random.Random(5)
    bits = ["SSN", "123-45-6789", "account", "12345678", "token", "f1d2d2f924e986ac86fdf7b36c94bcdf", "passport", "X1234567", "commit", "order", "a@b.org", "10.0.0.1", "+49 30 1234567", "and then", "~ " * 30]
    for _ in range(500):
        text = " ".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))
        got = pii.scored_spans(text)
        strong = [p for p in pii.proposals(text) if pii.PRIOR[p[0]] >= pii.ENOUGH]
        assert [s[:3] for s in got if pii.PRIOR[s[0]] >= pii.ENOUGH] == strong
        want = []
        for kind, start, end in sorted((p for p in pii.proposals(text) if pii.PRIOR[p[0]] < pii.ENOUGH), key=lambda p: (-pii.PRIOR[p[0]], p[1])):
            around = text[max(0, start - 40) : start] + "\n" + text[end : end + 40]
            hit = lambda words, around=around: any(re.search(r"\b" + w, around, re.IGNORECASE) for w in words)
            score = pii.PRIOR[kind] + 0.2 * hit(pii.CONTEXT[kind]) - 0.2 * hit(pii.AGAINST.get(kind, ()))
            if score >= 0.5 and not any(start < e and s < end for _, s, e in strong + want):
                want.append((kind, start, end))
        assert sorted(s[:3] for s in got if pii.PRIOR[s[0]] < pii.ENOUGH) == sorted(want)
