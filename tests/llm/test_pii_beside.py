"""Values beside other numbers, against a search by hand that shares no pattern with the operator."""

import random

from tests.llm import test_pii
from tests.llm.test_pii import card, day_of, digits, feistel, luhn, refill, ssn_ok, walk
from tracewise.llm import pii as P


def shaped(text, at, shape):
    """The text from ``at`` if it has the shape (d: a digit, s: a blank or hyphen), else None."""
    m = text[at : at + len(shape)]
    ok = len(m) == len(shape) and all(c in "0123456789" if s == "d" else c in " -" if s == "s" else c == s for c, s in zip(m, shape, strict=True))
    return m if ok else None


def word(c):
    return c.isascii() and c.isalnum()


def other(text, at):
    """Kind and value of the phone, ssn or date from ``at``."""
    last = text[at - 1] if at else " "
    if word(last):
        return None
    for kind, shape in (("date", "dddd-dd-dd"), ("ssn", "ddd-dd-dddd"), ("phone", "dddsdddsdddd")):
        m = shaped(text, at, shape)
        after = text[at + len(shape) :] + "  "
        if m is None or word(after[0]):
            continue
        if kind == "date" and last not in "./-" and not (after[0] in "./-" and after[1].isdigit()) and m[:2] in ("19", "20") and day_of(m):
            return kind, m
        if kind == "ssn" and last != "-" and after[0] != "-" and ssn_ok(digits(m)):
            return kind, m
        if kind == "phone" and digits(m)[3] >= 2:
            return kind, m
    return None


def card_at(text, at, stop):
    """The longest card from ``at`` that ends before ``stop``."""
    if at and word(text[at - 1]):
        return None
    best, n = None, 0
    for end in range(at, stop):
        if text[end] in "0123456789":
            n += 1
        elif not (text[end] in " -" and end > at and text[end - 1] in "0123456789"):
            break
        m = text[at : end + 1]
        if text[end] in "0123456789" and 13 <= n <= 19 and not (end + 1 < len(text) and word(text[end + 1])) and luhn(digits(m)) == 0:
            best = m
    return best


def by_hand(text):
    spans, at = [], 0
    while at < len(text):
        got = other(text, at) if text[at].isdigit() else None
        if got:
            spans.append((at, *got))
        at += len(got[1]) if got else 1
    at, cards = 0, []
    while at < len(text):
        inside = next((a + len(m) for a, _, m in spans if a <= at < a + len(m)), None)
        if inside:
            at = inside
            continue
        stop = min([a for a, _, _ in spans if a > at], default=len(text))
        m = card_at(text, at, stop) if text[at].isdigit() else None
        if m:
            cards.append((at, "card", m))
        at += len(m) if m else 1
    out, end = "", 0
    for a, kind, m in sorted(spans + cards):
        out += text[end:a] + new(kind, m)
        end = a + len(m)
    return out + text[end:], sorted(k for _, k, _ in spans + cards)


def new(kind, m):
    d = digits(m)
    if kind == "card":
        body = feistel(d[:-1], [10] * (len(d) - 1), kind)
        return refill(m, [*body, (10 - luhn([*body, 0])) % 10])
    if kind == "phone":
        return refill(m, walk(d, [10] * 10, kind, test_pii.phone_ok))
    if kind == "ssn":
        return refill(m, walk(d, [10] * 9, kind, ssn_ok))
    import datetime

    n = (day_of(m) - datetime.date(1900, 1, 1)).days
    a, b = walk([n // 512, n % 512], [256, 512], kind, lambda w: w[0] * 512 + w[1] < P.DAYS)
    return (datetime.date(1900, 1, 1) + datetime.timedelta(a * 512 + b)).isoformat()


SHORT = [
    "pay 4111 1111 1111 1111 25 items",
    "4111111111111111 25",
    "12 4111111111111111",
    "1234 123-45-6789",
    "code 2024 555-123-4567",
    "4111 1111 1111 1111 2024-01-02",
    "4111 1111 1111 1111 25kg",
    "1234567 123456 4111 1111 1111 1111",
    "4111111111111111-4111111111111111 4111111111111111",
]


def random_texts(n):
    rng = random.Random(3)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    make = [lambda: card(rng), lambda: card(rng), lambda: d(rng.randint(1, 8)), lambda: d(16), lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"20{d(2)}-{rng.randint(0, 13):02d}-{rng.randint(0, 32):02d}", lambda: "ab", lambda: d(2) + "kg"]
    return ["".join(rng.choice(make)() + rng.choice([" ", " ", " ", "-", ", ", "", "  "]) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def test_values_beside_other_numbers(spark):
    texts = SHORT + random_texts(1500) + ["1 " * 4000 + "4111111111111111" + " 2" * 4000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for r in P.pseudonymize(rows, test_pii.KEY).collect():
        want, kinds = by_hand(texts[r.id])
        assert r.text == want, texts[r.id]
        assert sorted(k for k, n in r.found.asDict().items() for _ in range(n)) == kinds


def test_none_of_the_short_texts_stays(spark):
    got = P.pseudonymize(spark.createDataFrame([(t,) for t in SHORT], "text string"), test_pii.KEY).collect()
    for t, r in zip(SHORT, got, strict=True):
        for v in ("4111 1111 1111 1111", "4111111111111111", "123-45-6789", "555-123-4567", "2024-01-02"):
            assert v not in t or v not in r.text
