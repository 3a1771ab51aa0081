import datetime
import hashlib
import random

import regex

from tracewise.llm import pii as P

KEY = "test key"


def feistel(v, b, kind):
    v, u = list(v), len(v) // 2
    for r in range(8):
        left = r % 2 == 0
        other = [x for i, x in enumerate(v) if (i < u) != left]
        half = [i for i in range(len(v)) if (i < u) == left]
        for k, i in enumerate(half):
            h = hashlib.sha256("|".join([KEY, kind, str(r), str(k // 8), ",".join(map(str, other))]).encode()).hexdigest()
            if b[i]:
                v[i] = (v[i] + int(h[8 * (k % 8) : 8 * (k % 8) + 8], 16)) % b[i]
    return v


def walk(v, b, kind, ok):
    v = feistel(v, b, kind)
    while not ok(v):
        v = feistel(v, b, kind)
    return v


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d))) % 10


def digits(m):
    return [int(c) for c in m if "0" <= c <= "9"]


def refill(m, d):
    d = iter(d)
    return "".join(str(next(d)) if "0" <= c <= "9" else c for c in m)


def ssn_ok(w):
    return not (w[0] == 9 or w[:3] in ([0, 0, 0], [6, 6, 6]) or w[3:5] == [0, 0] or w[5:] == [0, 0, 0, 0])


def day_of(m):
    y, mo, d = m.split("-") if m[4] == "-" else reversed(regex.split("[./]", m))
    try:
        return datetime.date(int(y), int(mo), int(d))
    except ValueError:
        return None


RANGES = [(48, 57), *P.LETTERS]


def phone_ok(w):
    return w[3] >= 2


def brute_one(m):
    for kind, pattern in P.PATTERNS.items():
        if not regex.fullmatch(pattern, m):
            continue
        if kind == "email":
            user, host = m.split("@", 1)
            at = [next(((lo, hi - lo + 1) for lo, hi in RANGES if lo <= ord(c) <= hi), (0, 0)) for c in user]
            new = feistel([ord(c) - lo if n else 0 for c, (lo, n) in zip(user, at)], [n for _, n in at], kind)
            return kind, "".join(chr(lo + x) if n else c for c, x, (lo, n) in zip(user, new, at)) + "@" + host
        if kind == "card":
            d = digits(m)
            if luhn(d):
                continue
            new = feistel(d[:-1], [10] * (len(d) - 1), kind)
            return kind, refill(m, [*new, (10 - luhn([*new, 0])) % 10])
        if kind == "phone":
            d = digits(m)
            return kind, refill(m, d[:-10] + walk(d[-10:], [10] * 10, kind, phone_ok))
        if kind == "ssn":
            if ssn_ok(digits(m)):
                return kind, refill(m, walk(digits(m), [10] * 9, kind, ssn_ok))
        if kind == "ipv4":
            v = [int(x) for x in m.split(".")]
            if max(v) <= 255:
                return kind, ".".join(map(str, feistel(v, [256] * 4, kind)))
        if kind == "date" and day_of(m):
            n = (day_of(m) - datetime.date(1900, 1, 1)).days
            a, b = walk([n // 512, n % 512], [256, 512], kind, lambda w: w[0] * 512 + w[1] < P.DAYS)
            new = datetime.date(1900, 1, 1) + datetime.timedelta(a * 512 + b)
            return kind, new.strftime("%Y-%m-%d" if m[4] == "-" else f"%d{m[2]}%m{m[2]}%Y")
        if kind == "secret" and regex.search("[0-9]", m) and regex.search("[a-f]", m):
            return kind, "".join(f"{x:x}" for x in feistel([int(c, 16) for c in m], [16] * len(m), kind))
    return None, m


OTHERS = "|".join(f"(?:{P.PATTERNS[k].replace('([./])', '(?P<sep>[./])').replace(chr(92) + '1', '(?P=sep)')})" for k in P.PATTERNS if k != "card")


def brute(text):
    """Values of other kinds first, then in what is left between the longest card from each group of digits."""
    from tests.llm.test_pii_beside import card_at

    found = dict.fromkeys(P.KINDS, 0)
    if text is None:
        return None, found
    spans = [(m.start(), m[0]) for m in regex.finditer(OTHERS, text)]
    inside = {a: a + len(m) for a, m in spans}
    starts = sorted(inside)
    at = k = 0
    while at < len(text):
        while k < len(starts) and starts[k] < at:
            k += 1
        if at in inside:
            at = inside[at]
            continue
        m = card_at(text, at, starts[k] if k < len(starts) else len(text)) if text[at] in "0123456789" and not (at and text[at - 1] in "0123456789") else None
        if m:
            spans.append((at, m))
        at += len(m) if m else 1
    out, end = "", 0
    for a, m in sorted(spans):
        kind, new = brute_one(m)
        found[kind] += 1
        out, end = out + text[end:a] + new, a + len(m)
    return out + text[end:], found


def card(rng):
    d = [rng.randrange(10) for _ in range(rng.choice([12, 15, 18]))]
    d.append((10 - luhn([*d, 0])) % 10)
    s = "".join(map(str, d))
    return rng.choice([s, " ".join(s[k : k + 4] for k in range(0, len(s), 4)), "-".join(s[k : k + 4] for k in range(0, len(s), 4)) if len(s) % 4 != 1 else s])


def samples(n):
    rng = random.Random(7)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    make = [
        lambda: rng.choice(["of", "Été", "anna.b", "x_9%+-y", "ß", "ŁÓDŹ", "a" * 70]) + rng.choice([".", ""]) + d(rng.randint(0, 3)) + "@mail" + d(1) + ".example.com",
        lambda: card(rng),
        lambda: d(16),
        lambda: f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}",
        lambda: f"{d(3)}-{d(3)}-{d(4)}",
        lambda: f"{d(3)}-{d(2)}-{d(4)}",
        lambda: ".".join(str(rng.randint(0, 300)) for _ in range(4)),
        lambda: f"{rng.choice(['19', '20'])}{d(2)}-{rng.randint(0, 13):02d}-{rng.randint(0, 32):02d}",
        lambda: f"{rng.randint(1, 31):02d}{rng.choice('./')}{rng.randint(1, 12):02d}{rng.choice('./')}20{d(2)}",
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([31, 32, 40, 64]))),
        lambda: rng.choice(["word", "v1.2.3", "3.14", "a1b2", "1234567", "@", "x@y", "$5", "\n", '"']),
    ]
    return ["".join(rng.choice(make)() + rng.choice([" ", ", ", "; ", "", ".", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_same_as_brute_force(spark):
    texts = [None, "", " ", *samples(400), "9" * 5000, "a" * 60000, "a.b" * 9000 + "@x.com", "4111111111111111 " * 3000]
    d = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "id long, text string, found string")
    got = {r.id: r for r in P.pseudonymize(d, KEY).collect()}
    for k, t in enumerate(texts):
        want, found = brute(t)
        assert got[k].text == want, t
        assert got[k].found.asDict() == found


def test_formats_are_kept_and_values_linked(spark):
    rng = random.Random(1)
    cards = sorted({card(rng).replace(" ", "").replace("-", "") for _ in range(300)})
    rows = spark.createDataFrame([(c, f"a {c} b") for c in cards] + [(c, c) for c in cards], "c string, text string")
    new = {}
    for r in P.pseudonymize(rows, KEY).collect():
        new.setdefault(r.c, set()).add(r.text.removeprefix("a ").removesuffix(" b"))
    assert all(len(v) == 1 for v in new.values())
    made = [next(iter(v)) for v in new.values()]
    assert len(set(made)) == len(cards) and all(luhn(digits(m)) == 0 for m in made) and all(len(a) == len(next(iter(b))) for a, b in new.items())


def test_columns_and_plan(spark):
    d = spark.createDataFrame([("x", "a 4111111111111111", "n")], "`a.b` string, text string, FOUND string")
    out = P.pseudonymize(d, KEY)
    assert out.columns == ["a.b", "text", "found"]
    assert "Python" not in out._jdf.queryExecution().toString() and "Exchange" not in out._jdf.queryExecution().toString()
    assert P.pseudonymize(d.limit(0), KEY).collect() == []


def test_letters_of_all_scripts(spark):
    users = ["иван", "Анна.Б", "ελένη", "ÉTÉ", "Łódź", "דוד", "محمد", "李雷", "김민수", "たろう", "ქეთი", "straße", "b" * 64]
    rows = spark.createDataFrame([(u, f"to {u}@example.com") for u in users], "u string, text string")
    for r in P.pseudonymize(rows, KEY).collect():
        new = r.text.removeprefix("to ").removesuffix("@example.com")
        assert r.found.email == 1 and new != r.u and len(new) == len(r.u)
        for a, b in zip(r.u, new, strict=True):
            assert any(lo <= ord(a) <= hi and lo <= ord(b) <= hi for lo, hi in P.LETTERS) if a.isalpha() else a == b
    for lo, hi in P.LETTERS:
        letters = sum(regex.fullmatch(r"\p{L}", chr(c)) is not None for c in range(lo, hi + 1))
        assert letters == hi - lo + 1, (hex(lo), hex(hi))
    assert sorted(P.LETTERS)[0][0] > 57 and all(a[1] < b[0] for a, b in zip(sorted(P.LETTERS), sorted(P.LETTERS)[1:]))
    other = spark.createDataFrame([("தமிழ்@example.com",), ("aதb@example.com",)], "text string")
    assert [(r.text, r.found.email) for r in P.pseudonymize(other, KEY).collect()] == [("தமிழ்@example.com", 0), ("aதb@example.com", 0)]


def test_phones_stay_phones(spark):
    rows = spark.createDataFrame([(f"+1 ({i:03d}) 555-{i:04d}",) for i in range(300)] + [("017-155-1234",), ("+0 (222) 555-0000",)], "text string")
    got = [r.text for r in P.pseudonymize(rows, KEY).collect()]
    assert len(set(got)) == 302 and all(regex.fullmatch(r"\+1 \([0-9]{3}\) [2-9][0-9]{2}-[0-9]{4}", g) for g in got[:300])
    assert got[300] == "017-155-1234" and got[301].startswith("+0 (") and got[301] != "+0 (222) 555-0000"


def test_key_is_in_no_plan(spark):
    d = spark.createDataFrame([("a 4111111111111111",)], "text string")
    out = P.pseudonymize(d, "very secret key 8812")
    out.collect()
    for mode in ("simple", "extended", "codegen", "formatted", "cost"):
        assert "8812" not in out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), mode)


def test_clashing_names(spark):
    names = ["hits", "parts", "kinds", "runs", "new", "secret", "c0", "c1", "__pii_parts", "__pii_hits", "x.y"]
    d = spark.createDataFrame([(*[f"v{k}" for k in range(len(names))], "a@example.com")], ", ".join(f"`{n}` string" for n in [*names, "text"]))
    r = P.pseudonymize(d, KEY).first().asDict()
    assert [r[n] for n in names] == [f"v{k}" for k in range(len(names))] and r["found"].email == 1 and list(r) == [*names, "text", "found"]
    alone = P.pseudonymize(spark.createDataFrame([("a@example.com",)], "text string"), KEY).first()
    assert alone.text == r["text"]


def test_query(spark, tmp_path):
    from tracewise.llm import queries

    texts = [None, "", *samples(40)]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    global KEY
    before, KEY = KEY, queries.PII_KEY
    try:
        for r in queries.op1_pii(spark, str(tmp_path)).collect():
            want, found = brute(texts[r.doc_id])
            assert r.text == want and {k: r[f"n_{k}"] for k in P.KINDS} == found
    finally:
        KEY = before
