r"""Format-preserving pseudonyms for personal data, in SQL functions only.

One regular expression finds valid values and runs of digit groups; what is valid is replaced by a keyed permutation of itself
within its own format, so equal values get equal pseudonyms in all documents and different values different ones. The text
between is untouched. What is found, and what makes it valid:

- email: user@host.tld; the user's letters and digits are permuted, each within its kind (a run of letters of one script, of one case
  where the script lists them so); users with other letters than those of LETTERS are no candidates; host and punctuation stay
- card: 13 to 19 digits, single spaces or hyphens between; the Luhn sum is 0; all but the check digit are permuted, which is made anew
- phone: three, three and four digits, with a country code, brackets or separators; country codes don't begin with 0 nor the second
  three digits with 0 or 1; the ten digits are permuted among such numbers. Area codes aren't held against a list of issued ones
- ssn: ddd-dd-dddd in an issued range; permuted among such numbers
- ipv4: four numbers up to 255; permuted as four bytes
- date: yyyy-mm-dd, dd.mm.yyyy or dd/mm/yyyy that exists, 1900 to 2099, also before a T and digits (a time); permuted among those days
- secret: 32 hexadecimal digits or more, letters and digits among them; in values of both cases letters and digits are permuted
  each within their kind, so each letter keeps its case

The permutation is a Feistel network over positions, each with a base of its own (10 for a digit, 26 for a letter, 256 for a
byte): the left and the right half take turns in adding, position by position, 32 bits each of a keyed SHA-256 stream of the other
half. The key is a value at run time and in no plan. Where a format
has gaps (dates, ssn), it is applied until it lands in the format again (cycle walking), at most WALKS times.

All kinds but cards are told by the expression alone. A run is digit groups with a blank or hyphen between, none of which starts a
value of another kind, so a phone, ssn or date beside a card is found first. In a run the first group that starts a card takes the
longest card from there to the end of a group, and so on behind it: short numbers beside a card don't hide it.

Everything is narrow: no shuffle, no join. Defined results: null stays null, with no findings; empty texts stay empty; invalid
values stay as they are; numbers inside longer runs of letters or digits (but a date before its time) aren't candidates; ``found`` counts replaced values by
kind (all kinds, also 0); repeated rows get equal results; input columns named ``found`` are replaced, all others kept, whatever
their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["email", "card", "phone", "ssn", "ipv4", "date", "secret"]
ROUNDS, WALKS = 8, 64
FIRST_DAY, DAYS = "1900-01-01", 73049

#: Runs of letters of one kind, first and last code point. A letter is permuted within its run.
LETTERS = [
    (0x61, 0x7A), (0x41, 0x5A),  # Latin
    (0xC0, 0xD6), (0xD8, 0xDE), (0xDF, 0xF6), (0xF8, 0xFF),  # Latin-1
    (0x100, 0x17F), (0x180, 0x24F), (0x1E00, 0x1EFF),  # further Latin letters, both cases
    (0x391, 0x3A1), (0x3A3, 0x3A9), (0x3B1, 0x3C9),  # Greek
    (0x388, 0x38A), (0x3AC, 0x3B0), (0x3CA, 0x3CE),  # Greek with marks
    (0x410, 0x42F), (0x400, 0x40F), (0x430, 0x44F), (0x450, 0x45F), (0x48A, 0x4BF),  # Cyrillic
    (0x531, 0x556), (0x561, 0x586),  # Armenian
    (0x5D0, 0x5EA),  # Hebrew
    (0x621, 0x63A), (0x641, 0x64A),  # Arabic
    (0x905, 0x939),  # Devanagari
    (0xE01, 0xE30),  # Thai
    (0x10D0, 0x10FA),  # Georgian
    (0x3041, 0x3096), (0x30A1, 0x30FA),  # Kana
    (0x4E00, 0x9FEF),  # Han
    (0xAC00, 0xD7A3),  # Hangul
]
_LETTER = "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in LETTERS)

_LEAP = "(?:(?:19|20)(?:0[48]|[2468][048]|[13579][26])|2000)"
_YMD = f"(?=[0-9]{{4}}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8]))|{_LEAP}-02-29)(?:19|20)[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}"
_DMY = f"(?=(?:0[1-9]|[12][0-9]|3[01])[./](?:0[13578]|1[02])|(?:0[1-9]|[12][0-9]|30)[./](?:0[469]|11)|(?:0[1-9]|1[0-9]|2[0-8])[./]02|29[./]02[./]{_LEAP})[0-9]{{2}}(?:\\.[0-9]{{2}}\\.|/[0-9]{{2}}/)(?:19|20)[0-9]{{2}}"
_BYTE = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"

#: Java regular expressions; those of all kinds but card match valid values only. Bounded repeats keep the search linear in very long words.
PATTERNS = {
    "email": rf"(?<![\p{{L}}0-9._%+-])[{_LETTER}0-9._%+-]{{1,64}}@[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}})*\.[A-Za-z]{{2,24}}",
    "date": rf"(?<![0-9A-Za-z./-])(?:{_YMD}|{_DMY})(?![0-9A-SU-Za-su-z]|[Tt](?![0-9]))(?![./-][0-9])",
    "ipv4": rf"(?<![0-9A-Za-z.]){_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}(?![0-9A-Za-z])(?!\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])(?!9|000|666)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9][ -]?){12,18}[0-9](?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])",
}
_OTHERS = "|".join(f"(?:{PATTERNS[k]})" for k in PATTERNS if k != "card")
#: Groups of digits that may hold cards. Possessive, so that a run of any length needs no stack.
RUN = rf"(?<![0-9A-Za-z])(?=(?:[0-9][ -]?){{12}}[0-9])(?:(?!{_OTHERS})[0-9]++(?![A-Za-z])[ -]?)++"
CANDIDATE = f"{_OTHERS}|(?:{RUN})"


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _feistel(values: str, bases: str, key: str, kind: str) -> str:
    """The permuted array of ``values``, each in 0 to its base less 1; a base of 0 marks a position that stays."""
    other = "array_join(filter(s, (x, i) -> (i < p.u) != (r % 2 = 0)), ',')"
    blocks = f"transform(sequence(0, (size(s) - p.u - 1) div 8), n -> sha2(concat_ws('|', {key}, {_q(kind)}, r, n, {other}), 256))"
    add = "IF((i < p.u) = (r % 2 = 0) AND p.b[i] > 0, cast(pmod(x + cast(conv(substr(h, 1 + 8 * IF(i < p.u, i, i - p.u), 8), 16, 10) AS BIGINT), p.b[i]) AS INT), x)"
    step = _let("h", f"array_join({blocks}, '')", f"transform(s, (x, i) -> {add})")
    half = _let("v", values, f"named_struct('v', v, 'b', {bases}, 'u', size(v) div 2)")
    return _let("p", half, f"aggregate(sequence(0, {ROUNDS - 1}), p.v, (s, r) -> {step})")


def _walk(values: str, valid: str, key: str, kind: str, bases: str) -> str:
    """Applied once and then until ``valid`` (of array w) holds."""
    again = f"IF(n > 0 AND {_let('w', 's0', valid)}, s0, {_feistel('s0', bases, key, kind)})"
    return f"aggregate(sequence(0, {WALKS - 1}), {values}, (s0, n) -> {again})"


_CODES = "transform(split({m}, ''), c -> ascii(c))"
_RUNS = [(0x30, 0x39), *LETTERS]
_BASE = "CASE " + " ".join(f"WHEN c BETWEEN {a} AND {b} THEN {b - a + 1}" for a, b in _RUNS) + " ELSE 0 END"
_ZERO = "CASE " + " ".join(f"WHEN c BETWEEN {a} AND {b} THEN {a}" for a, b in _RUNS) + " ELSE 0 END"


def _char(code: str) -> str:
    """SQL for the character of a code point of two bytes at most in UTF-16."""
    return f"decode(unhex(lpad(hex({code}), 4, '0')), 'UTF-16BE')"


def _digits(m: str) -> str:
    return f"transform(split(regexp_replace({m}, '[^0-9]', ''), ''), c -> cast(c AS INT))"


def _refill(m: str, digits: str) -> str:
    """The digits of ``m``, in order, replaced by those of the array."""
    count = "size(filter(slice(f.c, 1, i), y -> y BETWEEN '0' AND '9'))"
    return _let("f", f"named_struct('c', split({m}, ''), 'd', {digits})", f"array_join(transform(f.c, (x, i) -> IF(x BETWEEN '0' AND '9', cast(f.d[{count}] AS STRING), x)), '')")


def _luhn(digits: str) -> str:
    """Luhn sum of a digit array with its check digit."""
    return _let("l", digits, "aggregate(transform(l, (x, i) -> IF((size(l) - 1 - i) % 2 = 0, x, IF(x > 4, 2 * x - 9, 2 * x))), 0, (a, x) -> a + x)") + " % 10"


def _bases(n: str, base: int) -> str:
    return f"array_repeat({base}, {n})"


_PHONE_OK = "w[3] >= 2"
_SSN_OK = "NOT (w[0] = 9 OR w[0] + w[1] + w[2] = 0 OR (w[0] = 6 AND w[1] = 6 AND w[2] = 6) OR w[3] + w[4] = 0 OR w[5] + w[6] + w[7] + w[8] = 0)"
_DAY = "CASE WHEN {m} LIKE '____-%' THEN try_to_date({m}, 'yyyy-MM-dd') ELSE try_to_date(concat(substr({m}, 7, 4), '-', substr({m}, 4, 2), '-', substr({m}, 1, 2)), 'yyyy-MM-dd') END"


def kind_of(m: str) -> str:
    """SQL for the kind of a value; card for a run."""
    return "CASE " + " ".join(f"WHEN {m} RLIKE {_q('^(?:' + PATTERNS[k] + ')$')} THEN '{k}'" for k in PATTERNS if k != "card") + " ELSE 'card' END"


def cards_of(m: str) -> str:
    """SQL for a run's groups, each with the separator behind it, and the first and last group of each of its cards."""
    whole = "array_join(transform(slice(w.g, i + 1, j - i + 1), x -> translate(x, ' -', '')), '')"
    valid = _let("o", whole, f"length(o) BETWEEN 13 AND 19 AND {_luhn(_digits('o'))} = 0")
    last = f"transform(w.g, (g0, i) -> array_max(filter(sequence(i, least(i + 18, size(w.g) - 1)), j -> {valid})))"
    none = "named_struct('next', 0, 'cards', cast(array() AS ARRAY<STRUCT<a: INT, b: INT>>))"
    pick = "IF(y.a < s.next, s, named_struct('next', y.b + 1, 'cards', concat(s.cards, array(y))))"
    cards = _let("z", last, f"aggregate(filter(transform(z, (b, i) -> named_struct('a', i, 'b', b)), y -> y.b IS NOT NULL), {none}, (s, y) -> {pick}).cards")
    return _let("w", f"named_struct('g', regexp_extract_all({m}, '[0-9]+[ -]?', 0))", f"named_struct('g', w.g, 'cards', {cards})")


def _run_pseudonym(run: str, key: str) -> str:
    """SQL for the text of a run with pseudonyms for its cards."""
    groups = lambda a, n: f"array_join(slice({run}.g, {a} + 1, {n}), '')"
    before = f"IF(k = 0, 0, {run}.cards[k - 1].b + 1)"
    made = _let("m2", groups("y.a", "y.b - y.a + 1"), pseudonym("m2", "card", key))
    rest = f"({run}.cards[size({run}.cards) - 1].b + 1)"
    return f"concat(array_join(transform({run}.cards, (y, k) -> concat({groups(before, f'y.a - {before}')}, {made})), ''), {groups(rest, f'size({run}.g) - {rest}')})"


def pseudonym(m: str, kind: str, key: str) -> str:
    """SQL for the pseudonym of a valid value of that kind."""
    user, host = f"substring_index({m}, '@', 1)", f"concat('@', substring_index({m}, '@', -1))"
    chars = lambda v, b: _let("e", f"named_struct('c', {_CODES.format(m=v)})", _let("e2", f"named_struct('z', transform(e.c, c -> {_ZERO}), 'o', split({v}, ''), 'n', " + _feistel(f"transform(e.c, c -> IF({_BASE} > 0, c - ({_ZERO}), 0))", f"transform(e.c, c -> {_BASE})", key, b) + ")", f"array_join(transform(e2.n, (x, i) -> IF(e2.z[i] > 0, {_char('e2.z[i] + x')}, e2.o[i])), '')"))
    if kind == "email":
        return f"concat({chars(user, kind)}, {host})"
    if kind == "card":
        body = _let("g", _digits(m), _feistel("slice(g, 1, size(g) - 1)", _bases("size(g) - 1", 10), key, kind))
        return _refill(m, _let("g2", body, f"concat(g2, array((10 - {_luhn('concat(g2, array(0))')}) % 10))"))
    if kind == "phone":
        last = f"slice({_digits(m)}, -10, 10)"
        head = f"slice({_digits(m)}, 1, size({_digits(m)}) - 10)"
        return _refill(m, f"concat({head}, {_walk(last, _PHONE_OK, key, kind, _bases('10', 10))})")
    if kind == "ssn":
        return _refill(m, _walk(_digits(m), _SSN_OK, key, kind, _bases("9", 10)))
    if kind == "ipv4":
        return f"array_join({_feistel(f'transform(split({m}, {_q('[.]')}), x -> cast(x AS INT))', _bases('4', 256), key, kind)}, '.')"
    if kind == "date":
        day = _let("d", f"datediff({_DAY.format(m=m)}, date'{FIRST_DAY}')", "array(cast(d div 512 AS INT), d % 512)")
        new = _let("d2", _walk(day, f"w[0] * 512 + w[1] < {DAYS}", key, kind, "array(256, 512)"), f"date_add(date'{FIRST_DAY}', d2[0] * 512 + d2[1])")
        return f"date_format({new}, CASE WHEN {m} LIKE '____-%' THEN 'yyyy-MM-dd' WHEN {m} LIKE '__.%' THEN 'dd.MM.yyyy' ELSE 'dd/MM/yyyy' END)"
    hexes = f"transform(split({m}, ''), c -> cast(conv(c, 16, 10) AS INT))"
    one = f"array_join(transform({_feistel(hexes, _bases(f'length({m})', 16), key, kind)}, x -> IF({m} RLIKE '[A-F]', hex(x), lower(hex(x)))), '')"
    zeros, bases = "transform(e.c, c -> CASE WHEN c < 58 THEN 48 WHEN c < 71 THEN 65 ELSE 97 END)", "transform(e.c, c -> IF(c < 58, 10, 6))"
    made = _feistel("zip_with(e.c, e2.z, (c, z) -> c - z)", bases, key, kind)
    both = _let("e", f"named_struct('c', {_CODES.format(m=m)})", _let("e2", f"named_struct('z', {zeros})", f"array_join(zip_with({made}, e2.z, (x, z) -> char(z + x)), '')"))
    return f"IF({m} RLIKE '[a-f]' AND {m} RLIKE '[A-F]', {both}, {one})"


def secret(spark: SparkSession, key: str) -> Column:
    """The key as a scalar subquery over a local one-row table: plans and event logs name its column, not its value."""
    return spark.createDataFrame(pa.table({"secret": [key]})).scalar()


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the values in ``text`` replaced, and ``found``: a struct of how many of each kind."""
    if not key:
        raise ValueError("an empty key would let anyone undo the pseudonyms")
    # the input's columns go by number, so that none has the name of one made here
    names = [c for c in docs.columns if c.lower() != "found"]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], secret(docs.sparkSession, key).alias("secret"))
    t = f"c{names.index(text)}"
    some = F.expr(f"{t} RLIKE '[0-9@]'")
    parts = F.when(some, F.split(F.col(t), CANDIDATE, -1))
    hits = F.when(some, F.expr(f"regexp_extract_all({t}, {_q(CANDIDATE)}, 0)"))
    rows = rows.withColumn("parts", parts).withColumn("hits", hits)
    rows = rows.withColumn("kinds", F.expr(f"transform(hits, m -> {kind_of('m')})"))
    rows = rows.withColumn("runs", F.expr(f"zip_with(hits, kinds, (m, k) -> IF(k = 'card', {cards_of('m')}, NULL))"))
    run = f"IF(size(c.cards) > 0, {_run_pseudonym('c', 'secret')}, m)"
    made = "CASE k " + " ".join(f"WHEN '{k}' THEN {run if k == 'card' else pseudonym('m', k, 'secret')}" for k in KINDS) + " END"
    both = "zip_with(kinds, runs, (k, c) -> named_struct('k', k, 'c', c))"
    rows = rows.withColumn("new", F.when(F.size("hits") > 0, F.expr(f"zip_with(hits, {both}, (m, kc) -> {_let('k', 'kc.k', _let('c', 'kc.c', made))})")))
    joined = F.expr("concat(array_join(zip_with(slice(parts, 1, size(parts) - 1), new, (a, b) -> concat(a, b)), ''), parts[size(parts) - 1])")
    sums = {k: f"size(filter(kinds, k -> k = '{k}'))" for k in KINDS} | {"card": "aggregate(runs, 0, (n, c) -> n + coalesce(size(c.cards), 0))"}
    count = lambda k: F.coalesce(F.expr(sums[k]), F.lit(0)).cast("long").alias(k)
    out = [(F.when(F.size("hits") > 0, joined).otherwise(F.col(t)) if f"c{i}" == t else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)]
    return rows.select(*out, F.struct(*[F.when(F.size("hits") > 0, count(k)).otherwise(F.lit(0).cast("long")).alias(k) for k in KINDS]).alias("found"))
