"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

Validated values are replaced by a keyed permutation of their own format: card numbers (Luhn)
stay card numbers, dates stay dates, IPv4 addresses stay addresses, and so on.  The
permutation is an alternating Feistel network over two mixed-radix halves whose round
function is SHA-256 of key, format, round and the other half; being a permutation of the
format it maps equal values to equal pseudonyms and different values to different ones, in
every document, without any table of links.

Formats: card (13-19 digits, plain or in groups, check digit recomputed), phone (country calling
code kept; the pseudonym depends on the digits, not on how they are grouped), ssn (valid areas,
groups and serials), iban (digits of the account, check digits recomputed), ip (dotted quads),
date (six usual forms, every day of the years 1 to 9999, each within some 200 years of its own)
and email, whose local part has no fixed radix and becomes a keyed digest of 80 bits.  A slash
date is read month first if it can be; one that must be day first stays such a one.  What does
not validate (a wrong check digit, an octet over 255, 31 February) is left alone.

The key is part of the plan, so whoever may read plans or event logs can read it: production
runs pass a key of their own and keep their logs as safe as the key.

Defined results: null text stays null and empty text empty, with no values; a value counts as
often as it occurs; repeated rows are handled one by one; very long texts are read whole, in
time about linear in their length; columns other than doc_id and text are not looked at, those
of ``pseudonymize`` stay; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.llm.common import prefix_sums

ROUNDS = 8
#: Key of the registered query; callers pass their own secret.
DEMO_KEY = "demonstration-key"
KINDS = ("email", "iban", "date", "ssn", "phone", "ip", "card")
#: Spans of 250 x 292 days, counted from FIRST_DAY in both directions, that dates are permuted within;
#: what is left at either end of the years 1 to 9999 is permuted in spans of its own: (first day, radices).
FIRST_DAY, DAY_RADIX = "1900-01-01", (250, 292)
FIRST_SPAN, LAST_SPAN = (-693_595, (65, 563)), (2_920_000, (64, 601))
#: Country calling codes of one and two digits; all others have three.
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Hexadecimal digits of an e-mail's pseudonym.
EMAIL_DIGITS = 20
#: Times that a permutation is applied again until a day-first date is one again; each try fails in 2 of 5 cases.
WALKS = 64

EMAIL = "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+"
IBAN = "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
DATE = (
    "(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}"
    "|[0-9]{2}[.][0-9]{2}[.][0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})(?![0-9]|[./-][0-9])"
)
SSN = "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
PHONE = (
    "(?:(?<![0-9+])[+][0-9]{1,3}[ .-]?[(]?[0-9]{2,4}[)]?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|(?<![0-9])[(][0-9]{3}[)] ?[0-9]{3}-[0-9]{4}"
    "|(?<![0-9.-])[0-9]{3}([.-])[0-9]{3}\\1[0-9]{4})(?![0-9])"
)
IP = "(?<![0-9.])(?:[0-9]{1,3}[.]){3}[0-9]{1,3}(?![0-9]|[.][0-9])"
CARD = "(?<![0-9])(?:[0-9]{4}([ -])[0-9]{4}\\2[0-9]{4}\\2[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9])"
ANY = "|".join((EMAIL, IBAN, DATE, SSN, PHONE, IP, CARD))


def _round(key: str, tweak: str, half: str, radix: str) -> str:
    digest = f"sha2(concat_ws('|', {key}, {tweak}, cast(i AS string), cast({half} AS string), {key}), 256)"
    return f"pmod(cast(conv(substr({digest}, 1, 15), 16, 10) AS bigint), {radix})"


def feistel(left: str, right: str, a: str, b: str, key: str, tweak: str) -> str:
    """SQL of the struct (l, r) that (left, right), below radices a and b, is permuted to."""
    one = f"named_struct('l', pmod(s.l + {_round(key, tweak, 's.r', a)}, {a}), 'r', s.r)"
    two = f"named_struct('l', s.l, 'r', pmod(s.r + {_round(key, tweak, 's.l', b)}, {b}))"
    start = f"named_struct('l', cast({left} AS bigint), 'r', cast({right} AS bigint))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> CASE WHEN i % 2 = 1 THEN {one} ELSE {two} END)"


def _let(name: str, value: str, body: str) -> str:
    """SQL that computes ``value`` once and uses it under ``name`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _permuted_digits(digits: str, key: str, tweak: str) -> str:
    """Two to 36 digits as a permutation of the numbers of that length."""
    n, k = f"length({digits})", f"length({digits}) div 2"
    a, b = f"cast(pow(10, cast({k} AS int)) AS bigint)", f"cast(pow(10, cast({n} - {k} AS int)) AS bigint)"
    left, right = f"substr({digits}, 1, cast({k} AS int))", f"substr({digits}, cast({k} AS int) + 1)"
    halves = feistel(left, right, a, b, key, f"concat({tweak}, cast({n} AS string))")
    join = f"concat(lpad(cast(h.l AS string), cast({k} AS int), '0'), lpad(cast(h.r AS string), cast({n} - {k} AS int), '0'))"
    return _let("h", halves, join)


def _refilled(x: str, digits: str) -> str:
    """x with its digits replaced in order."""
    upto = f"length({_digits(f'substr({x}, 1, j)')})"
    return (
        f"array_join(transform(sequence(1, length({x})), j -> CASE WHEN substr({x}, j, 1) BETWEEN '0' AND '9' "
        f"THEN substr({digits}, {upto}, 1) ELSE substr({x}, j, 1) END), '')"
    )


def _card(key: str) -> str:
    body = _let("b", "substr(d, 1, length(d) - 1)", _permuted_digits("b", key, "'card'"))
    checked = "concat(p, cast(element_at(filter(sequence(0, 9), c -> luhn_check(concat(p, cast(c AS string)))), 1) AS string))"
    return _let("d", _digits("x"), _let("q", _let("p", body, checked), _refilled("x", "q")))


def _phone(key: str) -> str:
    head = f"CASE WHEN x LIKE '+%' THEN regexp_extract(x, '^[+](?:{'|'.join(CALLING_CODES)}|[0-9]{{3}}|[0-9]+)', 0) ELSE '' END"
    rest = _let("y", "substr(x, length(k) + 1)", _let("d", _digits("y"), _let("p", _permuted_digits("d", key, "concat('phone', k)"), _refilled("y", "p"))))
    return _let("k", head, f"concat(k, {rest})")


def _ssn(key: str) -> str:
    area = "(cast(substr(x, 1, 3) AS int) - 1 - CASE WHEN cast(substr(x, 1, 3) AS int) > 666 THEN 1 ELSE 0 END)"
    left, right = f"{area} * 99 + cast(substr(x, 5, 2) AS int) - 1", "cast(substr(x, 8, 4) AS int) - 1"
    back = "h.l div 99 + 1 + CASE WHEN h.l div 99 >= 665 THEN 1 ELSE 0 END"
    text = f"concat(lpad(cast({back} AS string), 3, '0'), '-', lpad(cast(h.l % 99 + 1 AS string), 2, '0'), '-', lpad(cast(h.r + 1 AS string), 4, '0'))"
    return _let("h", feistel(left, right, "88902L", "9999L", key, "'ssn'"), text)


def _iban_remainder(x: str) -> str:
    step = "CASE WHEN c BETWEEN '0' AND '9' THEN (s * 10 + cast(c AS int)) % 97 ELSE (s * 100 + ascii(c) - 55) % 97 END"
    return f"aggregate(split({x}, ''), 0, (s, c) -> {step})"


def _iban(key: str) -> str:
    account = _let("d", _digits("y"), f"CASE WHEN length(d) < 2 THEN y ELSE {_let('p', _permuted_digits('d', key, 'substr(x, 1, 2)'), _refilled('y', 'p'))} END")
    remainder = _iban_remainder("concat(z, substr(x, 1, 2), '00')")
    text = f"concat(substr(x, 1, 2), lpad(cast(98 - {remainder} AS string), 2, '0'), z)"
    return _let("y", "substr(x, 5)", _let("z", account, text))


def _ip(key: str) -> str:
    left, right = "o[0] * 256 + o[1]", "o[2] * 256 + o[3]"
    text = "concat_ws('.', cast(h.l div 256 AS string), cast(h.l % 256 AS string), cast(h.r div 256 AS string), cast(h.r % 256 AS string))"
    return _let("o", "transform(split(x, '[.]'), t -> cast(t AS int))", _let("h", feistel(left, right, "65536L", "65536L", key, "'ip'"), text))


#: Date forms: what a match looks like, and its pattern; the first that gives a day counts.
DATE_FORMS = (
    ("[0-9]{4}-[0-9]{2}-[0-9]{2}", "yyyy-MM-dd"), ("[0-9]{4}/[0-9]{2}/[0-9]{2}", "yyyy/MM/dd"), ("[0-9]{2}/[0-9]{2}/[0-9]{4}", "MM/dd/yyyy"),
    ("[0-9]{2}/[0-9]{2}/[0-9]{4}", "dd/MM/yyyy"), ("[0-9]{2}[.][0-9]{2}[.][0-9]{4}", "dd.MM.yyyy"), ("[0-9]{2}-[0-9]{2}-[0-9]{4}", "dd-MM-yyyy"),
)


def _day(form: str) -> str:
    return f"cast(try_to_timestamp(x, '{form}') AS date)"


def _valid(form: str) -> str:
    return f"{_day(form)} IS NOT NULL"


def _other_day(n: str, key: str) -> str:
    """SQL of the day that day ``n`` (from FIRST_DAY) is permuted to, within its span."""
    a, b = DAY_RADIX

    def within(base: str, radices: tuple[int, int]) -> str:
        x, y = radices
        moved = feistel(f"(n - d0) div {y}", f"(n - d0) % {y}", f"{x}L", f"{y}L", key, "concat('date', cast(d0 AS string))")
        return _let("d0", base, _let("h", moved, f"cast(d0 + h.l * {y} + h.r AS int)"))

    spans = (
        f"CASE WHEN n < {FIRST_SPAN[0] + FIRST_SPAN[1][0] * FIRST_SPAN[1][1]} THEN {within(str(FIRST_SPAN[0]), FIRST_SPAN[1])} "
        f"WHEN n >= {LAST_SPAN[0]} THEN {within(str(LAST_SPAN[0]), LAST_SPAN[1])} "
        f"ELSE {within(f'cast(floor(n / {a * b}D) AS int) * {a * b}', DAY_RADIX)} END"
    )
    return _let("n", n, spans)


def _date(key: str) -> str:
    whens = []
    for shape, form in DATE_FORMS:
        start = f"datediff({_day(form)}, date'{FIRST_DAY}')"
        if form == "dd/MM/yyyy":  # reached only if the day is over 12: so must the pseudonym's be
            again = f"CASE WHEN i > 1 AND day(date_add(date'{FIRST_DAY}', m)) > 12 THEN m ELSE {_other_day('m', key)} END"
            moved = f"aggregate(sequence(1, {WALKS}), {start}, (m, i) -> {again})"
        else:
            moved = _other_day(start, key)
        text = f"date_format(date_add(date'{FIRST_DAY}', {moved}), '{form}')"
        whens.append(f"WHEN x RLIKE '^{shape}$' AND {_valid(form)} THEN {text}")
    return f"CASE {' '.join(whens)} ELSE x END"


def _email(key: str) -> str:
    return f"concat('u', substr(sha2(concat_ws('|', {key}, 'email', lower(x), {key}), 256), 1, {EMAIL_DIGITS}), '@', substring_index(x, '@', -1))"


def kind_sql() -> str:
    """Kind of a match x, null where it does not validate."""
    dates = " OR ".join(f"x RLIKE '^{shape}$' AND {_valid(form)}" for shape, form in DATE_FORMS)
    octets = "forall(split(x, '[.]'), t -> cast(t AS int) <= 255)"
    iban = _iban_remainder("concat(substr(x, 5), substr(x, 1, 4))")
    areas = "substr(x, 1, 3) NOT IN ('000', '666') AND substr(x, 1, 1) <> '9' AND substr(x, 5, 2) <> '00' AND substr(x, 8, 4) <> '0000'"
    return (
        "CASE WHEN contains(x, '@') THEN 'email' "
        f"WHEN x RLIKE '^[A-Z]{{2}}' THEN CASE WHEN {iban} = 1 THEN 'iban' END "
        "WHEN x RLIKE '^[0-9]{3}-[0-9]{2}-[0-9]{4}$' THEN CASE WHEN " + areas + " THEN 'ssn' END "
        "WHEN x RLIKE '^(?:[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4})$' "
        f"THEN CASE WHEN {dates} THEN 'date' END "
        "WHEN x RLIKE '^[+(]' OR x RLIKE '^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$' THEN 'phone' "
        f"WHEN x RLIKE '^(?:[0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}$' THEN CASE WHEN {octets} THEN 'ip' END "
        f"WHEN luhn_check({_digits('x')}) THEN 'card' END"
    )


def pseudonym_sql(key: str) -> str:
    """Pseudonym of a match x of kind k."""
    made = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "phone": _phone, "ip": _ip, "card": _card}
    whens = " ".join(f"WHEN '{kind}' THEN {make(key)}" for kind, make in made.items())
    return f"CASE m.kind {whens} ELSE x END"


def pseudonymize(docs: DataFrame, key: str = DEMO_KEY, text: str = "text") -> DataFrame:
    """Replace personal values: adds __found (array of kind, start and end) and changes the text."""
    quoted = "'" + key.replace("\\", "\\\\").replace("'", "\\'") + "'"
    worth = F.col(text).rlike("[0-9]{2}|[0-9].[0-9]|@")
    nothing = F.array().cast("array<string>")
    out = docs.withColumns(
        {
            "__m": F.when(worth, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(nothing),
            "__g": F.when(worth, F.split(text, ANY, -1)).otherwise(nothing),
        }
    )
    out = out.withColumn("__k", F.expr(f"transform(__m, x -> named_struct('x', x, 'kind', {kind_sql()}))"))
    out = out.withColumn("__r", F.expr(f"transform(__k, m -> {_let('x', 'm.x', pseudonym_sql(quoted))})"))
    out = out.withColumn("__e", F.expr(prefix_sums("transform(__m, (x, i) -> length(__g[i]) + length(x))")))
    spans = "transform(__k, (m, i) -> named_struct('kind', m.kind, 'start', __e[i] - length(m.x), 'end', __e[i]))"
    out = out.withColumn("__found", F.expr(f"filter({spans}, f -> f.kind IS NOT NULL)"))
    joined = F.expr("concat(array_join(transform(__r, (x, i) -> concat(__g[i], x)), ''), element_at(__g, -1))")
    return out.withColumn(text, F.when(F.size("__m") > 0, joined).otherwise(F.col(text))).drop("__m", "__g", "__k", "__r", "__e")


def _count(kind: str) -> Column:
    return F.size(F.filter("__found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")


def pseudonymized(docs: DataFrame, key: str = DEMO_KEY) -> DataFrame:
    """doc_id, the text with pseudonyms, n_values, a count for each kind and the spans replaced."""
    spans = F.array_join(F.transform("__found", lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    found = pseudonymize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), key)
    return found.select("doc_id", "text", F.size("__found").cast("long").alias("n_values"), *(_count(k) for k in KINDS), spans.alias("spans"))
