"""The uncontracted encoder, source scopes, math text and their marks, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellwright.functions.braille import DIGIT_LETTERS, LOWER, UPPER

#: The source alphabet of each profile.
SCOPES = {
    "phase1": "[a-z \n]", "case1": "[a-z ]", "case2": "[A-Za-z ]", "case3": "[A-Za-z0-9 .,-]", "case4": "[A-Za-z0-9 .,;:!?'-]",
}
#: Aliases of profile names after lower-casing and joining words by underscores.
PROFILES = {"uncontracted": "case1", "case_1": "case1", "capitals": "case2", "case_2": "case2", "numbers": "case3", "case_3": "case3", "punctuation": "case4", "case_4": "case4", "phase_1": "phase1"}
#: Printable cells of the six punctuation marks.
MARKS = {".": "4", ",": "1", ";": "2", ":": "3", "!": "6", "?": "8"}
NUMERIC = "([0-9][0-9.,]*)"


def scope_check(text: Column, profile: str) -> Column:
    """P5: struct (ok, offset, codepoint) of the first character outside a profile's alphabet; case 4 wants a dash between words or digits."""
    inside = SCOPES[profile]
    prefix = F.length(F.regexp_extract(text, f"^{inside}*", 0))
    dash = F.regexp_instr(text, F.lit("(?<![A-Za-z0-9])-|-(?![A-Za-z0-9])"))
    stray = F.when((dash > 0) & F.lit(profile == "case4"), dash - 1).otherwise(1 << 30)
    at = F.least(prefix, stray)
    bad = at < F.length(text)
    return F.struct((~bad).alias("ok"), F.when(bad, at).alias("offset"), F.when(bad, F.ascii(F.substring(text, at + 1, F.lit(1)))).alias("codepoint"))


def resolve_profile(name: Column) -> Column:
    """Profile of a name or alias, null if unknown."""
    key = F.regexp_replace(F.lower(F.trim(name)), "[- ]+", "_")
    known = F.create_map(*(F.lit(x) for pair in (PROFILES | {p: p for p in SCOPES}).items() for x in pair))
    return known[key]


#: Stand-ins for the letters of words in capitals, so that a letter tells its word's form.
SHOUTED = "".join(chr(0xE100 + i) for i in range(26))


def _shout(text: Column) -> Column:
    """The letters of every word of two capitals or more as their stand-ins."""
    words = "(?<![A-Za-z])[A-Z]{2,}(?![A-Za-z])"
    found = F.regexp_extract_all(text, F.lit(words), F.lit(0))
    between = F.split(text, words, -1)
    joined = F.transform(between, lambda part, i: F.concat(part, F.coalesce(F.translate(F.get(found, i), UPPER, SHOUTED), F.lit(""))))
    return F.array_join(joined, "")


def encode_uncontracted(text: Column) -> Column:
    """array of (cell, offset): letters, capital sign, number sign with numeric mode, grade-1 sign, punctuation.

    A word of two capitals or more has one double sign before it.  Which sign stands before a
    character depends on it and its left neighbour only, so that a few passes over the whole text
    mark all of them: the marks are capitals, of which the text has none by then.
    """
    shouted = f"[{SHOUTED[0]}-{SHOUTED[-1]}]"
    whole = _shout(text)
    signs = F.regexp_replace(whole, "[A-Z]", "C")
    # each pass changes no character that a later one looks back at
    for pattern, mark in (("(?<=[0-9])[a-j]", "G"), ("(?<![0-9.,])[0-9]", "N"), (f"(?<!{shouted}){shouted}", "D")):
        signs = F.regexp_replace(signs, pattern, mark)
    body = F.translate(F.translate(whole, LOWER + SHOUTED, UPPER + UPPER), "1234567890.,;:!?", DIGIT_LETTERS.upper() + "".join(MARKS[m] for m in ".,;:!?"))
    both = F.arrays_zip(F.split(body, "").alias("cell"), F.split(signs, "").alias("mark"))

    def cells(x: Column, i: Column) -> Column:
        cell = lambda c: F.struct(c.alias("cell"), i.cast("int").alias("offset"))
        sign = lambda *c: F.array(*(cell(F.lit(s)) for s in c), cell(x["cell"]))
        one = F.when(x["mark"] == "C", sign(",")).when(x["mark"] == "N", sign("#")).when(x["mark"] == "G", sign(";")).when(x["mark"] == "D", sign(",", ","))
        return one.otherwise(F.array(cell(x["cell"])))

    return F.when(text == "", F.array().cast("array<struct<cell:string,offset:int>>")).otherwise(F.flatten(F.transform(both, cells)))


def encode_capital_passage(text: Column) -> Column:
    """cells of a passage that the caller marks as all in capitals: a triple sign, small letters, a terminator."""
    body = F.array_join(F.transform(encode_uncontracted(F.lower(text)), lambda x: x["cell"]), "")
    return F.concat(F.lit(",,,"), body, F.lit(",'"))


def mark_numeric_spaces(text: Column) -> Column:
    """a space inside grouped thousands becomes the numeric-space mark, and a grade-1 mark before a letter, yr or an abbreviation in capitals after digit-dash."""
    grouped = F.regexp_replace(text, "([0-9]) (?=[0-9]{3}(?:[^0-9]|$))", "$1\ue001")
    return F.regexp_replace(grouped, "([0-9])-([a-zA-Z]|[yY][rR]|[A-Z]{2,})(?=[^a-zA-Z]|$)", "$1-\ue002$2")


def normalize_punctuation(text: Column) -> Column:
    """F8: one blank after sentence punctuation, and a grade-1 mark before ``?`` after a numeric dash."""
    spaced = F.regexp_replace(text, "([.;:!?]) +", "$1 ")
    return F.regexp_replace(spaced, "([0-9]-[.,;:!]?)[?]", "$1\ue002?")


def split_marked(text: Column) -> Column:
    """struct (ok, plain, marked) of ``[[*ts*]]...[[*te*]]`` spans; nested, unclosed or stray marks are not ok."""
    marks = F.array_join(F.regexp_extract_all(text, F.lit("\\[\\[\\*(t[se])\\*\\]\\]"), F.lit(1)), "")
    parts = F.split(text, "\\[\\[\\*t[se]\\*\\]\\]")
    ok = marks.rlike("^(?:tste)*$")
    plain = F.filter(parts, lambda x, i: i % 2 == 0)
    marked = F.filter(parts, lambda x, i: i % 2 == 1)
    return F.struct(ok.alias("ok"), F.when(ok, plain).alias("plain"), F.when(ok, marked).alias("marked"))


LINEAR = "^ *-? *(?:[0-9]+|[a-z])(?: *[-+×÷] *(?:[0-9]+|[a-z]))*(?: *= *-? *(?:[0-9]+|[a-z])(?: *[-+×÷] *(?:[0-9]+|[a-z]))*)? *$"


def is_linear_expr(text: Column) -> Column:
    """integers or single letters joined by + - × ÷, a leading minus, at most one =; a lone letter is not one."""
    return text.rlike(LINEAR) & ~text.rlike("^ *[a-z] *$")


def linear_tokens(text: Column) -> Column:
    """tokens of a linear expression."""
    return F.regexp_extract_all(text, F.lit("[0-9]+|[a-z]|[-+×÷=]"), F.lit(0))


#: Printable cells of the operators.
OPERATORS = {"+": "+", "-": "-", "×": "*", "÷": "/", "=": " .K "}


def encode_linear(tokens: Column) -> Column:
    """number sign at the start, after ``=`` and after an initial minus only; ``=`` is spaced, operators are not."""
    symbols = F.create_map(*(F.lit(x) for pair in OPERATORS.items() for x in pair))

    def cells(t: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(tokens, i - 1))
        earlier = F.when(i > 1, F.get(tokens, i - 2))
        fresh = before.isNull() | (before == "=") | ((before == "-") & (earlier.isNull() | (earlier == "=")))
        number = F.concat(F.when(fresh, "#").otherwise(""), F.translate(t, "1234567890", "1234567890"))
        return F.when(t.rlike("^[0-9]"), number).when(t.rlike("^[a-z]$"), F.translate(t, LOWER, UPPER)).otherwise(symbols[t])

    return F.array_join(F.transform(tokens, cells), "")


def wrap_switch(cells: Column, opening: str = "_%", closing: str = "_:") -> Column:
    """wrap in switch marks with exactly one blank inside on each side; an empty payload is unchanged."""
    body = F.btrim(cells, F.lit(" "))
    return F.when(body == "", cells).otherwise(F.concat(F.lit(opening + " "), body, F.lit(" " + closing)))


def normalize_math(text: Column) -> Column:
    """struct (text, changes): dashes to minus, script tokens and unary spacing, with a count of each change."""
    dash = F.regexp_replace(text, "[‐‑‒–—−]", "-")
    script = F.regexp_replace(F.regexp_replace(dash, "\\^\\{([^}]*)\\}", "^$1"), "_\\{([^}]*)\\}", "_$1")
    unary = F.regexp_replace(script, "(^|[=(]) *- +", "$1-")
    changes = F.array(
        F.regexp_count(text, F.lit("[‐‑‒–—−]")), F.regexp_count(text, F.lit("[\\^_]\\{[^}]*\\}")), F.regexp_count(script, F.lit("(^|[=(]) *- +"))
    )
    return F.struct(unary.alias("text"), changes.alias("changes"))


def construct_status(text: Column) -> Column:
    """Status of unsupported constructs: figures are excluded, scripts and unknown math forms go to review."""
    simple = F.regexp_replace(text, "[_^][0-9a-z]", "")
    return F.when(F.lower(text).rlike("\\[figure|figure placeholder"), "EXCLUDED").when(simple.rlike("[_^{}\\\\]|[∫∑√]"), "REVIEW").otherwise("PASS")


def capital_sites(text: Column) -> Column:
    """every word with a capital: (word, state, source_start, expected_start, following).

    State is initial, all or mixed; words in initial state have the place of their capital sign
    among the encoded cells and the cell after it.
    """
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
    state = lambda w: F.when(w.rlike("^[A-Z][a-z]*$"), "initial").when(w.rlike("^[A-Z]+$"), "all").otherwise("mixed")
    between = F.split(text, "[A-Za-z]+", -1)

    def site(w: Column, start: Column, cells: Column) -> Column:
        own = state(w) == "initial"
        place = (F.array_position(F.transform(cells, lambda x: x["offset"]), start) - 1).cast("int")
        return F.struct(w.alias("word"), state(w).alias("state"), start.alias("source_start"), F.when(own, place).alias("expected_start"), F.when(own, F.get(cells, place + 1)["cell"]).alias("following"))

    def sites(cells: Column, words: Column, between: Column) -> Column:
        begins = F.transform(words, lambda w, i: F.aggregate(F.slice(between, F.lit(1), i + 1), F.lit(0), lambda t, g: t + F.length(g)) + F.aggregate(F.slice(words, F.lit(1), i), F.lit(0), lambda t, x: t + F.length(x)))
        capital = F.filter(F.arrays_zip(words.alias("w"), begins.alias("at")), lambda x: x["w"].rlike("[A-Z]"))
        return F.transform(capital, lambda x: site(x["w"], x["at"], cells))

    # an array of one, so that the text is encoded once and not for each word
    once = F.array(F.struct(encode_uncontracted(text).alias("cells"), words.alias("words"), between.alias("between")))
    return F.transform(once, lambda x: sites(x["cells"], x["words"], x["between"]))[0]
