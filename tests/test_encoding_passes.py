"""The encoder by passes over whole texts, against its rules character by character."""

import re

from pyspark.sql import functions as F

from cellwright.functions import encoding
from cellwright.functions.braille import DIGIT_LETTERS, LOWER, UPPER


def rules(text):
    """(cell, offset) by the rules, one character at a time."""
    shouted = {k for m in re.finditer("(?<![A-Za-z])[A-Z]{2,}(?![A-Za-z])", text) for k in range(*m.span())}
    body = str.maketrans(LOWER + "1234567890" + "".join(encoding.MARKS), UPPER + DIGIT_LETTERS.upper() + "".join(encoding.MARKS.values()))
    out = []
    for o, c in enumerate(text):
        before = text[o - 1] if o else ""
        if o in shouted:
            sign = "" if o - 1 in shouted else ",,"
        elif "A" <= c <= "Z":
            sign = ","
        elif re.match("[0-9]", c):
            sign = "" if re.match("[0-9.,]", before) else "#"
        else:
            sign = ";" if re.match("[a-j]", c) and re.match("[0-9]", before) else ""
        out += [(x, o) for x in sign + c.translate(body)]
    return out


TEXTS = ["", "3,5a B.", "ABC dE FG1 2CD 3a4b 10j k", "1a1A1.2 ,3 .4 GND C", "é12😀ab 9j", "NG 7g CC c", "x" * 50, "12 345-ab Ab! aB? O'K"]


def test_passes_mark_what_the_rules_do(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "x string")
    got = {r.x: [(c.cell, c.offset) for c in r.e] for r in df.select("x", encoding.encode_uncontracted(F.col("x")).alias("e")).collect()}
    assert got == {t: rules(t) for t in TEXTS}


def test_a_text_is_encoded_once_whatever_its_words(spark):
    """One pass marks grade-1 signs, however many words take their place from the cells."""
    df = spark.createDataFrame([("Ab CD 3e Fg",)], "x string").select(encoding.capital_sites(F.col("x")).alias("s"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("(?<=[0-9])[a-j]") == 1
    assert [(w.word, w.expected_start, w.following) for w in df.first().s] == [("Ab", 0, "A"), ("CD", None, None), ("Fg", 14, "F")]
