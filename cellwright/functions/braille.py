"""Cell codes: ASCII and Unicode forms, dot masks, numbers and the uncontracted encoder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The printable character of each six-dot mask, in mask order.
ASCII_CELLS = " A1B'K2L@CIF/MSP\"E3H9O6R^DJG>NTQ,*5<-U8V.%[$+X!&;:4\\0Z7(_?W]#Y)="
#: Unicode block of braille patterns; the code point is this plus the mask.
UNICODE_BASE = 0x2800
UNICODE_CELLS = "".join(chr(UNICODE_BASE + m) for m in range(64))
#: The letters that stand for the digits 1 to 9 and 0.
DIGIT_LETTERS = "abcdefghij"
NUMBER_SIGN, CAPITAL_SIGN, GRADE_SIGN = 60, 32, 48


def _upper(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def ascii_to_unicode(c: Column) -> Column:
    """printable braille to Unicode cells; small letters count as capitals, unknown characters pass."""
    return F.translate(_upper(c), ASCII_CELLS, UNICODE_CELLS)


def unicode_to_ascii(c: Column) -> Column:
    """Unicode cells to printable braille; other characters pass."""
    return F.translate(c, UNICODE_CELLS, ASCII_CELLS)


#: Eight-dot dialects: the second half of ASCII repeats the first without dot 7, which these characters carry.
SECOND_HALF, FIRST_HALF = "`{|}~", "@[\\]^"
DOT_SEVEN = {"duxbury": None, "liblouis": "[@A-Z\\[\\\\\\]^]", "liblouis_math": "[A-Z]"}


def ascii_mask(c: Column, dialect: str = "duxbury") -> Column:
    """dot mask of one printable character, null where there is none."""
    seven = DOT_SEVEN[dialect]
    if seven is None:
        place = F.instr(F.lit(ASCII_CELLS), _upper(c))
        return F.when(place > 0, place - 1).cast("int")
    place = F.instr(F.lit(ASCII_CELLS), _upper(F.translate(c, SECOND_HALF, FIRST_HALF)))
    return F.when(place > 0, place - 1 + F.when(c.rlike(seven), 64).otherwise(0)).cast("int")


def to_masks(c: Column, dialect: str = "duxbury") -> Column:
    """masks of a whole string in a dialect; a null element marks an unsupported character."""
    if DOT_SEVEN[dialect] is None:  # the cells are the 64 characters from the blank on
        masks = F.array(*(F.lit(ASCII_CELLS.index(chr(32 + k))) for k in range(64)))
        return F.transform(F.filter(F.split(_upper(c), ""), lambda x: x != ""), lambda x: F.get(masks, F.ascii(x) - 32))
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: ascii_mask(x, dialect))


def masks_to_unicode(c: Column) -> Column:
    """Unicode cells of an array of masks."""
    return F.array_join(F.transform(c, lambda m: F.substring(F.lit(UNICODE_CELLS), m + 1, F.lit(1))), "")


def masks_to_ascii(c: Column) -> Column:
    """printable characters of an array of masks."""
    return F.array_join(F.transform(c, lambda m: F.substring(F.lit(ASCII_CELLS), m + 1, F.lit(1))), "")


def dot_notation(c: Column) -> Column:
    """raised dots of a mask as digits; the blank cell is 0."""
    parts = [F.when(c.bitwiseAND(F.lit(1 << d)) > 0, F.lit(str(d + 1))).otherwise("") for d in range(8)]
    return F.when(c == 0, "0").otherwise(F.concat(*parts))


def codepoints(c: Column) -> Column:
    """U+XXXX listing of a string."""
    return F.array_join(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(x)), 4, "0"))), " ")


def braille_int(c: Column) -> Column:
    """a page number: plain digits, or letters a-j after an optional number sign; -1 otherwise."""
    body = F.regexp_replace(F.lower(c), "^#", "")
    digits = F.translate(body, DIGIT_LETTERS, "1234567890")
    value = F.when(body.rlike("^(?:[a-j]{1,9}|[0-9]{1,9})$"), digits)
    return F.coalesce(value.cast("int"), F.lit(-1))
