"""Character references of HTML in column expressions, decoded as HTML's own rules say."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"(&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)|[^&]+|&)"
#: Names that need no semicolon are looked for at the beginning of longer ones.
LONGEST_LOOSE = max(len(n) for n in html5 if not n.endswith(";"))


def _literal(entries: dict[str, str]) -> Column:
    return F.map_from_arrays(F.array(*(F.lit(k) for k in entries)), F.array(*(F.lit(v) for v in entries.values())))


def _windows() -> dict[str, str]:
    """Numbers 128 to 159, which stand for the characters of a Windows code page."""
    return {str(n): bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (129, 141, 143, 144, 157)}


def _character(number: Column) -> Column:
    """The character of a code point; numbers that are none give the replacement character, those that may not be written
    nothing."""
    text = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    control = number.between(1, 8) | number.between(14, 31) | number.between(127, 159) | number.between(0xFDD0, 0xFDEF) | (number == 11) | (number.bitwiseAND(0xFFFE) == 0xFFFE)
    known = F.element_at(_literal(_windows()), number.cast("string"))
    # written as it is where the Windows code page has nothing, as browsers do
    plain = F.when(number.isin(129, 141, 143, 144, 157), text).when(number == 13, F.lit("\r"))
    wrong = number.isNull() | (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    return F.when(wrong, F.lit("�")).when(known.isNotNull(), known).when(plain.isNotNull(), plain).when(control, F.lit("")).otherwise(text)


def unescaped(text: Column) -> Column:
    """``text`` with every character reference replaced: numbers, all of HTML's names, and those that may go without a
    semicolon also where letters follow. What is no reference stays."""
    names = _literal(html5)
    digits = lambda t: F.regexp_extract(t, "([0-9a-fA-F]+);?$", 1)

    def decoded(t: Column) -> Column:
        name = F.substring(t, 2, 100_000)
        decimal = F.when(F.length(digits(t)) <= 15, digits(t).try_cast("long")).otherwise(F.lit(0x110000))
        of_hex = F.when(F.length(F.ltrim(digits(t), F.lit("0"))) <= 8, F.conv(digits(t), 16, 10).try_cast("long")).otherwise(F.lit(0x110000))
        loose = F.coalesce(*(F.concat(F.element_at(names, F.substring(name, 1, k)), F.substring(name, k + 1, 100_000)) for k in range(LONGEST_LOOSE, 1, -1)))
        named = F.coalesce(F.element_at(names, name), loose, t)
        return F.when(t.rlike("^&#[xX]"), _character(of_hex)).when(t.startswith("&#"), _character(decimal)).when(t.startswith("&") & (F.length(t) > 1), named).otherwise(t)

    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))
    return F.when(text.contains("&"), F.array_join(F.transform(tokens, decoded), "")).otherwise(text)
