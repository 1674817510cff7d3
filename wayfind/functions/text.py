"""Text as the engine compares it: normalising, folding, tokens, prefixes, trigrams and edit distance, all as Spark expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters without a decomposition. Fixed values.
SPECIAL = {"ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D"}
#: Written units that must survive, longest first. Fixed values.
PROTECTED = (("km/h", "kmh"), ("m³", "m3"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Private characters that stand for what later steps must not touch: point, comma, dollar and "m3".
POINT, COMMA, DOLLAR, CUBIC = "\ue000", "\ue001", "\ue002", "\ue003"
PREFIX_MIN, PREFIX_MAX = 2, 6


def fold_table() -> dict[str, str]:
    """Latin letters from U+00C0 to U+017F with their ASCII letters."""
    out = dict(SPECIAL)
    for c in map(chr, range(0xC0, 0x180)):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if c not in out and c.isalpha() and unicodedata.decomposition(c) and base.isalpha() and base.isascii():
            out[c] = base
    return out


FOLD = fold_table()
SINGLE = {k: v for k, v in FOLD.items() if len(v) == 1}
DOUBLE = {k: v for k, v in FOLD.items() if len(v) > 1}


def fold(text: Column) -> Column:
    text = F.translate(text, "".join(SINGLE), "".join(SINGLE.values()))
    for k, v in DOUBLE.items():
        text = F.replace(text, F.lit(k), F.lit(v))
    return text


def normalize(text: Column, apart: bool = True) -> Column:
    """Lower-case ASCII words, numbers with their points and commas, and currency signs, each apart. Null gives an empty text. apart: letters and digits that
    touch become words of their own."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), "\\$[0-9A-Fa-f]{6}", "")
    x = F.translate(fold(F.regexp_replace(x, "[\\x00-\\x1F\\x7F]", "")), UPPER, LOWER)
    for a, b in PROTECTED:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.replace(F.replace(x, F.lit("r$"), F.lit(f" r{DOLLAR} ")), F.lit("$"), F.lit(f" {DOLLAR} "))
    x = F.regexp_replace(x, "([€£])", " $1 ")
    x = F.regexp_replace(x, "(?<=[0-9])\\.(?=[0-9])", POINT)
    x = F.regexp_replace(x, "(?<=[0-9]),(?=[0-9])", COMMA)
    x = F.replace(x, F.lit("m3"), F.lit(CUBIC))
    x = F.regexp_replace(x, "(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", " ") if apart else x
    x = F.regexp_replace(x, "[!-/:-@\\[-`{-~]", " ")
    x = F.replace(F.translate(x, POINT + COMMA + DOLLAR, ".,$"), F.lit(CUBIC), F.lit("m3"))
    return F.trim(F.regexp_replace(x, " +", " "))


def joined(text: Column) -> Column:
    """The normal form in which "6r" stays one word."""
    return normalize(text, apart=False)


def tokens(norm: Column) -> Column:
    return F.array_remove(F.split(norm, " "), "")


def token_spans(norm: Column) -> Column:
    """array<struct<pos, token, s, e>>, from 1, with the byte positions of each token's first and last byte."""
    parts = tokens(norm)
    before = lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda n, t: n + F.octet_length(t) + 1)
    return F.transform(
        parts,
        lambda t, i: F.struct((i + 1).alias("pos"), t.alias("token"), (before(i) + 1).alias("s"), (before(i) + F.octet_length(t)).alias("e")),
    )


def as_bytes(text: Column) -> Column:
    """One character for each byte of the UTF-8 form, for what is measured in bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def prefixes(token: Column) -> Column:
    """Beginnings of 2 to 6 bytes."""
    some = F.transform(F.sequence(F.lit(PREFIX_MIN), F.least(F.lit(PREFIX_MAX), F.length(token))), lambda n: F.substring(token, F.lit(1), n))
    return F.when(F.length(token) >= PREFIX_MIN, some).otherwise(F.array().cast("array<string>"))


def grams(token: Column) -> Column:
    """Trigrams of the token between two ``$``; none below three characters."""
    padded = F.concat(F.lit("$"), token, F.lit("$"))
    some = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))
    return F.when(F.length(token) >= 3, some).otherwise(F.array().cast("array<string>"))


def max_distance(length: Column) -> Column:
    """Edits allowed for a word of so many characters."""
    return F.when(length <= 3, 0).when(length <= 5, 1).when(length <= 9, 2).otherwise(3)


def osa(a: str, b: str) -> Column:
    """Restricted Damerau-Levenshtein distance of two string columns, by rows of the distance matrix."""
    return F.expr(
        f"""case when length({a}) = 0 or length({b}) = 0 then greatest(length({a}), length({b})) else
        aggregate(sequence(1, length({a})),
          named_struct('before', transform(sequence(0, length({b})), x -> 0), 'last', sequence(0, length({b}))),
          (m, i) -> named_struct('before', m.last, 'last',
            aggregate(sequence(1, length({b})), array(i), (row, j) -> concat(row, array(least(
              m.last[j] + 1, row[j-1] + 1, m.last[j-1] + if(substr({a}, i, 1) = substr({b}, j, 1), 0, 1),
              if(i > 1 and j > 1 and substr({a}, i, 1) = substr({b}, j-1, 1) and substr({a}, i-1, 1) = substr({b}, j, 1), m.before[j-2] + 1, 9999)))))),
          m -> m.last[length({b})]) end"""
    )


def wildcard_matches(pattern: Column, value: Column) -> Column:
    """An id, or the beginning of one where the pattern ends with ``*``; a null value never matches."""
    stem = F.substring(pattern, F.lit(1), F.length(pattern) - 1)
    return F.coalesce(F.when(pattern.endswith("*"), value.startswith(stem)).otherwise(pattern == value), F.lit(False))


def finite(value: Column) -> Column:
    """A number that can be a price or a measure: not null, NaN, negative or infinite."""
    return value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf"))
