"""Text functions as Column expressions: whitespace, names, quotes, tokens, roman numerals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as whitespace, in a form that Java and RE2 read alike.
SPACE = r"[ \t\n\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# The letters of roman numerals.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE}+", " ")


def flat(c: Column) -> Column:
    """Whitespace runs as one space, none at the ends."""
    return F.trim(collapse(c))


def norm_quote(c: Column) -> Column:
    """For comparing quotes: flat, lower case, straight quotes and hyphens."""
    return F.translate(F.lower(flat(c)), "“”‘’—–", "\"\"''--")


def clean(c: Column) -> Column:
    """A name without control characters, flat."""
    return flat(F.regexp_replace(c, r"[\x00-\x1F\x7F]", " "))


def norm(c: Column) -> Column:
    """A name for comparing: no possessive, no leading article, no punctuation but - and _, flat, lower case."""
    s = F.regexp_replace(clean(c), r"(?U)[\x{2019}']s\b", "")
    s = F.regexp_replace(s, rf"(?i)^(the|a|an){SPACE}+", "")
    s = F.regexp_replace(s, r"[^\p{L}\p{N}_\s\x{C0}-\x{24F}-]", " ")
    return F.lower(flat(s))


def has_upper(c: Column) -> Column:
    return c.rlike(r"\p{Lu}")


def words(c: Column) -> Column:
    """The words of a normalised name, none for an empty one."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Search tokens: lower-case runs of letters and digits, Latin and Hangul."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9\x{C0}-\x{24F}\x{AC00}-\x{D7A3}]+"), F.lit(0))


def key_tokens(c: Column, weak: list[str] | tuple[str, ...] = ()) -> Column:
    """Words of more than two letters, without the weak ones (too common in the corpus to tell a name by) unless only those are
    there."""
    every = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.lower), lambda t: F.length(t) > 2))
    strong = F.array_except(every, F.array(*map(F.lit, weak)) if weak else F.array().cast("array<string>"))
    return F.when(F.size(strong) > 0, strong).otherwise(every)


def roman_to_int(c: Column) -> Column:
    """The value of a roman numeral, from the right: a digit below the largest seen so far is taken off."""
    value = lambda d: F.coalesce(*[F.when(d == k, F.lit(v)) for k, v in ROMAN.items()])
    digits = F.reverse(F.filter(F.split(c, ""), lambda d: d != ""))
    step = lambda s, d: F.struct((s["total"] + F.when(value(d) < s["top"], -value(d)).otherwise(value(d))).alias("total"), F.greatest(s["top"], value(d)).alias("top"))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("top"))
    return F.when(F.length(c) > 0, F.aggregate(digits, start, step, lambda s: s["total"]))
