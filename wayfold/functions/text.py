"""Scalar functions on text: normal forms, classifiers and canonical hashes, native where Spark has them."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse_lower(x) -> Column:
    """Lower case, white space collapsed, trimmed."""
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def plain_label(x) -> Column:
    """Lower case without parenthesised parts, only a-z and 0-9."""
    return F.regexp_replace(F.lower(F.regexp_replace(x, r"\([^)]*\)", "")), "[^a-z0-9]", "")


def without_punctuation(x) -> Column:
    """Lower case without , . ; : ' and ", white space collapsed and trimmed; all other marks stay, hyphens too."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(x, "[,.;:'\"]", "")), r"(?U)\s+", " "))


#: The words that a word-set key leaves out, and the endings that are merged, in order.
STOP_WORDS = ("of", "the", "and")
PLURALS = (("men", "man"), ("virgins", "virgin"), ("champions", "champion"), ("beasts", "beast"))


def wordset_key(x, stop: Sequence[str] = STOP_WORDS) -> Column:
    """The sorted words of without_punctuation() without stop words, repeated words kept."""
    kept = F.filter(F.split(without_punctuation(x), " "), lambda w: (w != "") & ~w.isin(list(stop)))
    return F.array_join(F.array_sort(kept), " ")


def merge_plural(x, endings: Sequence[tuple[str, str]] = PLURALS) -> Column:
    """The text with its last word in lower case and that word's ending replaced by the first rule that fits; without one, as it is."""
    words = F.split(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), " ")
    last = F.lower(F.element_at(words, -1))
    out = F
    for plural, one in endings:
        cut = F.substring(last, F.lit(1), F.length(last) - len(plural))
        out = out.when(last.endswith(plural), F.array_join(F.concat(F.slice(words, F.lit(1), F.size(words) - 1), F.array(F.concat(cut, F.lit(one)))), " "))
    return out.otherwise(x) if endings else x


def has_cjk(x) -> Column:
    return x.rlike("[\\u4e00-\\u9fff]")


def _pandas(f):
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(f, na_action="ignore")

    return run


def nfkc(x) -> Column:
    return _pandas(lambda s: unicodedata.normalize("NFKC", s))(x)


def nfkd(x) -> Column:
    return _pandas(lambda s: unicodedata.normalize("NFKD", s))(x)


def casefold(x) -> Column:
    return _pandas(str.casefold)(x)


def first_match(x: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The class of the first rule (pattern, class) whose pattern is found."""
    out = F
    for pattern, name in rules:
        out = out.when(x.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit(default)) if rules else F.lit(default)


def slug(x) -> Column:
    """a-z, 0-9 and single dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def bracket_parts(x) -> tuple[Column, Column]:
    """main and inner of `main (inner)`; inner is null without brackets."""
    inner = F.regexp_extract(x, r"^(.*?)\s*\(([^()]*)\)\s*$", 2)
    return F.when(inner != "", F.regexp_extract(x, r"^(.*?)\s*\(([^()]*)\)\s*$", 1)).otherwise(x), F.when(inner != "", inner)


def content_id(x: Column, length: int = 16) -> Column:
    """The first hex digits of the SHA-256 of a struct's canonical JSON; fields must be in sorted order."""
    return F.substring(F.sha2(F.to_json(x), 256), 1, length)


def group_semantics(n: Column) -> Column:
    """AND, OR or MAIN by the sign of a condition group's number, and its alias."""
    return F.when(n > 0, "AND").when(n < 0, "OR").otherwise("MAIN")


def group_alias(n: Column) -> Column:
    return F.when(n == 0, "MAIN").otherwise(F.concat(group_semantics(n), F.lit("_"), F.lpad(F.abs(n).cast("string"), 2, "0")))


def reverse_bits(n: Column) -> Column:
    """The bits of a byte in reverse."""
    return F.conv(F.reverse(F.lpad(F.bin(n), 8, "0")), 2, 10).cast("int")


def align(n: Column, size: int) -> Column:
    return F.floor((n + (size - 1)) / size) * size


def truthy_or(x: Column, default) -> Column:
    """x, or the default if x is null, empty or zero."""
    return F.when(x.isNull() | (x.cast("string").isin("", "0", "0.0", "false")), F.lit(default)).otherwise(x)


def layer_of_text(x) -> Column:
    """underground or legacy by a word of the text, whatever its case, else surface."""
    return F.when(x.rlike("(?i)underground|depths|well"), "underground").when(x.rlike("(?i)castle|academy|manor|legacy"), "legacy").otherwise("surface")


def ascii_label(x) -> Column:
    """plain_label() of the compatibility decomposition: accents fall away with what is not a-z or 0-9."""
    return plain_label(nfkd(x))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def digits_only(x: Column) -> Column:
    """The number that the text consists of; null unless it is digits alone."""
    return F.when(x.rlike("^[0-9]+$"), x.try_cast("bigint"))


def _without_number(x: Column) -> Column:
    """Without {n}, then without an upper or lower mark in brackets, at the end."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)\s*\{\d+\}\s*$", ""), r"(?U)\s*\(\s*[下上]\s*\)\s*$", "")


def end_side(x) -> Column:
    """lower or upper, if the text in compatibility form ends with such a word, else null; a null text counts as empty."""
    t = _without_number(F.regexp_replace(nfkc(F.coalesce(x, F.lit(""))), r"(?U)^\s+|\s+$", ""))
    return F.when(t.rlike(r"(?Ui)(?:下側|下|lower|bottom)\s*$"), "lower").when(t.rlike(r"(?Ui)(?:上側|上|upper|top)\s*$"), "upper")


def side_free_label(x) -> Column:
    """The case-folded compatibility form without number, side and white space, so that both sides of one thing are equal."""
    t = _without_number(casefold(nfkc(F.coalesce(x, F.lit("")))))
    return F.regexp_replace(F.regexp_replace(t, r"(?U)(?:下側|上側|下|上|lower|upper|bottom|top)\s*$", ""), r"(?U)\s+", "")
