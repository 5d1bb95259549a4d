"""Columns of text: normalization, cleaning, masking. Built-in expressions only, but for the full decomposition."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Sequence
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .terms import UI_NOISE_TERMS

SPACES = r"(?U)\s+"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse(c: Column | str) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(as_col(c), SPACES, " "))


@cache
def _decompositions() -> tuple[str, str]:
    """Characters that decompose to one other, then those that vanish (combining marks), by the Unicode tables."""
    one, other, gone = [], [], []
    for k in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= k < 0xE000:
            continue
        c = chr(k)
        if unicodedata.combining(c):
            gone.append(c)
            continue
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(d) == 1 and d != c and k < 0x10000:
            one.append(c)
            other.append(d)
    return "".join(one) + "".join(c for c in gone if ord(c) < 0x10000), "".join(other)


def strip_diacritics(c: Column | str) -> Column:
    """Compatibility decomposition without combining marks, for characters that become one other (not ligatures, not ½).

    The letter đ does not decompose and stays. :func:`strip_diacritics_full` covers all of Unicode.
    """
    return F.translate(as_col(c), *_decompositions())


@F.pandas_udf(StringType())
def strip_diacritics_full(s: pd.Series) -> pd.Series:
    """NFKD without combining marks, for all of Unicode; vectorized over Arrow batches."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def _plain(c: Column | str) -> Column:
    """No accents, lower case, URLs as spaces."""
    return F.regexp_replace(F.lower(strip_diacritics(c)), r"(?U)https?://\S+", " ")


def normalize_text(c: Column | str) -> Column:
    """Comparison key: no accents, lower case, URLs and all but a-z, 0-9 as spaces, collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_plain(c), r"(?U)[^a-z0-9\s]", " "), SPACES, " "))


def normalize_words(words: Column | str) -> Column:
    """Comparison keys of array elements that are neither null nor hold white space, by one pass over all of them: a step for
    each element would cost several times as much."""
    x = F.regexp_replace(_plain(F.array_join(words, "\n")), r"[^a-z0-9\n]+", " ")
    return F.transform(F.split(x, "\n"), lambda k: F.trim(k))


def lower_words(words: Column | str) -> Column:
    """Lower case of array elements that are neither null nor hold white space, by one pass over all of them."""
    return F.split(F.lower(F.array_join(words, " ")), " ")


def normalize_light(c: Column | str) -> Column:
    """Trimmed, lower case, collapsed; accents stay."""
    return F.lower(collapse(c))


@cache
def _vietnamese() -> tuple[str, str]:
    """Vietnamese letters and their base letters: tones on every vowel, and the marks that each vowel takes; đ to d."""
    tones = ["", "̀", "́", "̉", "̃", "̣"]
    marks = {"a": "̆̂", "e": "̂", "i": "", "o": "̛̂", "u": "̛", "y": ""}
    pairs = [("đ", "d"), ("Đ", "D")]
    for vowel, own in marks.items():
        for base in (vowel, vowel.upper()):
            for mark in ["", *own]:
                pairs += [(unicodedata.normalize("NFC", base + mark + tone), base) for tone in tones if mark or tone]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_vietnamese(c: Column | str) -> Column:
    """Vietnamese letters without their marks, one for one, đ to d; nothing else changes."""
    return F.translate(as_col(c), *_vietnamese())


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """Whether any of the terms is a substring."""
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return out


def count_terms(text: Column, terms: Sequence[str] | Column) -> Column:
    """How many of the terms are substrings; terms as a list or as an array column (empty ones never count)."""
    if isinstance(terms, Column):
        return F.size(F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: (t != "") & F.contains(text, t)))
    return sum((text.contains(t).cast("int") for t in terms), F.lit(0))


def marked_firsts(pairs: Column) -> Column:
    """Structs ``i, first, k, v`` of pairs ``v, k`` in their order: whether the key ``k`` occurs first there. Sorts, so long
    arrays don't cost the square of their length."""
    numbered = F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v")))
    mark = lambda s: F.transform(
        s, lambda x, i: F.struct(x["i"].alias("i"), ((i == 0) | (F.get(s, i - 1)["k"] != x["k"])).alias("first"), x["k"].alias("k"), x["v"].alias("v"))
    )
    return F.array_sort(let(F.array_sort(numbered), mark))


def first_by_keys(values: Column | str, keys: Column) -> Column:
    """Array elements of which the key, at their place in ``keys``, occurs first there; elements with an empty key go. Sorts too."""
    numbered = F.filter(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))), lambda p: p["k"] != "")
    heads = lambda s: F.transform(F.filter(s, lambda p, i: (i == 0) | (F.get(s, i - 1)["k"] != p["k"])), lambda p: p["i"])
    return let(as_col(values), lambda vs: F.transform(F.sort_array(let(F.sort_array(numbered), heads)), lambda i: F.get(vs, i)))


def first_by_key(values: Column, key: Callable[[Column], Column]) -> Column:
    """Array elements of which the key occurs first there; elements with an empty key go."""
    pairs = F.transform(values, lambda v: F.struct(v.alias("v"), key(v).alias("k")))
    return F.transform(F.filter(marked_firsts(F.filter(pairs, lambda p: p["k"] != "")), lambda p: p["first"]), lambda p: p["v"])


def _present(values: Column | str) -> Column:
    return F.coalesce(as_col(values).cast("array<string>"), F.array().cast("array<string>"))


def dedupe_keep_order(values: Column | str) -> Column:
    """Elements collapsed, first spelling of each comparison key; empty ones go."""
    kept = F.filter(F.transform(_present(values), lambda v: collapse(F.coalesce(v, F.lit("")))), lambda v: v != "")
    return first_by_key(kept, normalize_text)


def dedupe_ci(values: Column | str) -> Column:
    """Elements trimmed, first of each lower-case spelling (accents count); empty ones go."""
    return first_by_key(F.transform(_present(values), lambda v: F.trim(F.coalesce(v, F.lit("")))), F.lower)


def dedupe_exact(values: Column | str) -> Column:
    return F.filter(F.array_distinct(_present(values)), lambda v: v.isNotNull() & (v != ""))


def clean_payload(c: Column | str, noise: Sequence[str] = UI_NOISE_TERMS) -> Column:
    """Struct of ``cleaned`` text and ``quality_flags``.

    Lines are collapsed and stripped of outer spaces and hyphens; repeated lines, interface words and lines with a
    key under three characters go; the rest is joined by spaces. Flags in order of first occurrence, then ``too_short``
    for under 24 characters. If nothing is left, the original, trimmed. Null counts as empty.
    """
    value = F.coalesce(as_col(c), F.lit(""))
    lines = F.transform(F.split(value, r"[\r\n]+"), lambda x: F.regexp_replace(F.regexp_replace(x, SPACES, " "), r"^[ -]+|[ -]+$", ""))
    rows = F.filter(F.transform(lines, lambda v: F.struct(v.alias("v"), normalize_text(v).alias("k"))), lambda p: p["k"] != "")
    noisy = lambda p: p["k"].isin(*noise)
    valid = lambda p: ~noisy(p) & (F.length(p["k"]) >= 3)

    def result(ps: Column) -> Column:
        kept = F.transform(F.filter(ps, lambda p: valid(p) & p["first"]), lambda p: p["v"])
        what = lambda p: F.when(valid(p) & ~p["first"], "duplicate_line_removed").when(noisy(p), "ui_noise_removed")
        seen = F.array_distinct(F.filter(F.transform(ps, what), lambda x: x.isNotNull()))

        def finish(text: Column) -> Column:
            flags = F.when(F.length(text) < 24, F.concat(seen, F.array(F.lit("too_short")))).otherwise(seen)
            cleaned = F.when(text != "", text).otherwise(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))
            return F.struct(cleaned.alias("cleaned"), flags.alias("quality_flags"))

        return let(collapse(F.array_join(kept, " ")), finish)

    return let(marked_firsts(rows), result)


def mask_pii(c: Column | str) -> Column:
    """Phone numbers, then other long numbers, then e-mail addresses, each as its tag."""
    x = F.regexp_replace(as_col(c), r"(?U)\b0\d{9,10}\b", "[PHONE]")
    x = F.regexp_replace(x, r"(?U)\b\d{9,12}\b", "[ID_NUMBER]")
    return F.regexp_replace(x, r"(?U)[\w.+-]+@[\w-]+\.[\w.]+", "[EMAIL]")


def slugify(c: Column | str) -> Column:
    x = F.regexp_replace(normalize_text(F.translate(as_col(c), "đĐ", "dD")), "[^a-z0-9]+", "-")
    x = F.regexp_replace(x, "^-+|-+$", "")
    return F.when(x != "", x).otherwise("research")


def parse_ts(c: Column | str) -> Column:
    """ISO time; ``Z`` and offsets are read, none means UTC (the session's zone), anything else is null."""
    return F.try_to_timestamp(F.nullif(F.trim(as_col(c)), F.lit("")))


def elapsed_seconds(start: Column, end: Column) -> Column:
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / 1e6, 1)


def long_enough(record_type: Column, masked: Column, url: Column, post: int = 10, comment: int = 5) -> Column:
    """Length gate at collection: posts also need a URL."""
    n = F.length(F.coalesce(masked, F.lit("")))
    return F.when(record_type == "COMMENT", n >= comment).otherwise((n >= post) & (F.coalesce(url, F.lit("")) != ""))


def preview(c: Column | str, n: int = 180) -> Column:
    return F.substring(collapse(F.coalesce(as_col(c), F.lit(""))), 1, n)
