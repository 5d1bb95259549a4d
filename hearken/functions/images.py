"""Columns of images found in a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col, collapse, dedupe_ci


def image_context(html: Column | str, most: int = 8, kept: int = 3) -> Column:
    """Struct ``image_urls, image_alt_text, image_summary`` from the first ``most`` images; null if they give nothing."""
    tags = F.slice(F.regexp_extract_all(F.coalesce(as_col(html), F.lit("")), F.lit(r"(?is)(<img\b[^>]*>)"), F.lit(1)), 1, most)
    attr = lambda t, name: F.trim(F.regexp_extract(t, rf"""(?is)\s{name}\s*=\s*["']([^"']*)["']""", 1))
    hosted = lambda s: s.startswith("http") & s.contains("cdn") | s.startswith("http") & s.contains("scontent")
    urls = F.slice(dedupe_ci(F.filter(F.transform(tags, lambda t: attr(t, "src")), hosted)), 1, kept)
    alts = F.slice(dedupe_ci(F.filter(F.transform(tags, lambda t: collapse(attr(t, "alt"))), lambda a: F.length(a) > 1)), 1, kept)
    summary = F.when(F.size(urls) > 0, F.concat(F.size(urls).cast("string"), F.lit(" image(s) detected"))).otherwise("image alt text detected")
    found = F.struct(urls.alias("image_urls"), F.substring(F.array_join(alts, " | "), 1, 500).alias("image_alt_text"), summary.alias("image_summary"))
    return F.when((F.size(urls) > 0) | (F.size(alts) > 0), found)


def _filled(c: Column | str) -> Column:
    return F.trim(F.coalesce(as_col(c).cast("string"), F.lit(""))) != ""


def has_visual(urls: Column | str, alt: Column | str, summary: Column | str, ocr: Column | str | None = None) -> Column:
    some = F.exists(F.coalesce(as_col(urls), F.array().cast("array<string>")), lambda u: F.trim(F.coalesce(u, F.lit(""))) != "")
    out = some | _filled(alt) | _filled(summary)
    return out | _filled(ocr) if ocr is not None else out


def image_text(summary: Column | str, alt: Column | str, ocr: Column | str) -> Column:
    """Text already known about a record's images: summary or alt text, then what was read in them; at most 500 characters."""
    s = lambda c: F.trim(F.coalesce(as_col(c), F.lit("")))
    first = F.substring(F.coalesce(F.nullif(s(summary), F.lit("")), F.nullif(s(alt), F.lit("")), s(ocr)), 1, 240)
    read = F.substring(s(ocr), 1, 800)
    both = F.when(read != "", F.trim(F.concat(first, F.lit(" OCR: "), read))).otherwise(first)
    return F.substring(both, 1, 500)
