"""Column functions on text: cleaning, counting, predicates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DEVANAGARI_DIGITS, DIGITS = "०१२३४५६७८९", "0123456789"


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no function for it. Nulls stay null."""
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def normalize_unicode(text: Column) -> Column:
    """CR and CRLF to LF, NFC, no zero-width characters or soft hyphens, no-break space to space."""
    text = nfc(F.regexp_replace(text, r"\r\n?", "\n"))
    return F.translate(text, " ​‌‍﻿­", " ")


def fix_ocr_en(text: Column) -> Column:
    """A line's first token of l and i alone before . or ) is a roman numeral of as many i, three at most."""
    for letters, numeral in (("[li]{3,}", "iii"), ("[li]{2}", "ii"), ("[li]", "i")):
        text = F.regexp_replace(text, rf"(?m)^([ \t]*\(?){letters}([.)])", rf"$1{numeral}$2")
    return text


def fix_ocr_hi(text: Column) -> Column:
    """Dates without inner blanks; runs of dandas become one."""
    text = F.regexp_replace(text, r"(?U)\b(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{4})\b", "$1.$2.$3")
    return F.regexp_replace(text, r"।(?:\s*।)+", "।")


def clean(text: Column, lang: Column) -> Column:
    text = normalize_unicode(text)
    return F.when(lang == "en", fix_ocr_en(text)).when(lang == "hi", fix_ocr_hi(text)).otherwise(F.raise_error(F.concat(F.lit("unknown language "), lang)))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, DEVANAGARI_DIGITS, DIGITS)


def normalize_hi(text: Column) -> Column:
    """For matching: NFC, no nukta, chandrabindu as anusvara, no joiners, single spaces."""
    text = F.translate(nfc(text), "ँ़‌‍", "ं")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def count_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)\s", "")).cast("long")


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(ascii_digits(text), F.lit(r"\d+(?:[./,\-]\d+)*"), F.lit(0))


def digit_groups(number: Column) -> Column:
    return F.filter(F.split(number, "[^0-9]"), lambda g: g != "")


# The two forms of case citations.
CITATIONS = (r"\(\d{4}\)\s*\d+\s*[A-Z][A-Za-z.]{0,8}\s*\d+", r"AIR\s*\d{4}\s*[A-Z]{1,5}\s*\d+")


def citations(text: Column) -> Column:
    """All citations: those of the first form, then those of the second."""
    return F.concat(*(F.regexp_extract_all(ascii_digits(text), F.lit(form), F.lit(0)) for form in CITATIONS))


def citation_kept(citation: Column, hypothesis: Column) -> Column:
    """Whether all digit groups stand in hypothesis in this order, with anything between."""
    return F.rlike(ascii_digits(hypothesis), F.concat(F.lit("(?s)"), F.array_join(digit_groups(citation), ".*")))


def length_ratio(hypothesis: Column, reference: Column) -> Column:
    h, r = count_chars(hypothesis), count_chars(reference)
    return F.when(r > 0, h / r).when(h == 0, 1.0).otherwise(F.lit(float("inf")))


def omission(ratio: Column) -> Column:
    return ratio < 0.6


def addition(ratio: Column) -> Column:
    return ratio > 1.6


def length_bucket(n: Column) -> Column:
    return F.when(n <= 20, "<=20").when(n <= 40, "21-40").otherwise(">40")


def repeated_char(text: Column) -> Column:
    """Ten equal characters in a row, other than white space in the sense of Python's."""
    return text.rlike(r"(?U)([^\s\x1c-\x1f])\1{9}")


# What a line of a page's closing disclaimer holds.
DISCLAIMER = ("उद्घो", "अस्वीकर", "भाषा में अनुवादित निर्णय")


def strip_disclaimer(page: Column) -> Column:
    """The page up to the first line that holds a part of the disclaimer; without one, the page."""
    return F.regexp_replace(page, rf"(?s)(?:\A|\n)[^\n]*(?:{'|'.join(DISCLAIMER)}).*", "")


def escape_cell(text: Column) -> Column:
    """For a cell of a Markdown table."""
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def normalized_hi(text: str) -> str:
    """normalize_hi of a constant."""
    text = unicodedata.normalize("NFC", text).translate({0x901: 0x902, 0x93C: None, 0x200C: None, 0x200D: None})
    return " ".join(text.split())


# Patterns of the qualitative categories.
ARCHAIC = r"(?i)hereinafter|the said|notwithstanding|aforesaid|thereof|therein|whereby|hereby|inter alia|learned counsel|leave granted|it is ordered|mutatis mutandis|in the facts and circumstances"
DATE = r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b"
SECTION = r"(?i)\b(?:Section|Article|Order|Rule)s?\.?\s*\d+"
CASE_NAME = r"\b[A-Z][A-Za-z.&'()]*\s+v\.?s?\.?\s+[A-Z][A-Za-z.&'()]*\b"
CAPITALISED = r"^[A-Z][a-zA-Z'.]*$"
COMMON_CAPITALS = ("The", "This", "Court", "High", "Supreme", "Act", "Section", "State")
LONG_WORDS = 45


def cites(text: Column) -> Column:
    """Whether the text holds a date, a section or a citation."""
    held = text.rlike(DATE) | text.rlike(SECTION)
    for form in CITATIONS:
        held = held | ascii_digits(text).rlike(form)
    return held


def names_someone(text: Column, words_: str) -> Column:
    """A case name, or two capitalised words that aren't common, in a row and not where a sentence begins. words_: the column of words."""
    bare = lambda i: F.regexp_replace(F.get(words_, i), r"^[(),;:\"]+|[(),;:\"]+$", "")
    name = lambda i: bare(i).rlike(CAPITALISED) & ~bare(i).isin(*COMMON_CAPITALS)
    places = F.when(F.size(words_) > 2, F.sequence(F.lit(1), F.size(words_) - 2)).otherwise(F.array().cast("array<int>"))
    return text.rlike(CASE_NAME) | F.exists(places, lambda i: ~F.get(words_, i - 1).rlike(r"[.!?]$") & name(i) & name(i + 1))
