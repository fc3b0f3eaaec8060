"""Lines to segments to sentences, within each row by higher-order functions: nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

# What opens a list item, and what ends a paragraph.
MARKER = r"^(?:\d{1,3}(?:\.\d{1,3})*\.(?:\s|$)|\d{1,3}(?:\.\d{1,3})+(?:\s|$)|\(?[ivxlc]{1,6}[.)](?:\s|$)|\([a-zA-Z]\)(?:\s|$)|[a-z]\)(?:\s|$))"
ENDERS = ".?!:;।\"”’"
# Words whose full stop ends no sentence.
ABBREVIATIONS_EN = (
    "no", "nos", "vs", "v", "mr", "mrs", "ms", "dr", "sr", "jr", "ltd", "pvt", "co", "corp",
    "inc", "st", "hon", "ors", "anr", "etc", "viz", "i.e", "e.g", "cf", "art", "arts", "sec",
    "secs", "s", "ss", "cl", "para", "paras", "p", "pp", "vol", "cr", "crl", "civ", "govt",
    "dept", "addl", "asst", "dist", "distt", "div", "sri", "smt", "shri", "kum", "j", "jj",
    "cj", "rs", "ch", "ibid", "approx", "sl", "nr", "regd", "misc", "spl", "ex", "u/s",
)
ABBREVIATIONS_HI = ("सं", "क्र", "नं", "डॉ", "श्री", "प्र", "पृ", "मा", "उ.प्र", "वि", "अनु", "पं")

_CLOSE_EN, _CLOSE_HI, _DEVANAGARI = r"[\"”’)\]]*", r"[\"”’]*", "ऀ-ॿ"


def unwrap(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, seg_idx and segment: each row's hard-wrapped lines joined to paragraphs.

    A line opens a segment if it has a marker, or if a blank line stands before it and the line
    before ends a sentence. Lines of digits alone are page numbers and leave no trace. A lower-case
    line after a hyphen at a line's end joins without a space. Rows stay apart whatever their ids;
    null and empty texts have no segment.
    """
    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    rows = docs.select(*keep, F.filter(lines, lambda x: ~x.rlike(r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]+$")).alias("all"))
    after_blank = lambda x, i: F.struct(x.alias("line"), F.when(i > 0, F.get("all", i - 1) == "").otherwise(False).alias("gap"))
    rows = rows.select(*keep, F.filter(F.transform("all", after_blank), lambda k: k["line"] != "").alias("solid"))

    def glued(k: Column, i: Column) -> Column:
        before = F.get("solid", i - 1)["line"]
        opens = k["line"].rlike(MARKER) | (k["gap"] & F.right(before, F.lit(1)).isin(*ENDERS))
        hyphen = before.endswith("-") & k["line"].rlike("^[a-z]")
        return F.concat(F.when(i == 0, "").when(opens, "\n").when(hyphen, "").otherwise(" "), k["line"])

    joined = F.split(F.array_join(F.transform("solid", glued), ""), "\n")
    tidy = F.transform(joined, lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " ")))
    return rows.select(*keep, F.posexplode(F.filter(tidy, lambda s: s != "")).alias("seg_idx", "segment")).withColumn("seg_idx", F.col("seg_idx").cast("long"))


def _ends_en(w: Column, following: Column, first: Column) -> Column:
    word = F.regexp_extract(w, rf"([A-Za-z][A-Za-z0-9]*(?:\.[A-Za-z0-9]+)*)[.?!]{_CLOSE_EN}$", 1)
    short = word.rlike(r"^[A-Za-z](\.[A-Za-z])*$") | F.lower(word).isin(*ABBREVIATIONS_EN)
    return w.rlike(rf"[.?!]{_CLOSE_EN}$") & following.rlike(r"^[A-Z0-9\"“‘'(\[]") & ~short & ~(first & w.rlike(MARKER))


def _ends_hi(w: Column, following: Column, first: Column) -> Column:
    word = F.regexp_extract(w, rf"([{_DEVANAGARI}]+(?:\.[{_DEVANAGARI}]+)*)\.{_CLOSE_HI}$", 1)
    bare = F.replace(word, F.lit("."), F.lit(""))
    short = (F.length(bare) < 3) | word.isin(*ABBREVIATIONS_HI) | word.rlike(rf"^([{_DEVANAGARI}]{{1,3}}\.)+[{_DEVANAGARI}]{{1,3}}$")
    return (w.rlike(rf"[।?!]{_CLOSE_HI}$") | (w.rlike(rf"\.{_CLOSE_HI}$") & ~short)) & ~(first & w.rlike(MARKER))


def split_sentences(segments: DataFrame, lang: str = "en", keep: tuple[str, ...] = ("doc_id", "seg_idx")) -> DataFrame:
    """The columns of keep, sent_idx and sentence: the segments' sentences in order."""
    if lang not in ("en", "hi"):
        raise ValueError(f"unknown language {lang}")
    source = F.col("segment") if lang == "en" else F.regexp_replace("segment", rf"(।{_CLOSE_HI})(?=\S)", "$1 ")
    ends = _ends_en if lang == "en" else _ends_hi
    rows = segments.select(*keep, F.split(source, " ").alias("__w"))
    marked = F.transform("__w", lambda w, i: F.concat(w, F.when(ends(w, F.coalesce(F.get("__w", i + 1), F.lit("")), i == 0), "\n").otherwise(" ")))
    sentences = F.filter(F.transform(F.split(F.array_join(marked, ""), "\n"), lambda s: F.trim(s)), lambda s: s != "")
    return rows.select(*keep, F.posexplode(sentences).alias("sent_idx", "sentence"))


def segment_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """Cleaned, unwrapped and split documents of en and hi; another lang is an error. keep must have lang."""
    cleaned = docs.withColumn("text", T.clean(F.col("text"), F.col("lang")))
    segments = unwrap(cleaned, keep)
    keep = (*keep, "seg_idx")
    return split_sentences(segments.where("lang = 'en'"), "en", keep).union(split_sentences(segments.where("lang <> 'en'"), "hi", keep))


def leading_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^\s*(\d{1,3})\.(?:\s|$)", 1), F.lit("")).cast("int")
