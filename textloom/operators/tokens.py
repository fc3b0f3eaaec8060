"""Token counts of several tokenizers over parallel text, vocabularies, and language-model totals.

A counter turns a text to token ids; counters are given by name, and run a batch of texts at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from textloom.functions import text as T

Ids = Callable[[str], list[int]]


@dataclass(frozen=True)
class Tokenizer:
    """ids: a text's token ids without special tokens, by language where a tokenizer has a model for each. count: their number as a column of the text, if there is one. price: input and output dollars a million tokens."""

    name: str
    ids: Ids | dict[str, Ids]
    unknown: int | None = None
    family: str = ""
    price: tuple[float, float] | None = None
    max_length: int | None = None
    count: Callable[[Column], Column] | None = None

    def of(self, lang: str) -> Ids:
        return self.ids[lang] if isinstance(self.ids, dict) else self.ids


#: White space in the sense of Python's split.
_BLANK = r"(?U)[\s\x1c-\x1f]"


def _parts(text: Column) -> Column:
    """What stands between white space; empty at an end of the text that has some. Counts of one text share it."""
    return F.split(text, f"{_BLANK}+")


def _count_words(text: Column) -> Column:
    ends = F.left(text, F.lit(1)).rlike(_BLANK).cast("int") + F.right(text, F.lit(1)).rlike(_BLANK).cast("int")
    return F.size(_parts(text)) - ends - (text == "").cast("int")


# Offline counters: words, characters other than white space, and bytes.
WORDS = Tokenizer("words", lambda t: [len(w) for w in t.split()], count=_count_words)
CHARACTERS = Tokenizer("characters", lambda t: [ord(c) for c in "".join(t.split())], count=lambda t: F.length(F.array_join(_parts(t), "")))
BYTES = Tokenizer("bytes", lambda t: list(t.encode()), count=F.octet_length)


def sentencepiece_ids(path: str) -> Ids:
    """Ids of a SentencePiece model, loaded where it is first used."""
    loaded: list = []

    def ids(text: str) -> list[int]:
        if not loaded:
            import sentencepiece

            loaded.append(sentencepiece.SentencePieceProcessor(model_file=path))
        return loaded[0].encode(text)

    return ids


def chosen(tokenizers: Sequence[Tokenizer], names: Sequence[str] | None) -> list[Tokenizer]:
    """The tokenizers of the given names, all without names; an unknown name is an error."""
    if names is None:
        return list(tokenizers)
    if unknown := sorted(set(names) - {t.name for t in tokenizers}):
        raise ValueError(f"unknown tokenizers: {unknown}")
    return [t for t in tokenizers if t.name in names]


def token_ids(text: Column, ids: Ids) -> Column:
    @F.pandas_udf(ArrayType(LongType()))
    def encode(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(ids)

    return encode(text)


def counted(rows: DataFrame, keep: list[str], tokenizers: Sequence[Tokenizer]) -> DataFrame:
    """keep, tokenizer, tokens, unknown, words, chars of rows(keep, lang, text); keep must have lang.

    Tokenizers that count as columns do; the others read a batch of texts in one pass, ids of one text at a time.
    """
    slow = [t for t in tokenizers if t.count is None or t.unknown is not None]

    @F.pandas_udf(ArrayType(LongType()))
    def counts(texts: pd.Series, langs: pd.Series) -> pd.Series:
        out = []
        for text, lang in zip(texts.fillna(""), langs, strict=True):
            row: list[int] = []
            for t in slow:
                ids = t.of(lang)(text)
                row += [len(ids), 0 if t.unknown is None else ids.count(t.unknown)]
            out.append(row)
        return pd.Series(out)

    text = F.coalesce(F.col("text"), F.lit(""))

    def of(t: Tokenizer) -> Column:
        if t not in slow:
            return F.struct(F.lit(t.name).alias("tokenizer"), t.count(text).cast("long").alias("tokens"), F.lit(0).cast("long").alias("unknown"))
        k = 2 * slow.index(t)
        return F.struct(F.lit(t.name).alias("tokenizer"), F.get("__c", F.lit(k)).alias("tokens"), F.get("__c", F.lit(k + 1)).alias("unknown"))

    if slow:
        rows = rows.select(*keep, *(["text"] if "text" not in keep else []), counts("text", "lang").alias("__c"))
    rows = rows.select(*keep, F.array(*map(of, tokenizers)).alias("__e"), T.count_words(text).alias("words"), T.count_chars(text).alias("chars"))
    return rows.select(*keep, F.explode("__e").alias("e"), "words", "chars").select(*keep, "e.*", "words", "chars")


def _ratio(a: str, b: str) -> Column:
    """NaN where the divisor is 0."""
    return F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(float("nan")))


def corpus_stats(counts: DataFrame) -> DataFrame:
    """tokenizer, lang, tokens, words, chars, unknown, fertility, chars_per_token, unk_rate of counted rows."""
    sums = (F.sum(c).alias(c) for c in ("tokens", "words", "chars", "unknown"))
    return counts.groupBy("tokenizer", "lang").agg(*sums, _ratio("tokens", "words").alias("fertility"), _ratio("chars", "tokens").alias("chars_per_token"), _ratio("unknown", "tokens").alias("unk_rate"))


def pair_ratios(counts: DataFrame, pair: str, first: str = "en", second: str = "hi") -> DataFrame:
    """tokenizer, ratio (of all tokens, second to first) and median_ratio (of the pairs' ratios, without pairs that have no token in first)."""
    side = lambda lang: F.sum(F.when(F.col("lang") == lang, F.col("tokens")))
    pairs = counts.groupBy("tokenizer", pair).agg(side(first).alias("a"), side(second).alias("b"))
    return pairs.groupBy("tokenizer").agg(_ratio("b", "a").alias("ratio"), F.median(F.when(F.col("a") > 0, F.col("b") / F.col("a"))).alias("median_ratio"))


def over_limits(counts: DataFrame, limits: Sequence[int]) -> DataFrame:
    """tokenizer, lang, limit, pct_over: percent of the texts with more tokens."""
    share = F.coalesce(100.0 * F.avg((F.col("tokens") > F.col("limit")).cast("int")), F.lit(0.0))
    return counts.select("tokenizer", "lang", "tokens", F.explode(F.array(*map(F.lit, limits))).alias("limit")).groupBy("tokenizer", "lang", "limit").agg(share.alias("pct_over"))


def tokens_per_document(counts: DataFrame, document: str = "doc_id") -> DataFrame:
    """tokenizer, lang, tokens_per_document: the mean over documents of the tokens of all their texts."""
    return counts.groupBy("tokenizer", "lang", document).agg(F.sum("tokens").alias("tokens")).groupBy("tokenizer", "lang").agg(F.avg("tokens").alias("tokens_per_document"))


def study(train: DataFrame, test: DataFrame, documents: DataFrame, tokenizers: Sequence[Tokenizer], limits: Sequence[int] = (128, 256, 512), names: Sequence[str] | None = None, first: str = "en", second: str = "hi") -> DataFrame:
    """A row for each tokenizer, least fertility of the second language first: fertilities, characters a token, unknown rates, ratios, shares over limits and the model's own, tokens and cost of a document.

    train, test: (pair_id, lang, text); documents: (doc_id, lang, text), a row for each sentence.
    """
    tokenizers = chosen(tokenizers, names)
    trained = counted(train, ["pair_id", "lang"], tokenizers)
    stats = corpus_stats(trained).groupBy("tokenizer").pivot("lang", [first, second]).agg(*(F.first(c).alias(c) for c in ("fertility", "chars_per_token", "unk_rate")))
    tested = counted(test, ["pair_id", "lang"], tokenizers)
    over = over_limits(tested, limits).withColumn("name", F.format_string("pct_test_%s_over_%d", "lang", "limit"))
    over = over.groupBy("tokenizer").pivot("name", [f"pct_test_{lang}_over_{n}" for lang in (first, second) for n in limits]).agg(F.first("pct_over"))
    most = F.create_map(*(F.lit(x) for t in tokenizers for x in (t.name, t.max_length or -1)))
    longest = tested.where(F.col("lang") == second).withColumn("most", most[F.col("tokenizer")]).groupBy("tokenizer").agg((100.0 * F.avg(F.when(F.col("most") >= 0, (F.col("tokens") > F.col("most")).cast("int")))).alias(f"pct_test_{second}_over_model_max"))
    each = tokens_per_document(counted(documents, ["doc_id", "lang"], tokenizers)).groupBy("tokenizer").pivot("lang", [first, second]).agg(F.first("tokens_per_document"))
    each = each.withColumnsRenamed({lang: f"{lang}_tokens_per_document" for lang in (first, second)})
    out = stats.join(pair_ratios(trained, "pair_id", first, second), "tokenizer").join(over, "tokenizer", "left").join(longest, "tokenizer", "left").join(each, "tokenizer", "left")
    prices = F.create_map(*(F.lit(x) for t in tokenizers for x in (t.name, f"{t.price[0]},{t.price[1]}" if t.price else "")))
    price = F.split(F.nullif(prices[F.col("tokenizer")], F.lit("")), ",")
    cost = (F.col(f"{first}_tokens_per_document") * F.get(price, F.lit(0)).cast("double") + F.col(f"{second}_tokens_per_document") * F.get(price, F.lit(1)).cast("double")) / 1e6
    out = out.withColumn("cost_per_document", cost).withColumn("cost_per_1000", cost * 1000)
    numbers = [c for c, kind in out.dtypes if kind == "double"]
    return out.withColumns({c: F.round(c, 4) for c in numbers}).orderBy(f"{second}_fertility", "tokenizer")


def example(rows: DataFrame, keywords: Sequence[str], order: str, text: str = "text") -> DataFrame:
    """One row: the shortest text of 10 to 14 words with a keyword; else of 6 to 20 words the nearest to 12; else the text of most words. The first of equal ones."""
    has = F.lit(False)
    for word in keywords:
        has = has | F.contains(text, F.lit(word))
    n = T.count_words(F.col(text))
    tier = F.when(has & n.between(10, 14), 0).when(has & n.between(6, 20), 1).otherwise(2)
    near = F.when(tier == 0, n).when(tier == 1, F.abs(n - 12)).otherwise(-n)
    return rows.withColumn("__tier", tier).withColumn("__near", near).orderBy("__tier", "__near", order).limit(1).drop("__tier", "__near")


def cost_table(rows: Sequence[dict], first: str = "en", second: str = "hi", limit: int = 256) -> str:
    """Markdown of a study's collected rows."""
    head = f"| tokenizer | {first} tokens/document | {second} tokens/document | {second}/{first} | % test {second} > {limit} | cost/document (USD) |\n|---|---|---|---|---|---|"
    lines = [head]
    for r in rows:
        cost = "—" if r["cost_per_document"] is None else f"{r['cost_per_document']:.4f}"
        lines.append(f"| {r['tokenizer']} | {r[f'{first}_tokens_per_document']:.2f} | {r[f'{second}_tokens_per_document']:.2f} | {r['ratio']:.2f} | {r[f'pct_test_{second}_over_{limit}']:.1f} | {cost} |")
    return "\n".join(lines) + "\n"


SPACE = "▁"


def devanagari_piece(piece: Column) -> Column:
    """Whether a piece, but for the mark of a word's start, is Devanagari alone."""
    return F.replace(piece, F.lit(SPACE), F.lit("")).rlike("^[\\u0900-\\u097F]+$")


def init_map(added: DataFrame, ids: Ids) -> DataFrame:
    """new_id, old_ids: the old tokenizer's ids of the text that each of added(piece, new_id) stands for. Blank pieces, and those without ids, go."""
    surface = F.replace("piece", F.lit(SPACE), F.lit(" "))
    rows = added.where(F.trim(surface) != "").select("new_id", token_ids(surface, ids).alias("old_ids"))
    return rows.where(F.size("old_ids") > 0)


def init_summary(mapped: DataFrame, old_size: int, new_size: int) -> DataFrame:
    """old_vocab_size, new_vocab_size, n_initialised, mean_sub_tokens_per_new_token."""
    return mapped.agg(F.lit(old_size).alias("old_vocab_size"), F.lit(new_size).alias("new_vocab_size"), F.count(F.lit(1)).alias("n_initialised"), F.coalesce(F.avg(F.size("old_ids")), F.lit(0.0)).alias("mean_sub_tokens_per_new_token"))


def fertility_reduction(stats: DataFrame, base: str) -> DataFrame:
    """tokenizer, lang, fertility, base_fertility, reduction_pct: how many percent fewer tokens a word than the base tokenizer."""
    of_base = stats.where(F.col("tokenizer") == base).select("lang", F.col("fertility").alias("base_fertility"))
    rows = stats.select("tokenizer", "lang", "fertility").join(F.broadcast(of_base), "lang")
    return rows.select("tokenizer", "lang", "fertility", "base_fertility", (100 * (1 - F.col("fertility") / F.col("base_fertility"))).alias("reduction_pct"))


def encoded_batch(ids: Column, bos: int, pad: int, longest: Column) -> tuple[Column, Column]:
    """The ids with bos first and pad behind up to longest + 1, and a mask of what isn't padding."""
    whole = F.concat(F.array(F.lit(bos)).cast("array<bigint>"), ids)
    gap = F.greatest(longest + 1 - F.size(whole), F.lit(0))
    return F.concat(whole, F.array_repeat(F.lit(pad).cast("long"), gap)), F.concat(F.array_repeat(F.lit(1), F.size(whole)), F.array_repeat(F.lit(0), gap))


def language_model_metrics(sums: DataFrame) -> DataFrame:
    """sums(total_tokens, total_nll, total_new_tokens, n_sentences, total_chars) with mean_tokens_per_sentence, bits_per_char, perplexity and new_token_share, NaN where there is nothing to divide by."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(float("nan")))
    return sums.select(
        "*", ratio("total_tokens", "n_sentences").alias("mean_tokens_per_sentence"), (ratio("total_nll", "total_chars") / math.log(2)).alias("bits_per_char"),
        F.exp(ratio("total_nll", "total_tokens")).alias("perplexity"), ratio("total_new_tokens", "total_tokens").alias("new_token_share"),
    )
