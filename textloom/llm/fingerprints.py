"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A text's weighted terms are its words with their counts. For each of SAMPLES hash functions every
term draws r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1) from its hash, and t = floor(ln w / r + b). The
term of least ln a = ln c - r (t - b + 1) is the sample, and (term, t) its value: two texts agree in
a sample with a probability equal to the generalised Jaccard similarity of their weights.

The draws come from three exponentials: with a1 = e1, z = ln((e1 + e2) / e1) and r = z + e3, b is
1 - z / r and c is a1 exp(z), which have the joint distribution above. Then t is 0 where ln w < z,
else floor((ln w - z) / r) + 1, and a = a1 exp(-r t). So a word that comes once needs its hash alone:
t is 0 and a1 its sample. Samples are compared by 1 - exp(-a), in steps of 2^-31; that of a1 is the
upper bits of the hash.
"""

from __future__ import annotations

from hashlib import blake2b

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import text_or_empty

#: Samples, and how many of them a row draws for a word that comes once: with more, the generated code is too long for the JVM to compile.
SAMPLES, GROUP = 64, 8
#: Documents in one bucket of consecutive ids; buckets are cut twice, each time in so many parts at most.
BUCKET_ROWS, CUTS = 200, 1000
#: What tells the hash functions of a group apart: signed 64-bit.
SALTS = [int.from_bytes(blake2b(k.to_bytes(4), digest_size=8).digest(), signed=True) for k in range(GROUP)]


def _bits(h: Column, low: int, n: int) -> Column:
    return F.shiftrightunsigned(h, low).bitwiseAND(F.lit((1 << n) - 1)) if low else h.bitwiseAND(F.lit((1 << n) - 1))


def _uniform(h: Column, low: int) -> Column:
    return (_bits(h, low, 20) + F.lit(0.5)) / F.lit(float(1 << 20))


def _drawn(h: Column, m: Column, rows: DataFrame) -> DataFrame:
    """rows with __drawn: the sample of a word that comes w > 1 times, from h and the bits m hashed from it; null where w is 1.

    It is 1 - exp(-a), scaled to 31 bits, above the 32 bits that name (term, t). Steps that need
    logarithms are columns of their own, so that each is made once and only for words that need it:
    with z = ln(1 + x), t is 0 where x > w - 1, and exp(-r) is g = u / (1 + x) with u = exp(-e3).
    """
    below = (F.shiftrightunsigned("__h", 33) + F.lit(0.5)) / F.lit(float(1 << 31))  # 1 - exp(-a1)
    rows = rows.withColumn("__h", h).withColumn("__m", m)
    # ln(u2) / ln(1 - below) is e2 / e1. Where u2 is below 1 - (w - 1) below, and so below the power w - 1 of 1 - below, x is above w - 1.
    in_doubt = _uniform(F.col("__m"), 0) >= 1 - (F.col("__w") - 1) * below
    rows = rows.withColumn("__l", F.when(in_doubt, F.log1p(-below)))
    rows = rows.withColumn("__x", F.ln(F.when(F.col("__l").isNotNull(), _uniform(F.col("__m"), 0))) / F.col("__l"))
    rows = rows.withColumn("__g", F.when(F.col("__x") <= F.col("__w") - 1, _uniform(F.col("__m"), 20) / (1 + F.col("__x"))))
    # t is the number of times that 1 + x times powers of 1 / g stays at w or less.
    room = F.col("__w") / (1 + F.col("__x"))
    turns = F.when(room * F.col("__g") < 1, 1).when(room * F.col("__g") * F.col("__g") < 1, 2).otherwise(F.floor(-F.ln(room) / F.ln("__g")) + 1)
    rows = rows.withColumn("__t", F.when(F.col("__g").isNotNull(), turns.cast("long")))
    shrunk = F.when(F.col("__t") == 1, F.col("__g")).when(F.col("__t") == 2, F.col("__g") * F.col("__g")).otherwise(F.exp(F.ln("__g") * F.col("__t")))
    scaled = (-F.expm1(shrunk * F.col("__l")) * float(1 << 31)).cast("long")
    name = F.shiftrightunsigned("__h", 1).bitwiseXOR(F.col("__t") * F.lit(40503)).bitwiseAND(F.lit((1 << 32) - 1))
    sample = F.when(F.col("__t").isNull(), F.shiftrightunsigned("__h", 1)).otherwise(F.shiftleft(scaled, 32).bitwiseOR(name))
    return rows.withColumn("__drawn", F.when(F.col("__w") > 1, sample))


def _samples(terms: DataFrame, keep: list[str]) -> DataFrame:
    """keep, __part and __s0, __s1, …: the samples of a part of the hash functions, the least of which counts. Reads __term and __w.

    Most words come once. Such a word has a row for each part, with all samples of the part, hashes
    alone; another has a row for each sample, the others being null.
    """
    parts = range(SAMPLES // GROUP)
    slot = lambda p, k: F.struct(F.lit(p).alias("__part"), F.lit(k).alias("__k"), F.lit(SALTS[k] if k >= 0 else 0).alias("__salt"))
    once, often = F.array(*(slot(p, -1) for p in parts)), F.array(*(slot(p, k) for p in parts for k in range(GROUP)))
    rows = terms.select(*keep, "__term", "__w", F.explode(F.when(F.col("__w") == 1, once).otherwise(often)).alias("__slot"))
    rows = rows.select(*keep, "__w", "__slot.__part", "__slot.__k", "__slot.__salt", F.xxhash64("__term", "__slot.__part").alias("__term"))
    hashed = F.when(F.col("__w") > 1, F.xxhash64(F.col("__term").bitwiseXOR(F.col("__salt"))))
    rows = _drawn(hashed, F.when(F.col("__w") > 1, F.xxhash64("__h")), rows)
    plain = lambda k: F.shiftrightunsigned(F.xxhash64(F.col("__term").bitwiseXOR(F.lit(SALTS[k]))), 1)
    return rows.select(*keep, "__part", *(F.when(F.col("__k") < 0, plain(k)).when(F.col("__k") == k, F.col("__drawn")).alias(f"__s{k}") for k in range(GROUP)))


def signatures(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and fingerprint, SAMPLES groups of eight hex digits, for each distinct value of keys.

    Where the rows already lie together by some of the keys, nothing is shuffled. Words are what
    white space separates; an empty text has the empty word. Equal texts have equal fingerprints.
    """
    words = texts.select(*keys, F.explode(F.split(F.col(text), r"\s+")).alias("__word"))
    terms = words.groupBy(*keys, F.xxhash64("__word").alias("__term")).agg(F.count(F.lit(1)).alias("__w"))
    least = _samples(terms, keys).groupBy(*keys, "__part").agg(*(F.min(f"__s{k}").alias(f"__s{k}") for k in range(GROUP)))
    digits = [F.lpad(F.lower(F.hex(F.col(f"__s{k}").bitwiseAND(F.lit((1 << 32) - 1)))), 8, "0") for k in range(GROUP)]
    parts = least.select(*keys, "__part", F.concat(*digits).alias("__digits"))
    whole = [F.max(F.when(F.col("__part") == p, F.col("__digits"))).alias(f"__p{p}") for p in range(SAMPLES // GROUP)]
    return parts.groupBy(*keys).agg(*whole).select(*keys, F.concat(*(f"__p{p}" for p in range(SAMPLES // GROUP))).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples, an estimate of the generalised Jaccard similarity."""
    same = sum((F.substring(a, 8 * k + 1, 8) == F.substring(b, 8 * k + 1, 8)).cast("int") for k in range(SAMPLES))
    return same / F.lit(float(SAMPLES))


def _place(bounds: Column) -> Column:
    """How many of the ascending bounds are at most doc_id, by binary search."""
    steps = F.array(*(F.lit(1 << k) for k in range(CUTS.bit_length() - 1, -1, -1)))
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= F.size(bounds)) & (F.get(bounds, p + s - 1) <= F.col("doc_id")), p + s).otherwise(p)), F.lit(0))


def _bucketed(docs: DataFrame) -> DataFrame:
    """docs with b, the number of a range of consecutive doc_id of about BUCKET_ROWS rows, nulls in the first.

    The ranges' ends are quantiles of quantiles, CUTS of CUTS at most: a table of fixed size. Beyond
    CUTS * CUTS * BUCKET_ROWS rows the ranges hold more rows each.
    """
    ranges = -(-docs.count() // BUCKET_ROWS)
    if ranges <= 1:
        return docs.withColumn("b", F.lit(0).cast("long"))
    coarse = min(CUTS, max(1, -(-ranges // CUTS)))
    fine = min(CUTS, -(-ranges // coarse))

    def ends(n: int) -> Column:
        """The distinct quantiles that cut the rows in n parts."""
        at = [i / n for i in range(1, n)]
        return F.array_sort(F.array_distinct(F.percentile_approx("doc_id", F.array(*map(F.lit, at)), 20 * n))) if at else F.array().cast("array<bigint>")

    first = docs.agg(ends(coarse).alias("bounds"))
    docs = docs.crossJoin(F.broadcast(first)).withColumn("c", _place(F.col("bounds"))).drop("bounds")
    second = docs.groupBy("c").agg(ends(fine).alias("bounds"))  # at most CUTS rows of at most CUTS numbers
    return docs.join(F.broadcast(second), "c").withColumn("b", F.col("c").cast("long") * CUTS + _place(F.coalesce("bounds", F.array().cast("array<bigint>")))).drop("c", "bounds")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: its last half replaced from the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Documents follow one another by doc_id, nulls first, then by text; the first follows the last, so
    a single document is its own next. Null texts count as empty; an empty text is its own edited
    text. Rows of one doc_id are ordered in one task. Other columns are not read. An empty table
    gives an empty result.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    dealt = _bucketed(plain)
    # The first rows of a bucket also go to the end of the bucket before it, those of the first to the last.
    starts = dealt.groupBy("b").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("least"))
    by_number = Window.orderBy("b")  # at most CUTS * CUTS rows of numbers
    last = F.max("b").over(by_number.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    leads = starts.select("b", F.col("least.doc_id").alias("lead_id"), F.coalesce(F.lag("b").over(by_number), last).alias("before"))
    own = F.struct(F.col("b").alias("b"), F.lit(0).alias("late"))
    extra = F.struct(F.col("before").alias("b"), F.lit(1).alias("late"))
    is_lead = F.col("doc_id").eqNullSafe(F.col("lead_id"))
    placed = dealt.join(F.broadcast(leads), "b").select("doc_id", "text", F.explode(F.when(is_lead, F.array(own, extra)).otherwise(F.array(own))).alias("to")).select("to.b", "to.late", "doc_id", "text")
    in_order = Window.partitionBy("b").orderBy("late", "doc_id", "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = placed.select("b", "late", "doc_id", "text", F.row_number().over(in_order).alias("pos"), F.lead("text").over(in_order).alias("next"))
    rows = rows.select("b", "pos", "late", "doc_id", "text", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half)).alias("edited"))
    both = rows.select("b", "pos", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("t")).select("b", "pos", "t.which", "t.text")
    prints = signatures(both, ["b", "pos", "which"])
    prints = prints.groupBy("b", "pos").agg(*(F.max(F.when(F.col("which") == k, F.col("fingerprint"))).alias(name) for k, name in enumerate(("fingerprint", "edited_fingerprint"))))
    facts = rows.select("b", "pos", "late", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    joined = facts.join(prints, ["b", "pos"]).withColumn("next", F.lead("fingerprint").over(Window.partitionBy("b").orderBy("pos")))
    return joined.where("late = 0").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )
