"""The base library on literal cases, and its queries on the smallest tables against SQL."""

import glob
import os
import random
import re
import shutil
import subprocess
import sys
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from textloom.functions import text as T
from textloom.operators import align, evaluation, inference, metrics, report, segment, tokens
from textloom.plans import catalog
from textloom.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_cleaning(spark):
    assert one(spark, T.fix_ocr_en(F.lit("li. a\nlili. b\n(li) c\nDelhi. d li"))) == "ii. a\niii. b\n(ii) c\nDelhi. d li"
    assert one(spark, T.fix_ocr_hi(F.lit("15. 06. 2006 । । ।"))) == "15.06.2006 ।"
    assert one(spark, T.fix_ocr_hi(F.lit("115. 06. 2006"))) == "115. 06. 2006"
    assert one(spark, T.normalize_unicode(F.lit("\ufeffa\r\nb\u200dc\u00a0d\re"))) == "a\nbc d\ne"
    assert one(spark, T.ascii_digits(F.lit("२७.०५"))) == "27.05"
    assert one(spark, T.normalize_hi(F.lit(" ड़ हँ\u200d  क "))) == "ड हं क" == T.normalized_hi(" ड़ हँ\u200d  क ")
    assert one(spark, T.strip_disclaimer(F.lit("एक\nदो\nउद्घोष्णा तीन\nचार"))) == "एक\nदो"
    assert one(spark, T.strip_disclaimer(F.lit("अस्वीकरण\nक"))) == "" and one(spark, T.strip_disclaimer(F.lit("क\nख"))) == "क\nख"
    assert one(spark, T.escape_cell(F.lit("a|b\nc"))) == "a\\|b c"
    with pytest.raises(Exception, match="unknown language"):
        one(spark, T.clean(F.lit("a"), F.lit("fr")))


@pytest.mark.parametrize("line", ["12. a", "1.2.3 a", "1.2.3. a", "(iv) a", "iv) a", "ii. a", "(a) x", "(A) x", "a) x", "(ii)"])
def test_markers(line):
    assert re.match(segment.MARKER, line)


def test_what_is_no_marker():
    assert not any(re.match(segment.MARKER, line) for line in ("12 apples", "(ab) x", "A) x", "1234. x", "civilian. x", "iv"))


def segments_of(spark, *texts):
    rows = segment.unwrap(spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string")).collect()
    return [r["segment"] for r in rows]


def test_segments(spark):
    assert segments_of(spark, "This is wrapped\nhere.\n\n2. Second para-\ngraph one.\n17\n(a) third") == ["This is wrapped here.", "2. Second para-graph one.", "(a) third"]
    assert segments_of(spark, "a\n\nb") == ["a b"] and segments_of(spark, "a.\n\nb", "c", None, "", "\n \n१२\n") == ["a.", "b", "c"]
    assert segments_of(spark, "a\nb", "c\nd") == ["a b", "c d"]  # rows of one id stay apart


def sentences_of(spark, text, lang):
    rows = spark.createDataFrame([(1, 0, text)], "doc_id long, seg_idx long, segment string")
    return [r["sentence"] for r in segment.split_sentences(rows, lang).orderBy("sent_idx").collect()]


@pytest.mark.parametrize(
    ("lang", "text", "n"),
    [
        ("en", "See No. 55 of Smt. Devi. Then go. R. K. left", 3), ("en", "The Crl. Appeal of U.P. State vs. Ram. He won.", 2), ("en", "7. We agree. (ii) No!", 2), ("en", "Section 366.1. applies here", 1),
        ("en", "He said \"stop.\" Then left? Yes.", 3), ("en", "see viz. This and cf. That and e.g. Those", 1), ("en", "lower. case follows", 1),
        ("hi", "राम गया। वह आया? हाँ", 3), ("hi", "सं. 55 है। ठीक", 2), ("hi", "उ.प्र. राज्य। ठीक", 2), ("hi", "राम गया।वह आया।", 2), ("hi", "the word. यह", 1), ("hi", "वह घर गया. फिर आया", 2),
    ],
)
def test_sentences(spark, lang, text, n):
    found = sentences_of(spark, text, lang)
    assert len(found) == n and "".join(found).replace(" ", "") == text.replace(" ", "")


def test_documents_by_language(spark):
    docs = spark.createDataFrame([(1, "en", "li. One. Two\r\nthree."), (2, "hi", "एक।दो 1. 2. 2003")], "doc_id long, lang string, text string")
    rows = segment.segment_documents(docs).orderBy("doc_id", "seg_idx", "sent_idx").collect()
    assert [r["sentence"] for r in rows] == ["ii. One.", "Two three.", "एक।", "दो 1.2.2003"]
    assert [one(spark, segment.leading_number(F.lit(t))) for t in ("7. We", "(ii) a", "12", " 3. x", "1234. a")] == [7, None, None, 3, None]


def test_fidelity(spark):
    rows = spark.createDataFrame([(1, "27.05.2003 and 302/34", "27-05-2003 but 302"), (2, "५ 5", "5"), (2, "none", "5"), (3, None, "x")], "k long, s string, h string")
    assert sorted((r["k"], r["total"], r["preserved"]) for r in evaluation.number_fidelity(rows, ["k"], "s", "h").collect()) == [(1, 2, 1), (2, 0, 0), (2, 2, 1), (3, 0, 0)]
    assert one(spark, T.numbers(F.lit("on 27.05.2003, 302/34, १,५०,००० and 5"))) == ["27.05.2003", "302/34", "1,50,000", "5"]
    assert one(spark, T.citations(F.lit("(2004) 3 JT 100, AIR 1961 All 12 AIR 1990 SC 45 (2019) 5 SCC 123"))) == ["(2004) 3 JT 100", "(2019) 5 SCC 123", "AIR 1990 SC 45"]
    cited = spark.createDataFrame([(1, "(2019) 5 SCC 123; AIR 1990 SC 45", "123 2019 5 123, 1990 45"), (2, "(2019) 5 SCC 123; AIR 1990 SC 45", "(2019) 5 SCC 1"), (3, "AIR 1990 SC 45", None)], "k long, s string, h string")
    assert [tuple(r) for r in evaluation.citation_fidelity(cited, ["k"], "s", "h").orderBy("k").collect()] == [(1, 2, 2), (2, 2, 0), (3, 1, 0)]
    assert [one(spark, T.length_ratio(F.lit(a), F.lit(b))) for a, b in (("ab", ""), ("", " "), ("a b", "abcd"))] == [float("inf"), 1.0, 0.5]
    low, high = evaluation.wilson(F.lit(19), F.lit(20))
    assert round(one(spark, low), 3) == 0.764 and round(one(spark, high), 3) == 0.991
    assert [one(spark, x) for x in evaluation.wilson(F.lit(0), F.lit(0))] == [0, 0]


GLOSSARY = [("appeal|appeals", ("अपील", "अपीलें"), "legal-term"), ("court", ("न्यायालय", "अदालत"), "body")]


def test_terms(spark):
    rows = spark.createDataFrame([(1, "The Appeals in court", "अपील अदालत", "न्यायालय"), (2, "appealing", "अपील", "अपील"), (3, "the court", "x", "अदालत")], "k long, src string, ref string, hyp string")
    found = {(r["k"], r["category"]): (r["ref_variant"], r["hit_any"], r["hit_ref"]) for r in evaluation.term_hits(rows, ["k"], GLOSSARY).collect()}
    assert found == {(1, "legal-term"): ("अपील", False, False), (1, "body"): ("अदालत", True, False)}


def predictions(spark):
    srcs = ["The court heard the appeal in 1999.", "word " * 30, "short one"]
    refs = ["अदालत अपील 1999", "एक " * 30, "छोटा"]
    hyps = {"a": ["अदालत 1999", "एक " * 5, "छोटा"], "b": ["न्यायालय अपील", "एक " * 30, "छोटा छोटा"], "c": ["x"] * 3}
    rows = [(s, k, srcs[k], refs[k], h) for s, texts in hyps.items() for k, h in enumerate(texts)]
    return spark.createDataFrame(rows, "system string, seg long, src string, ref string, hyp string")


def test_systems_and_comparisons(spark):
    rows = predictions(spark)
    got = {(r["system"], r["category"]): r for r in evaluation.fidelity(rows, ["seg"], GLOSSARY).collect()}
    a, b, c = (got[s, None] for s in "abc")
    assert (a["numbers_total"], a["numbers_preserved"], a["terms"], a["hit_any_rate"], a["omission"], a["citation_rate"]) == (1, 1, 2, 0.5, 1 + (len("अदालत1999") < 0.6 * len("अदालतअपील1999")), None)
    assert (b["number_rate"], b["hit_any_rate"], b["hit_ref_rate"], b["repetition"], b["addition"]) == (0, 1.0, 0.5, 1, 1) and c["terms"] == 2 and got["b", "body"]["hit_ref_rate"] == 0
    scored = rows.withColumn("score", metrics.sentence_chrf("hyp", "ref"))
    pairs = evaluation.compared(scored, ["seg"], [("a", "b"), ("a", "missing")])
    deltas = {r["seg"]: (r["delta"], r["outcome"], r["bucket"]) for r in pairs.collect()}
    assert len(deltas) == 3 and deltas[1][1:] == ("win", "21-40") and deltas[2][1] == "loss"
    counts = {(r["kind"], r["name"]): (r["win"], r["tie"], r["loss"]) for r in evaluation.outcome_counts(pairs, ["seg"], GLOSSARY).collect()}
    assert sum(counts["overall", ""]) == 3 and counts["bucket", ">40"] == (0, 0, 0) and counts["bucket", "21-40"] == (1, 0, 0) and sum(counts["category", "body"]) == 1
    top = evaluation.top_changes(pairs, ["seg"], 2).where("side = 'gain'").orderBy("place").collect()
    assert [r["delta"] for r in top] == sorted((d for d, *_ in deltas.values()), reverse=True)[:2]
    found = evaluation.candidates(scored, ["seg"], "a", "b", GLOSSARY).collect()
    assert [abs(r["delta"]) for r in found] == sorted((abs(r["delta"]) for r in found), reverse=True) and found[0]["others"].keys() == {"c"}
    with pytest.raises(ValueError, match="missing"):
        evaluation.candidates(scored, ["seg"], "a", "zz", GLOSSARY)
    assert evaluation.adapted_system("a", [("x", "y"), ("a", "b"), ("a", "c")]) == "b"
    with pytest.raises(ValueError):
        evaluation.adapted_system("q", [("a", "b")])


def test_robustness(spark):
    rows = spark.createDataFrame([("s", "a b c d e f", "x y", "x y"), ("s", "a", "q", "q")], "system string, src string, hyp string, ref string")
    assert sorted(tuple(r) for r in metrics.robustness(rows).collect()) == [(0, "s", 2, 100.0), (5, "s", 1, 100.0)]


@pytest.mark.parametrize(
    ("src", "tag"),
    [
        ("the appeal failed", "legal-term"), ("Inter Alia, leave GRANTED", "archaic/formulaic"), ("w " * 46, "long-sentence"), ("w " * 45, None), ("on 1.2.03 he", "citation/section/date"), ("under Section 302 he", "citation/section/date"),
        ("see (2004) 3 JT 100 x", "citation/section/date"), ("in Ram v. Sita it", "named-entity"), ("then John Smith left", "named-entity"), ("it is Supreme Court law", None), ("John Smith left", None), ("he left. John Smith came", None),
    ],
)
def test_tags(spark, src, tag):
    rows = spark.createDataFrame([("s", 1, src, "abc", "abd")], "system string, k long, src string, ref string, hyp string")
    assert evaluation.tagged(rows, ["k"], GLOSSARY).first()["tags"] == ([tag] if tag else [])


def test_coverage(spark):
    rows = [(k, [evaluation.CATEGORIES[k % 6]]) for k in range(12)]
    frame = lambda r: spark.createDataFrame(r, "number long, categories array<string>")
    assert {r["category"]: r["examples"] for r in evaluation.coverage(frame(rows)).collect()}["legal-term"] == [0, 6]
    for wrong in (rows[:11], [(k, ["legal-term"]) for k in range(12)]):
        with pytest.raises(ValueError):
            evaluation.coverage(frame(wrong))


def test_repetition_equals_brute_force(spark, tmp_path):
    def brute(text):
        w = (text or "").split()
        grams = Counter(tuple(w[i : i + 4]) for i in range(len(w) - 3))
        return bool(re.search(r"(\S)\1{9,}", text or "")) or any(len(set(g)) == 1 or n >= 3 for g, n in grams.items())

    texts = ["19.08.1992..........", "." * 9, "." * 10, "a" + " " * 12 + "b", "x\n" * 3, "no no no no", "no no no", "a b c d " * 3, "a b c d " * 2, "😀" * 10, "😀" * 9, "\u3000" * 10, "\x1c" * 12, "ааааааааааа", "", None]
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "conv_id long, turn int, text string")
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    want = {k: brute(t) for k, t in enumerate(texts)}
    assert {r["turn"]: r["repeated"] for r in evaluation.repetition_flags(rows, ["conv_id", "turn"], "text").collect()} == want
    assert {r["turn"]: r["repeated"] for r in catalog.QUERIES["repetition"](spark, str(tmp_path)).collect()} == want


def test_splits(spark):
    ids = [str(i) for i in range(30)]
    ratios = {"train": 0.8, "dev": 0.1, "test": 0.1}
    split = evaluation.make_split(ids, 13, ratios)
    order = list(ids)
    random.Random(13).shuffle(order)
    assert split == {"train": sorted(order[:24], key=int), "dev": sorted(order[24:27], key=int), "test": sorted(order[27:], key=int)} == evaluation.make_split(ids, 13, ratios)
    assert evaluation.round_robin_split(["9", "2", "5"]) == {"train": ["9"], "dev": ["2"], "test": ["5"]}
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    evaluation.assert_disjoint(docs)
    with pytest.raises(ValueError, match="2"):
        evaluation.assert_disjoint(docs.union(docs.where("doc_id = 2")))
    assert evaluation.restricted(docs, [1, 3]).count() == 2
    with pytest.raises(ValueError, match="7"):
        evaluation.restricted(docs, [1, 7])


def test_numbering_and_quantiles(spark):
    rng = np.random.default_rng(0)
    for values in (rng.normal(size=999).tolist(), [1.0] * 400 + [2.0] * 3, [5.0], [3.0, 1.0]):
        rows = spark.createDataFrame([(float(v),) for v in values], "x double")
        got = {r["q"]: r["v"] for r in evaluation.quantiles(rows, "x", (0.0, 0.05, 0.25, 0.5, 0.95, 1.0), 20).collect()}
        assert all(v == pytest.approx(np.percentile(values, 100 * q)) for q, v in got.items())
    assert evaluation.quantiles(rows.limit(0), "x", (0.5,)).first()["v"] is None
    rows = spark.createDataFrame([(int(v),) for v in rng.permutation(500)], "k long")
    assert all(r["k"] == r["at"] for r in evaluation.numbered(rows, ["k"], F.floor(F.col("k") / 7), "at").collect())


def naive_alignment(n, m, cosine, src, tgt, cfg=align.AlignConfig()):
    """The best path, each place choosing among its ways in by the order of moves, written as a recursion."""
    memo = {(0, 0): (0.0, [])}

    def best(i, j):
        if (i, j) not in memo:
            found = None
            for a, b in (*align.MOVES, (1, 0), (0, 1)):
                if a <= i and b <= j:
                    total, path = best(i - a, j - b)
                    if a and b:
                        total += cosine(i - a, a, j - b, b) - cfg.skip_threshold - cfg.merge_penalty * (a + b - 2) + cfg.anchor_bonus * (src[i - a] is not None and src[i - a] == tgt[j - b])
                    if found is None or total > found[0]:
                        found = total, path + [(i - a, a, j - b, b)]
            memo[i, j] = found
        return memo[i, j]

    return [(list(range(i, i + a)), list(range(j, j + b))) for i, a, j, b in best(n, m)[1] if a and b]


def test_alignment_settles_ties_by_the_order_of_moves():
    rng = np.random.default_rng(1)
    cfg = align.AlignConfig(skip_threshold=0.5, merge_penalty=0.125, anchor_bonus=0.125)
    for _ in range(400):
        n, m = rng.integers(0, 7, 2)
        grid = rng.integers(0, 9, (8, 4, 8, 4)) / 8  # exact in binary, so ties are common
        numbers = [[None if x > 3 else int(x) for x in rng.integers(0, 8, k)] for k in (n, m)]
        cosine = lambda i, a, j, b: float(grid[i, a, j, b])  # noqa: B023, E731
        got = align.align(*numbers, cosine, cfg)
        assert [(s, t) for s, t, _ in got] == naive_alignment(n, m, cosine, *numbers, cfg)
        for side, size in ((0, n), (1, m)):
            used = [x for pair in got for x in pair[side]]
            assert used == sorted(set(used)) and all(0 <= x < size for x in used)


def test_alignment_holds_no_grid(monkeypatch):
    rng = np.random.default_rng(2)
    x = align._unit(rng.standard_normal((700, 8)))
    y = align._unit(x[np.sort(rng.integers(0, 700, 650))] + 0.1)
    tracemalloc.start()
    found = align._pairs(1, [None] * 700, [None] * 650, {1: x}, {1: y}, align.AlignConfig(max_block=1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6 and len(found) > 300
    cfg = align.AlignConfig(skip_threshold=0.5, merge_penalty=0.125, anchor_bonus=0.125)
    for held, parts, tile in ((1, 2, 2), (9, 3, 32), (30, 32, 1)):
        monkeypatch.setattr(align, "_HELD", held)
        monkeypatch.setattr(align, "_PARTS", parts)
        monkeypatch.setattr(align, "_TILE", tile)
        for _ in range(60):
            n, m = rng.integers(0, 9, 2)
            grid = rng.integers(0, 9, (9, 4, 9, 4)) / 8
            numbers = [[None if z > 3 else int(z) for z in rng.integers(0, 8, k)] for k in (n, m)]
            cosine = lambda i, a, j, b: float(grid[i, a, j, b])  # noqa: B023, E731
            got = align.align(*numbers, cosine, cfg)
            assert [(s, t) for s, t, _ in got] == naive_alignment(n, m, cosine, *numbers, cfg)
            assert all(score == cosine(s[0], len(s), t[0], len(t)) for s, t, score in got)


def test_alignment_keeps_a_lost_vector_apart():
    lost = np.array([3.0, 1.0, np.nan, 0.0, 2.0, 1.0, np.nan, np.nan, 1.0])
    assert np.array_equal(align._running(lost), [3, 3, np.nan, 0, 2, 2, np.nan, np.nan, 1], equal_nan=True)


def embed(texts):
    out = np.zeros((len(texts), 64))
    for k, text in enumerate(texts):
        for w in text.split():
            out[k, zlib.crc32(w.encode()) % 64] += 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def test_documents_are_aligned(spark):
    src = [(1, 0, "alpha beta"), (1, 1, "gamma delta"), (1, 2, "zzz yyy xxx"), (1, 3, "7. omega"), (2, 0, "only here")]
    tgt = [(1, 0, "alpha beta gamma"), (1, 1, "delta"), (1, 2, "7. omega " + "o" * 300), (3, 0, "only there")]
    a, b = (spark.createDataFrame(rows, "doc long, idx long, sentence string") for rows in (src, tgt))
    pairs = align.align_documents(a, b, embed)
    rows = pairs.orderBy("doc", "pair").collect()
    assert [(r["src_idx"], r["tgt_idx"]) for r in rows][0] == ([0, 1], [0, 1]) or [(r["src_idx"], r["tgt_idx"]) for r in rows][:2] == [([0], [0]), ([1], [1])]
    skips = {r["doc"]: tuple(r)[1:] for r in align.skipped(pairs, a, b).collect()}
    used = sum(len(r["src_idx"]) for r in rows), sum(len(r["tgt_idx"]) for r in rows)
    assert skips[1] == (4, 3, 4 - used[0], 3 - used[1]) and skips[2] == (1, 0, 1, 0) and skips[3] == (0, 1, 0, 1)
    judged = align.keep(pairs)
    last = judged.where("array_contains(src_idx, 3L)").first()
    assert last["drop_reason"] in ("low_score", "len_ratio") and not last["kept"]
    numbered = align.number_pairs(judged.where("kept")).orderBy("pair").collect()
    assert [r["pair_id"] for r in numbered] == [f"1-{k:04d}" for k in range(len(numbered))]
    splits = spark.createDataFrame([(1, "train")], "doc long, split string")
    stats = {r["doc"]: r for r in align.alignment_stats(judged, align.skipped(pairs, a, b), splits).collect()}
    assert stats[1]["n_pairs"] == len(rows) == stats[None]["n_pairs"] and stats[1]["splits"] == {"train": len(numbered)} and stats[2]["n_pairs"] == 0
    assert sum(stats[None]["types"].values()) == len(rows) and stats[None]["n_src"] == 5 and sum(stats[1]["dropped"].values()) == len(rows) - len(numbered)


def test_report_aligns_once(spark, sf_dir):
    report_ = catalog.QUERIES["alignment_report"](spark, sf_dir)
    assert report_._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInPandas") == 1
    pairs, src, tgt = catalog._aligned(spark, sf_dir)
    judged = align.keep(pairs.withColumn("en", F.lit("x")).withColumn("hi", F.lit("x")))
    one_way, other = (sorted(map(str, align.alignment_stats(judged, skips).collect())) for skips in (align.sizes(src, tgt), align.skipped(pairs, src, tgt)))
    assert one_way == other and len(one_way) > 1
    a = spark.createDataFrame([(1, 0, "alpha beta"), (2, 0, "only here")], "doc long, idx long, sentence string")
    b = spark.createDataFrame([(1, 0, "alpha beta"), (1, 1, "zzz"), (3, 0, "only there")], "doc long, idx long, sentence string")
    stats = {r["doc"]: tuple(r)[1:7] for r in align.alignment_stats(align.keep(align.align_documents(a, b, embed)), align.sizes(a, b)).collect()}
    assert stats == {1: (1, 2, 0, 1, 1, 1), 2: (1, 0, 1, 0, 0, 0), 3: (0, 1, 0, 1, 0, 0), None: (2, 3, 1, 2, 1, 1)}


def test_drop_reasons(spark):
    rows = spark.createDataFrame([(0.5, "abcd", "abcd"), (0.9, "abcd", "x" * 300), (0.9, "", "x"), (0.6, "abcd", "ab")], "score double, en string, hi string")
    assert [r["drop_reason"] for r in align.keep(rows).collect()] == ["low_score", "len_ratio", "len_ratio", None]


def test_vectors_are_aligned(spark):
    v = np.eye(6)
    src = spark.createDataFrame([(1, k, v[k].tolist()) for k in range(3)], "doc long, idx long, v array<double>")
    tgt = spark.createDataFrame([(1, 0, v[0].tolist()), (1, 1, (v[1] + v[2]).tolist())], "doc long, idx long, v array<double>")
    assert [(r["src_idx"], r["tgt_idx"], r["align_type"]) for r in align.align_vectors(src, tgt).orderBy("pair").collect()] == [([0], [0], "1-1"), ([1, 2], [1], "2-1")]


def test_ocr_repair(spark):
    assert {one(spark, align.number_key(F.lit(n))) for n in ("1989", "989", "4989")} == {"989"}
    cases = [("on 24.04.989 x", ["24.04.1989"], "on 24.04.1989 x", 1), ("a 23..2009", ["23.11.2009"], "a 23.11.2009", 1), ("क ९८९ है", ["1989"], "क 1989 है", 1), ("no 77 here", [], "no 77 here", 0), ("5 and 88", ["5", "9999", "x"], "5 and 88", 0), ("7\nउद्घोष 8", ["7"], "7", 0)]
    pages = spark.createDataFrame([(1, k, ocr, layer) for k, (ocr, layer, _, _) in enumerate(cases)] + [(2, 0, None, None)], "doc long, page long, ocr string, layer array<string>")
    got = {r["page"]: r["repaired"] for r in align.repair_pages(pages.where("doc = 1")).collect()}
    assert [(got[k]["text"], len(got[k]["changes"])) for k in range(len(cases))] == [(text, n) for _, _, text, n in cases]
    docs = {r["doc"]: r for r in align.recover_documents(pages).collect()}
    assert docs[1]["text"] == "\n".join(text for _, _, text, _ in cases) + "\n" and docs[1]["pages"] == 6 and docs[1]["numbers_repaired"] == 3 and tuple(docs[1]["examples"][0]) == ("24.04.989", "24.04.1989")
    assert one(spark, align.layer_numbers(F.lit("१.२ 3--4 x"))) == ["1.2", "3--4"]


def naive_counts(h, r):
    def runs(items, n):
        return Counter(tuple(items[i : i + n]) for i in range(len(items) - n + 1))

    a, b = metrics.tokenize_13a(h), metrics.tokenize_13a(r)
    bleu = [len(a), len(b), *((runs(a, n) & runs(b, n)).total() for n in range(1, 5)), *(runs(a, n).total() for n in range(1, 5))]
    chrf = []
    for orders, cut in ((6, lambda t: "".join(t.split())), (2, metrics._chrf_words)):
        for n in range(1, orders + 1):
            x, y = runs(cut(h), n), runs(cut(r), n)
            chrf += [x.total(), y.total(), (x & y).total()]
    return bleu, chrf


def test_metric_counts_equal_naive_ones():
    rng = np.random.default_rng(3)
    words = ["the", "a", "cat,", "(dog)", "अपील", "x.y", "1,000", "no-no", "...", "É"]
    pairs = [(" ".join(rng.choice(words, rng.integers(0, 14))), " ".join(rng.choice(words, rng.integers(0, 14)))) for _ in range(300)] + [("", ""), ("😀 😀", "😀")]
    h, r = zip(*pairs)
    assert metrics.bleu_counts_of(list(h), list(r)) == [naive_counts(*p)[0] for p in pairs]
    assert metrics.chrf_counts_of(list(h), list(r)) == [naive_counts(*p)[1] for p in pairs]


def test_texts_are_cut_once_and_parts_count_alike(monkeypatch):
    cut = []
    refs = ["a b c d", "a b", "x, y."]
    hyps = ["a b c d", "a b c", "x,"]
    metrics.bleu_counts_of(hyps + hyps, refs + refs, lambda t: cut.append(t) or t.split())
    assert sorted(cut) == sorted({*refs, *hyps})
    rng = random.Random(7)
    drawn = ["".join(rng.choices("ab.,-09 &;<>\n'\u00a0\x1cअ😀", k=rng.randrange(25))) for _ in range(300)] + ["&quot;a&amp;.5", "<skipped>1,000-2", "x-\ny"]
    pairs = [(h, rng.choice([h, h[:9], h + r, r])) for h, r in zip(drawn, drawn[::-1])]
    pairs += [(r, h) for h, r in pairs]
    expected = [naive_counts(*p) for p in pairs]
    for chars, most in ((1 << 20, 1 << 14), (60, 5), (1, 1)):
        monkeypatch.setattr(metrics, "_PART_CHARS", chars)
        monkeypatch.setattr(metrics, "_PART_PAIRS", most)
        h, r = map(list, zip(*pairs))
        assert metrics.bleu_counts_of(h, r) == [x for x, _ in expected] and metrics.chrf_counts_of(h, r) == [x for _, x in expected]
    assert metrics.bleu_counts_of([], []) == metrics.chrf_counts_of([], []) == []


def test_scores_are_dealt_to_all_cores(spark, sf_dir):
    rows = spark.range(10, numPartitions=2)
    tasks = 3 * spark.sparkContext.defaultParallelism
    assert files.dealt(rows).rdd.getNumPartitions() == tasks and sorted(r["id"] for r in files.dealt(rows).collect()) == list(range(10))
    assert files.dealt(spark.range(10, numPartitions=tasks + 1)).rdd.getNumPartitions() == tasks + 1
    assert f"RoundRobinPartitioning({tasks})" in catalog.QUERIES["corpus_scores"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_metrics(spark):
    assert metrics.bleu(metrics.bleu_counts("a b c d e", "a b c d e")) == pytest.approx(100)
    assert metrics.chrf(metrics.chrf_counts("Hello, world", "Hello, world")) == pytest.approx(100)
    rng = np.random.default_rng(5)
    refs = [" ".join(rng.choice(list("abcdefgh"), 12)) for _ in range(60)]
    worse = [" ".join(w for w in r.split() if rng.random() > 0.4) for r in refs]
    counts = [np.array(metrics.chrf_counts_of(x, refs)) for x in (worse, refs)]
    same = metrics.paired_bootstrap(counts[0], counts[0], metrics.chrf, 50, metric="chrf")
    assert same["delta"] == 0 and same["p_value"] == 1 and same["ci95"] == [0, 0] and set(same) == {"metric", "a_score", "b_score", "delta", "ci95", "p_value"}
    better = metrics.paired_bootstrap(*counts, metrics.chrf, 200)
    assert better["p_value"] < 0.05 and better == metrics.paired_bootstrap(*counts, metrics.chrf, 200) and better["b_score"] == 100
    assert metrics.paired_bootstrap_segments([0.1, 0.2], [0.3, 0.5], 50)["delta"] == 0.25
    with pytest.raises(ValueError):
        metrics.paired_bootstrap_segments([0.1], [0.3, 0.5])
    rows = spark.createDataFrame([(s, k, h, r) for s, x in (("a", worse), ("b", refs)) for k, (h, r) in enumerate(zip(x, refs))], "system string, seg long, hyp string, ref string")
    labels, neural = spark.createDataFrame([("a", "First")], "system string, label string"), spark.createDataFrame([("a", 0.5), ("a", 0.7)], "system string, score double")
    meta = spark.createDataFrame([("a", "other", 3.0), ("b", "Second", 4.0)], "system string, label string, seconds double")
    out = {r["system"]: r for r in metrics.evaluate(rows, meta, labels, neural).collect()}
    assert (out["a"]["label"], out["b"]["label"], out["a"]["comet"], out["b"]["comet"], out["b"]["bleu"], out["b"]["seconds"]) == ("First", "Second", 0.6, None, 100.0, 4.0)
    assert out["a"]["chrf"] == round(metrics.chrf(counts[0].sum(0)), 2)
    found = metrics.significance(rows, [("a", "b"), ("a", "zz")], 100)
    assert [(x["a"], x["b"], x["metric"]) for x in found] == [("a", "b", "bleu"), ("a", "b", "chrf")] and found[1]["delta"] == round(100 - metrics.chrf(counts[0].sum(0)), 2)
    metrics.check_lengths(rows, rows.where("system = 'a'"), "seg")
    with pytest.raises(ValueError, match="length mismatch"):
        metrics.check_lengths(rows.where("system = 'a' OR seg > 0"), rows.where("system = 'a'"), "seg")
    scored = rows.where("seg < 2").withColumn("score", metrics.sentence_chrf("hyp", "ref"))
    assert all(r["scores"]["b"] == 100 for r in metrics.per_segment(scored, ["seg"]).collect())
    subword = rows.select(metrics.bleu_stats("hyp", "ref", tokenize=list).alias("c")).first()["c"]
    assert subword[0] == len(worse[0])


def test_offline_counters_need_no_python(spark, sf_dir):
    rng = random.Random(11)
    blank = "".join(map(chr, (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 0x1680, 0x2000, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
    texts = ["", " ", "a", " a", "a ", "\u200b\ufeff", *blank, *("".join(rng.choices(blank + "  aбक्😀\u200b\x08\x0e\x84", k=rng.randrange(1, 30))) for _ in range(300))]
    own = [tokens.WORDS, tokens.CHARACTERS, tokens.BYTES]
    rows = spark.createDataFrame([*enumerate(texts), (-1, None)], "k long, text string").withColumn("lang", F.lit("en"))
    got = {(r["k"], r["tokenizer"]): (r["tokens"], r["unknown"]) for r in tokens.counted(rows, ["k", "lang"], own).collect()}
    assert got == {(k, t.name): (len(t.ids(text)), 0) for k, text in (*enumerate(texts), (-1, "")) for t in own}
    stub = tokens.Tokenizer("stub", lambda t: [ord(c) % 2 for c in t], unknown=0)
    both = {(r["k"], r["tokenizer"]): (r["tokens"], r["unknown"]) for r in tokens.counted(rows.withColumn("text", F.col("text")), ["k", "lang"], [tokens.WORDS, stub, tokens.BYTES]).collect()}
    assert all(both[k, "stub"] == (len(text), stub.ids(text).count(0)) and both[k, "bytes"] == got[k, "bytes"] for k, text in enumerate(texts))
    for name in ("token_limits", "token_stats", "tokens_per_source", "fertility_reduction", "pair_ratios", "tokenizer_study"):
        assert "Python" not in catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_tokenizer_study(spark):
    stub = tokens.Tokenizer("stub", lambda t: [0 if c == "?" else 1 for c in t if not c.isspace()], unknown=0, price=(1.0, 1.0), max_length=5)
    rows = spark.createDataFrame([(1, "en", "ab cd"), (1, "hi", "क? ख"), (2, "en", ""), (2, "hi", "गघ")], "pair_id long, lang string, text string")
    stats = {r["lang"]: r for r in tokens.corpus_stats(tokens.counted(rows, ["pair_id", "lang"], [stub])).collect()}
    assert (stats["hi"]["tokens"], stats["hi"]["words"], stats["hi"]["chars"], stats["hi"]["unknown"]) == (5, 3, 5, 1) and stats["en"]["fertility"] == 2
    nothing = tokens.corpus_stats(tokens.counted(rows.where("pair_id = 2 AND lang = 'en'"), ["pair_id", "lang"], [stub])).first()
    assert np.isnan(nothing["fertility"]) and np.isnan(nothing["unk_rate"])
    counts = tokens.counted(rows, ["pair_id", "lang"], [stub])
    assert tuple(tokens.pair_ratios(counts, "pair_id").first()) == ("stub", 5 / 4, 3 / 4)
    over = {(r["lang"], r["limit"]): r["pct_over"] for r in tokens.over_limits(counts, (2, 4)).collect()}
    assert over == {("en", 2): 50, ("en", 4): 0, ("hi", 2): 50, ("hi", 4): 0}
    docs = rows.withColumnRenamed("pair_id", "doc_id")
    out = tokens.study(rows, rows, docs, [stub, tokens.WORDS], limits=(2,)).collect()
    assert [r["tokenizer"] for r in out] == ["words", "stub"] and out[1]["cost_per_1000"] == round((2 + 2.5) / 1e6 * 1000, 4) and out[0]["cost_per_document"] is None and out[1]["pct_test_hi_over_model_max"] == 0
    assert "| stub | 2.00 | 2.50 | 1.25 | 50.0 | 0.0000 |" in tokens.cost_table([r.asDict() for r in out], limit=2)
    assert [t.name for t in tokens.chosen([stub, tokens.WORDS], ["words"])] == ["words"]
    with pytest.raises(ValueError, match="zz"):
        tokens.chosen([stub], ["zz"])
    picks = spark.createDataFrame([(0, "key " + "w " * 11), (1, "key " + "w " * 9), (2, "x " * 40)], "i long, text string")
    assert tokens.example(picks, ["key"], "i").first()["i"] == 1 and tokens.example(picks.where("i <> 1"), ["none"], "i").first()["i"] == 2


def test_vocabulary(spark):
    assert [one(spark, tokens.devanagari_piece(F.lit(p))) for p in ("▁क", "का", "▁", "▁19", "क.", "abc")] == [True, True, False, False, False, False]
    base = spark.createDataFrame([("a", 0), ("b", 1)], "piece string, piece_id long")
    extra = spark.createDataFrame([("▁क", 0, "NORMAL"), ("a", 1, "NORMAL"), ("19", 2, "NORMAL"), ("ख", 3, "NORMAL"), ("▁क", 4, "NORMAL"), ("ग", 5, "CONTROL"), ("▁", 6, "NORMAL")], "piece string, piece_id long, type string")
    merged = evaluation.vocabulary_merge(base, extra, tokens.devanagari_piece(F.col("piece")))
    assert sorted(map(tuple, merged.collect())) == [("ख", 3), ("▁क", 2)]
    mapped = tokens.init_map(merged.union(spark.createDataFrame([("▁", 9)], "piece string, new_id long")), lambda t: [len(w) for w in t.split()] * len(t))
    assert {r["new_id"]: r["old_ids"] for r in mapped.collect()} == {2: [1, 1], 3: [1]}
    assert tuple(tokens.init_summary(mapped, 2, 4).first()) == (2, 4, 2, 1.5)
    vectors = spark.createDataFrame([(1, [1.0, 3.0])], "vec_id long, embedding array<double>")
    edges = mapped.select("new_id", F.explode("old_ids").alias("old_id"))
    assert {(r["new_id"], r["dim"]): r["value"] for r in evaluation.mean_vectors(edges, vectors).collect()} == {(2, 0): 1, (2, 1): 3, (3, 0): 1, (3, 1): 3}
    sums = spark.createDataFrame([(10, 20.0, 4, 5, 40), (0, 0.0, 0, 0, 0)], "total_tokens long, total_nll double, total_new_tokens long, n_sentences long, total_chars long")
    full, none = tokens.language_model_metrics(sums).collect()
    assert (full["mean_tokens_per_sentence"], full["new_token_share"]) == (2, 0.4) and full["perplexity"] == pytest.approx(np.exp(2)) and full["bits_per_char"] == pytest.approx(20 / np.log(2) / 40)
    assert all(np.isnan(none[c]) for c in ("perplexity", "bits_per_char", "new_token_share", "mean_tokens_per_sentence"))
    ids, mask = tokens.encoded_batch(F.array(F.lit(5), F.lit(6)).cast("array<bigint>"), 1, 0, F.lit(4))
    assert one(spark, ids) == [1, 5, 6, 0, 0] and one(spark, mask) == [1, 1, 1, 0, 0]


def test_inference(spark):
    rows = spark.createDataFrame([(0, "a b c"), (1, "a"), (2, "b"), (3, "a b")], "seg_idx long, text string")
    ordered = inference.by_length(rows, "text")
    assert [r["seg_idx"] for r in ordered.collect()] == [1, 2, 3, 0] and [r["seg_idx"] for r in inference.restored(ordered).collect()] == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="length mismatch"):
        inference.restored(ordered.where("seg_idx <> 2"))
    assert [r["batch"] for r in inference.batches(ordered, 3, ["n_words", "seg_idx"]).orderBy("n_words", "seg_idx").collect()] == [0, 0, 0, 1]
    assert inference.head(rows, 2).count() == 2 and inference.head(rows, None).count() == 4 and inference.output_name("s", 10) == "s.limit10" and inference.output_name("s", None) == "s"
    ids = F.array(*map(F.lit, (1, 7, 8, 2, 0, 0)))
    assert one(spark, inference.input_tokens(ids, 0)) == 4 and one(spark, inference.output_tokens(ids, 0, (1, 2))) == 2 and one(spark, inference.input_tokens(ids, None)) == 6
    inference.register("upper", lambda: lambda texts: [t.upper() + "\n" for t in texts])
    assert [r["hyp"] for r in inference.translate(rows, "text", "upper").orderBy("seg_idx").collect()] == ["A B C ", "A ", "B ", "A B "]
    with pytest.raises(ValueError):
        inference.translator("zz")
    pairs = spark.createDataFrame([(0, [1, 2, 3], [4]), (0, [5], [6, 7])], "batch long, input_ids array<long>, labels array<long>")
    assert [(r["input_ids"], r["labels"], r["mask"]) for r in inference.collated(pairs, ["batch"], 0).collect()] == [([1, 2, 3], [4, -100], [1, 1, 1]), ([5, 0, 0], [6, 7], [1, 0, 0])]
    speed = spark.createDataFrame([(10, 30, 2.0), (1, 1, 0.0)], "sentences long, tokens_out long, seconds double")
    assert [(r["sents_per_sec"], r["tokens_out_per_sec"]) for r in inference.throughput(speed).collect()] == [(5, 15), (None, None)]


def test_early_stopping(spark):
    history = [("a", 0, 9.0), ("a", 1, 1.0), ("a", 2, 3.0), ("a", 3, 2.0), ("a", 4, 2.5), ("a", 5, 9.0), ("b", 1, 1.0), ("b", 2, 2.0), ("b", 3, 4.0)]
    rows = evaluation.early_stop(spark.createDataFrame(history, "run string, epoch long, score double"), 2).collect()
    assert sorted(map(tuple, rows)) == [("a", 2, 4), ("b", 3, 3)]


def test_reports(tmp_path):
    text = "x\n<!-- BEGIN:t -->\nold\n<!-- END:t -->\ny"
    made = report.render(text, {"t": lambda: report.table(("a", "b"), [("1|2", "c\nd")], "f.json")})
    assert made == "x\n<!-- BEGIN:t -->\n| a | b |\n|---|---|\n| 1\\|2 | c d |\n\n*Source: f.json*\n<!-- END:t -->\ny"
    assert report.render(made, {"t": lambda: report.table(("a", "b"), [("1|2", "c\nd")], "f.json")}) == made
    for wrong, tables in ((text, {}), (text + text, {"t": lambda: ""})):
        with pytest.raises(ValueError):
            report.render(wrong, tables)
    path = tmp_path / "r.md"
    path.write_text(text, encoding="utf-8")
    assert report.build(str(path), {"t": lambda: "new"}) == path.read_text(encoding="utf-8") and "new" in path.read_text(encoding="utf-8")
    assert report.or_placeholder([str(path), "no/file"], lambda: "x") == "_(not available: no/file missing)_" and report.or_placeholder([str(path)], lambda: "x") == "x"
    assert [report.decimals(None), report.decimals(1.005, 1), report.percent(12.34), report.percent(0.5, True), report.thousands(1234.6), report.whole(3.0), report.signed(1.5), report.rate(None), report.rate(0.936)] == ["—", "1.0", "12.3%", "50.0%", "1,235", "3", "+1.50", "n/a", "93.6%"]
    assert report.p_value(0.0, 1000) == "<0.001" and report.p_value(0.088, 1000) == "0.088"
    assert report.histogram_lines([0, 2, 4]).splitlines()[2].endswith(" 4 " + "#" * 40) and report.histogram_lines([0]) == "(no scores)"


def test_report_tables(spark):
    rows = predictions(spark)
    made = report.fidelity_table([r.asDict() for r in evaluation.fidelity(rows, ["seg"], GLOSSARY).orderBy("system").collect()], {"a": "First"})
    assert "| First | 100.0% | n/a | 50.0%/" in made and made.count("\n") == 4
    assert "| 0 | 3 | " in report.robustness_table([r.asDict() for r in metrics.robustness(rows.drop("seg")).collect()])
    assert "| s | 4 | 100.00 | 50.00 |" in report.scores_table([{"label": "s", "n": 4, "bleu": 100.0, "chrf": 50.0}])
    assert "| a | b | bleu | +1.00 | [-0.50, +2.00] | <0.001 |" in report.significance_table([{"a": "a", "b": "b", "metric": "bleu", "delta": 1.0, "ci95": [-0.5, 2.0], "p_value": 0.0}], 1000)
    assert "| b vs a | overall |  | 1 | 2 | 3 |" in report.outcome_table([{"a": "a", "b": "b", "kind": "overall", "name": "", "win": 1, "tie": 2, "loss": 3}])
    assert "| 5 | 3 | 2 | 2 | 1 |" in report.documents_table([{"doc": 5, "n_src": 3, "n_tgt": 2, "n_kept": 2, "dropped": {"low_score": 1}}, {"doc": None}])
    record = {"src": "s", "ref": "r", "baseline": "b", "adapted": "d", "score_baseline": 1.0, "score_adapted": 2.0}
    assert "### Example 1: legal-term" in report.examples([{"pair_id": "p", "categories": ["legal-term"]}], {"p": record}, {"legal-term": [1]}, "B", "A")


def test_sources(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for name, text in (("10", "\ufeffa\r\nb"), ("9", "c")):
        (tmp_path / "docs" / f"{name}.txt").write_bytes(text.encode())
    docs = files.text_documents(spark, f"{tmp_path}/docs")
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == {"10": "a\nb", "9": "c"} and [r["doc_id"] for r in files.document_ids(docs).collect()] == ["9", "10"]
    override = spark.createDataFrame([("9", "new")], "doc_id string, text string")
    assert {r["doc_id"]: r["text"] for r in files.overriding(docs, override).collect()} == {"10": "a\nb", "9": "new"}
    (tmp_path / "p").mkdir()
    for name, text in (("a", "x\ny\u2028z\n"), ("b", "x\ny"), ("ref", "1\n2\n3")):
        (tmp_path / "p" / f"{name}.test.hi").write_text(text, encoding="utf-8")
    rows = files.predictions(spark, f"{tmp_path}/p", "test", "hi")
    assert sorted((r["system"], r["seg_idx"], r["hyp"]) for r in rows.collect()) == [("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z"), ("b", 0, "x"), ("b", 1, "y")]
    assert {r["system"] for r in files.aligned_systems(rows, 3).collect()} == {"a"} and [r["system"] for r in files.other_systems(rows, ["b"]).collect()] == ["a"]
    three = rows.where("system = 'a'")
    pairs = spark.createDataFrame([(k, f"1-{k:04d}", "1") for k in range(3)], "seg_idx int, pair_id string, doc_id string")
    assert {r["pair_id"] for r in files.with_pair_ids(three, pairs, "test").collect()} == {"1-0000", "1-0001", "1-0002"}
    assert {(r["pair_id"], r["doc_id"]) for r in files.with_pair_ids(three, pairs.limit(2), "test").collect()} == {(f"test-{k}", None) for k in range(3)}
    meta = spark.createDataFrame([("a", "From meta"), ("b", "B")], "system string, label string")
    systems = rows.select("system").distinct()
    assert {r["system"]: r["label"] for r in files.with_labels(systems, {"b": "Configured"}, meta).collect()} == {"a": "From meta", "b": "Configured"}
    assert {r["label"] for r in files.with_labels(systems, {}).collect()} == {"a", "b"}
    (tmp_path / "j.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n')
    assert files.json_lines(spark, f"{tmp_path}/j.jsonl", "k long").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"k": 1}\n{"k": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.json_lines(spark, f"{tmp_path}/bad.jsonl", "k long").collect()
    kept = spark.createDataFrame([(2, 0, True, "train"), (1, 0, True, "train"), (1, 1, False, "train"), (3, 0, True, "dev")], "doc long, pair long, kept boolean, split string")
    files.write_splits(kept, f"{tmp_path}/splits")
    assert spark.read.json(f"{tmp_path}/splits").groupBy("split").count().count() == 2 and spark.read.json(f"{tmp_path}/splits").count() == 3
    files.write_alignments(kept, f"{tmp_path}/al")
    assert spark.read.json(f"{tmp_path}/al").count() == 4
    files.write_predictions(spark.createDataFrame([(1, "b"), (0, "a\nc")], "seg_idx long, hyp string"), f"{tmp_path}/out")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()] == ["a c", "b"]
    files.write_json(spark.createDataFrame([(1, {"a": 2.0})], "k long, m map<string,double>"), f"{tmp_path}/json")
    assert spark.read.text(f"{tmp_path}/json").first()["value"] == '{"k":1,"m":{"a":2.0}}'
    calls = f"{tmp_path}/calls"

    def embed_once(texts):
        with open(calls, "a") as f:
            f.write("".join(t + "\n" for t in texts))
        return [[float(len(t))] for t in texts]

    texts = spark.createDataFrame([("aa",), ("b",), ("b",)], "text string").coalesce(1)
    for _ in range(2):
        assert {r["text"]: r["vector"] for r in files.cached_vectors(spark, texts, f"{tmp_path}/cache", embed_once).collect()} == {"aa": [2.0], "b": [1.0]}
    with open(calls) as f:
        assert sorted(f.read().split()) == ["aa", "b"]


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    frame = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    mine = sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in frame.select(*columns).collect())
    names = [c[0] for c in con.execute(f"DESCRIBE {catalog.ORACLES[name]}").fetchall()]
    theirs = con.execute(catalog.ORACLES[name]).fetchall()
    assert sorted(names) == columns
    assert sorted(str([round(r[names.index(c)], 6) if isinstance(r[names.index(c)], float) else r[names.index(c)] for c in columns]) for r in theirs) == mine


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_operators_of_llm(tmp_path):
    """A copy of the repository without those folders still has all base queries, whether corpus_pipeline.py is there or not."""
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{root}/{name}"):
            shutil.copy(f"{root}/{name}", tmp_path)
    shutil.copytree(f"{root}/textloom", f"{tmp_path}/textloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    for _ in range(2):
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
        assert out.returncode == 0 and out.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES))], out.stderr
        if os.path.exists(f"{tmp_path}/corpus_pipeline.py"):
            os.remove(f"{tmp_path}/corpus_pipeline.py")
