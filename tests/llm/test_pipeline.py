"""The corpus pipeline against a plain version, and its stages on odd tables."""

import re
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from textloom.llm import components, packing, pii, quality, shingle_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    vocabulary = ["river", "mill", "sea", "old", "ran", "past", "the", "and", "stone", "on"]
    texts = []
    for k in range(150):
        text = " ".join(rng.choice(vocabulary, int(rng.integers(30, 60))))
        if k % 5 == 0:
            text = "".join(w + "*** " for w in text.split())
        if k % 7 == 0:
            text += f" mail a{k}.b@mail{k % 3}.org"
        texts.append(text)
    near = texts[1].split()
    near[3] = "changed"
    texts += [texts[1], texts[2].upper(), " ".join(near), "", "one two"]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int("***" not in t), 0) for i, t in enumerate(texts[:150])], "doc_id long, quality int, toxic int")
    docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    labels.coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_pipeline_equals_a_plain_version(spark, tables):
    folder, rows = tables
    network = quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    scores = network.scores(quality.features(network.vectors, [r[1] for r in rows]))
    kept = [r for r, s in zip(rows, scores) if s >= quality.THRESHOLD]
    assert {r[0] for r in rows[:150] if "***" in r[1]}.isdisjoint(r[0] for r in kept) and len(kept) >= 115
    sets, label = [shingles(r[1]) for r in kept], list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    single = [r for k, r in enumerate(kept) if label[k] == k]
    assert len(single) < len(kept)
    redacted = {r[0]: pii.redact(r[1], pii.find_spans(r[1])) for r in single}
    assert any("<email>" in t for t in redacted.values())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in redacted.items()}
    pieces = corpus_pipeline.run(spark, folder).collect()
    covered = Counter()
    for p in pieces:
        ids = want[p["doc_id"]]
        assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
        covered[p["doc_id"]] += p["length"]
    assert covered == {i: len(ids) for i, ids in want.items()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "PII", "packing"]


def test_stages_on_odd_tables(spark, tables):
    folder, _ = tables
    base = "the river ran past the old mill and on to the sea and stone by stone"
    rows = [(1, base), (1, base), (2, base + " x"), (None, base), (None, None), (3, None), (4, ""), (4, "other text with id four mail x@y.org"), (5, "long " * 200_000)]
    docs = spark.createDataFrame([(i, t, "en", None, None, "own", 9, 7) for i, t in rows], SCHEMA + ", score string, n int, component_id int")
    scored = corpus_pipeline.quality_stage(spark, docs, folder)
    assert scored.columns == docs.columns and set(scored.collect()) <= set(docs.collect())
    single = corpus_pipeline.near_duplicate_stage(spark, docs, folder)
    got = single.collect()
    assert single.columns == docs.columns and Counter(r["doc_id"] for r in got) == {1: 1, None: 2, 3: 1, 4: 1, 5: 1}
    clean = corpus_pipeline.pii_stage(spark, docs, folder)
    assert clean.columns == docs.columns and "other text with id four mail <email>" in {r["text"] for r in clean.collect()} and clean.count() == len(rows)
    pieces = corpus_pipeline.packing_stage(spark, docs, folder)
    assert pieces.count() > 0 and all(p["length"] <= packing.WINDOW for p in pieces.collect())
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, folder).count() == 0


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


@pytest.fixture
def planned(monkeypatch):
    """Joins of each table that components writes."""
    out = []

    def seen(df, tag, path=None, write=components.written):
        out.append(joins(df))
        return write(df, tag, path)

    monkeypatch.setattr(components, "written", seen)
    return out


@pytest.mark.parametrize("sent", [None, 0])
def test_components_equal_a_plain_version(spark, monkeypatch, planned, sent):
    """Few edges take one join a round, whose plans and broadcasts are the driver's; more take those of hot keys."""
    if sent is not None:
        monkeypatch.setattr(components, "SENT_ROWS", sent)
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))]
    edges += [(1000, 1000 + k) for k in range(1, 200)] + [(2000 + k, 2001 + k) for k in range(30)] + [(7, 7), (1001, 1000)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    found = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(found) == len({r["node"] for r in found})
    assert {r["node"]: r["component"] for r in found} == {x: c for x, c in label.items() if x != c}
    assert max(planned) == 1 if sent is None else max(planned) > 1


def test_links_are_planned_once(spark, tables, planned, monkeypatch):
    """The driver's memory grows with the plans: the stage's result reads links from a table."""
    base = "the river ran past the old mill and on to the sea and stone by stone"
    rows = [(1, base), (2, base), (2, ""), (3, base), (3, base + " x"), (4, "b four"), (4, "a four"), (None, base), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", None, None, True, 9) for i, t in rows], SCHEMA + ", repeated boolean, rows int")
    single = corpus_pipeline.near_duplicate_stage(spark, docs, tables[0])
    assert joins(single) == 2 and single.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in single.collect())
    assert got == Counter([(1, base), (2, ""), (4, "a four"), (None, base), (5, None)])
    # The way of more rows than may be sent.
    monkeypatch.setattr(components, "SENT_ROWS", 0)
    monkeypatch.setattr(shingle_join, "SENT_ROWS", 0)
    assert Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, tables[0]).collect()) == got


def test_training_gives_memory_back(spark, tables, monkeypatch):
    called = []
    monkeypatch.setattr(quality, "give_back", lambda: called.append(1))
    quality.fit(spark.read.parquet(f"{tables[0]}/documents.parquet"), spark.read.parquet(f"{tables[0]}/labels.parquet"))
    assert called
