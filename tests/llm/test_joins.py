"""Joins against brute force over all pairs, and the pipeline's stages."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillsift.llm import components, neighbours, ngram_join, rtree
from quillsift.session import checkpointed


def shingles(text, size=4):
    words = (text or "").lower().split()
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[n : n + size]) for n in range(len(words) - size + 1))


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 85 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted((str(i), len(s), str(least.get(g))) for (i, _), s, g in zip(rows, sets, group, strict=True))


def near_copies(seed, bases=6, copies=12):
    rng = random.Random(seed)
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "one two"), (1005, "One TWO three"), (None, "one two")]
    for base in range(bases):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice((5, 30, 60, 400)))]
        for copy in range(copies):
            changed = list(words)
            for _ in range(rng.randrange(4)):
                changed[rng.randrange(len(changed))] = f"x{rng.randrange(400)}"
            rows.append((base * 100 + copy, " ".join(changed)))
    return rows


@pytest.mark.parametrize(("seed", "cell"), [(1, 2048), (2, 3)])
def test_ngram_join_is_brute_force(spark, seed, cell):
    rows = near_copies(seed)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, node int")
    found = ngram_join.similar_groups(docs, cell_nodes=cell, cell_shingles=40 * cell).collect()
    assert sorted((str(r["id"]), r["n_shingles"], str(r["component_id"])) for r in found) == brute_components(rows)


def test_ngram_join_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similar_groups(empty).count() == 0


def test_tree_loses_no_similar_pair():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 120, replace=False), rng.integers(0, 2**63, rng.integers(0, 30), dtype=np.uint64)])) for _ in range(150)]
    sets += [np.unique(np.concatenate([s[: len(s) - 3], rng.integers(0, 2**63, 2, dtype=np.uint64)])) for s in sets[:60]]
    sizes = np.array([len(s) for s in sets])
    points = [np.bincount((s & np.uint64(g - 1)).astype(int), minlength=g) for s, g in zip(sets, [32 if n % 2 else 64 for n in range(len(sets))], strict=True)]
    found = set(rtree.joined(sizes, points, 85))
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 85 * (sizes[i] + sizes[j] - common):
                assert (i, j) in found


def test_components_of_a_chain_and_a_star(spark):
    links = [(n, n + 1) for n in range(20)] + [(100, n) for n in range(101, 140)] + [(7, 7)]
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in found} == {**{n: 0 for n in range(21)}, **{n: 100 for n in range(100, 140)}}


def test_components_of_long_chains_take_few_rounds(spark, monkeypatch):
    """Each round costs the driver plans, threads and memory; tasks join what they hold beforehand."""
    rounds = []
    monkeypatch.setattr(components, "checkpointed", lambda df: rounds.append(1) or checkpointed(df))
    links = [(n, n + 1) for n in range(400)] + [(1000 + 7 * n % 300, 1000 + 7 * (n + 1) % 300) for n in range(299)]
    random.Random(6).shuffle(links)
    found = components.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()
    assert {r["node"]: r["label"] for r in found} == {**{n: 0 for n in range(401)}, **{n: 1000 for n in range(1000, 1300)}}
    # A table of links, one of labels, and the rounds.
    assert len(rounds) <= 2 + 3


def test_forests_hold_few_nodes_at_once(spark, monkeypatch):
    monkeypatch.setattr(components, "FOREST_NODES", 10)
    links = [(n, n + 1) for n in range(0, 200)] + [(500, n) for n in range(501, 560)]
    random.Random(7).shuffle(links)
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in found} == {**{n: 0 for n in range(201)}, **{n: 500 for n in range(500, 560)}}


def test_neighbours_are_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 8))
    vectors[50:90] = vectors[0]
    rows = [(n, v.astype(float).tolist()) for n, v in enumerate(vectors)]
    rows += [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [1.0, None] * 4), (None, [1.0] * 8), (404, [1.0, 2.0]), (450, [2.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest(table, table.where("vec_id % 50 = 0"), k=5, block_bytes=256).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        scores = units @ units[q]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-round(scores[i], 12), i))[:5]
        assert got[q] == [(i, round(scores[i], 9)) for i in best]
    assert [v for v, _ in got[450]] == [404] and set(got) == {*range(0, 300, 50), 450}


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    good = [f"{w} calm lines of many words that go on {w} and on until the {n} end of text" for n, w in enumerate("abcdefghij" * 3)]
    rows = [(n, t, "en", "s", len(t)) for n, t in enumerate(good)]
    rows += [(100, good[3], "en", "s", 1), (101, "123 456", "en", "s", 1), (102, None, None, "s", 0)]
    rows += [(200 + n, "WORD!! LOUD!! NOISE!! " * (n + 1), "en", "s", 1) for n in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(n, 1, 0) for n in range(30)] + [(200 + n, 0, 0) for n in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, str(tmp_path)).collect(), docs.schema)
        assert kept.columns == docs.columns, name
        ids.append({r["doc_id"] for r in kept.collect()})
    assert not ids[0] & {101, 102}
    assert ids[1] == {*range(30), 100}
    assert ids[2] == set(range(30))
    texts = {n: t for n, t in enumerate(good)}
    assert ids[3] == {int(c) for _, _, c in brute_components(list(texts.items()))}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == ids[3]


def test_near_copies_of_the_pipeline_are_brute_force(spark):
    import corpus_pipeline

    rows = [(i, t) for i, t in near_copies(5) if i is not None]
    text = [f"v{n}" for n in range(100)]
    # Two inner words changed: 89 / 105 of the four-word shingles, 86 / 106 of the five-word ones.
    rows += [(2000, " ".join(text)), (2001, " ".join("z" if n in (30, 60) else w for n, w in enumerate(text)))]
    # Three: 83 / 109, below 0.8.
    rows += [(2002, " ".join("y" if n in (20, 50, 80) else w for n, w in enumerate(text)))]
    sets = {i: shingles(t, 5) for i, t in rows}
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * common >= 80 * len(sets[a] | sets[b]):
                least, other = sorted((group[a], group[b]))
                group = {i: least if g == other else g for i, g in group.items()}
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs_of_rows(spark, rows), "").collect()}
    assert kept == set(group.values())
    assert 2000 in kept and 2001 not in kept and 2002 in kept


def docs_of_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_stages_of_the_pipeline_hold_small_batches(spark, tmp_path):
    import corpus_pipeline

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = docs_of_rows(spark, [(n, f"{n} " + "word " * 40_000) for n in range(60)])
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    try:
        for stage in ("language", "quality", "near_dedup", "packing"):
            spark.conf.set(name, before)
            dict(corpus_pipeline.STAGES)[stage](spark, docs.limit(0).withColumn("lang", F.lit("en")), str(tmp_path))
            held = [r["n"] for r in docs.coalesce(1).mapInArrow(sizes, "n long").collect()]
            assert len(held) > 1 and max(held) < 5 << 20, stage
    finally:
        spark.conf.set(name, before)
