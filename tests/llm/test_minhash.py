"""Near-duplicates by signatures against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quillsift.llm import minhash
from quillsift.llm.word_hash import mix


def shingles(text, size=4):
    words = (text or "").lower().split()
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[n : n + size]) for n in range(len(words) - size + 1))


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted((str(i), len(s), str(least.get(g)), i == least.get(g)) for (i, _), s, g in zip(rows, sets, group, strict=True))


def altered(seed, bases=6, copies=14):
    rng = random.Random(seed)
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "one two"), (1005, "One TWO three"), (None, "one two")]
    rows += [(1006, None), (1003, "one two"), (None, "a text that nobody else has at all")]
    for base in range(bases):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice((5, 30, 60, 120, 400)))]
        for copy in range(copies):
            changed = list(words)
            for _ in range(rng.randrange(1 + len(words) // 25 + 2)):
                changed[rng.randrange(len(changed))] = f"x{rng.randrange(400)}"
            rows.append((base * 100 + copy, " ".join(changed)))
    # A drifting chain: neighbours are similar, the ends are not.
    words = [f"c{n}" for n in range(200)]
    for step in range(12):
        words[step * 15] = f"d{step}"
        words[step * 15 + 7] = f"e{step}"
        rows.append((2000 + step, " ".join(words)))
    # One passage in many texts that are not similar otherwise.
    passage = [f"p{n}" for n in range(60)]
    rows += [(3000 + n, " ".join([f"q{n}_{k}" for k in range(20)] + passage)) for n in range(20)]
    return rows


@pytest.mark.parametrize(("seed", "cell"), [(1, 2048), (2, 3), (3, 8)])
def test_near_duplicates_are_brute_force(spark, seed, cell):
    rows = altered(seed)
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, node int, label string")
    found = minhash.near_duplicates(docs.repartition(3), cell_nodes=cell, cell_shingles=60 * cell).collect()
    assert sorted((str(r["id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in found) == brute(rows)


@pytest.mark.parametrize("limit", [3, 7, 100])
def test_dealt_pairs_meet_once(spark, limit):
    """Every pair but two of the bulk meets in one cell; nodes of a block within the limit are one row each."""
    rng = random.Random(limit)
    rows = [(block, node, rng.choice((0, 0, 0, node))) for block, n in ((1, 9), (2, 23), (3, 4)) for node in range(n)]
    rows += [(4, node, 5) for node in range(6)]
    cells = {}
    made = 0
    for r in minhash.dealt(spark.createDataFrame(rows, "block long, node long, label long"), minhash.F.lit(1), limit).collect():
        cells.setdefault((r["block"], r["kind"], r["low"], r["high"]), []).append((r["node"], r["label"], r["is_bulk"], r["part"]))
        made += 1
    met = []
    for cell, members in cells.items():
        nodes, labels, bulk, parts = map(np.array, zip(*members, strict=True))
        signed = np.zeros((len(nodes), minhash.VALUES), dtype=np.uint32)
        for i, found in minhash.near_pairs(signed, labels, bulk, parts, cell):
            met += [(cell[0], *sorted((int(nodes[i]), int(nodes[j])))) for j in found]
    expected = [(b, i, j) for b, i, x in rows for c, j, y in rows if b == c and i < j and x != y]
    assert sorted(met) == sorted(expected)
    if limit == 100:
        assert made == len(rows) - 6  # the last block has one label


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    found = minhash.near_duplicates(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_every_pair_within_the_radius_shares_a_key():
    rng = np.random.default_rng(7)
    for distance in range(minhash.VALUES + 1):
        first = rng.integers(0, 2**32, (300, minhash.VALUES), dtype=np.uint32)
        second = first.copy()
        for row in second:
            row[rng.choice(minhash.VALUES, distance, replace=False)] += np.uint32(1)
        same = minhash.chunk_keys(first) == minhash.chunk_keys(second)
        if distance <= minhash.RADIUS:
            assert same.any(axis=1).all(), distance
        if distance > minhash.VALUES - minhash.CHUNK + minhash.ERRORS:
            assert not same.any()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(8)
    differ = []
    for _ in range(300):
        pool = mix(rng.integers(0, 2**63, 120, dtype=np.uint64))
        first, second = minhash.signatures([np.sort(pool[:108]), np.sort(pool[12:])])
        differ.append((first != second).sum())
    assert abs(np.mean(differ) - 0.2 * minhash.VALUES) < 0.3
    assert max(differ) <= minhash.RADIUS


def test_a_radius_too_small_is_refused(spark):
    assert minhash.miss_chance(80) < 1e-6
    with pytest.raises(ValueError, match="too low"):
        minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), percent=50)
