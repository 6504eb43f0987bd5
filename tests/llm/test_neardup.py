import random
import re

import pytest

from chunkwright.llm import neardup
from chunkwright.llm.neardup import NearDuplicates, most_differing_bits


def corpus():
    rng = random.Random(4)
    vocabulary = ["w%d" % i for i in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(80)]
    for i in range(60):
        words = rows[i][1].split()
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)]
        rows.append((100 + i, " ".join(words)))
    rows += [(300 + i, rows[5][1].upper() + "!") for i in range(4)] + [(400, None), (401, ""), (402, "two words"), (403, "a b c"), (404, "a-b, c"), (405, "word " * 30_000)]
    rng.shuffle(rows)
    return rows


def similar(rows, threshold=0.6):
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if len(w) >= 3:
            sets[k] = set(zip(w, w[1:], w[2:]))
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.mark.parametrize("block", [512, 2])
def test_pairs_and_groups_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)  # a small one sends every bucket of more than four through the blocks
    rows = corpus()
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "chunk_no bigint, text string, key int")
    found = NearDuplicates(df)
    got = [tuple(r) for r in found.pairs().collect()]
    want = similar(rows)
    assert len(got) == len(set(got)) and set(got) <= want and len(want - set(got)) <= len(want) // 100
    groups = {r["key"]: r["group_key"] for r in found.groups().collect()}
    label = {k: k for k in groups}
    for _ in range(len(label)):
        for a, b in got:
            label[a] = label[b] = min(label[a], label[b])
    assert groups == label


def test_many_copies_become_a_star(spark):
    rows = [(i, "one two three four five") for i in range(100)] + [(200, "one two three four five six")]
    found = NearDuplicates(spark.createDataFrame(rows, "chunk_no bigint, text string"))
    got = {tuple(r) for r in found.pairs(max_copies=20).collect()}
    assert got == {(0, i) for i in range(1, 100)} | {(0, 200)}
    assert len(found.pairs(max_copies=100).collect()) == 100 * 99 // 2 + 100
    assert {r["group_key"] for r in found.groups().collect()} == {0}


def test_every_pair_of_large_classes(spark, monkeypatch):
    monkeypatch.setattr(neardup, "COPIES_BLOCK", 7)
    rows = [(i, ["One two three four five", "one, two: three four five\r\n", "ONE TWO THREE FOUR FIVE"][i % 3]) for i in range(70)] + [(100 + i, "one two three four five six" + "!" * i) for i in range(66)] + [(200, "one two three four five six seven")]
    got = [tuple(r) for r in NearDuplicates(spark.createDataFrame(rows, "chunk_no bigint, text string")).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == similar(rows) and len(got) > 9000


def test_empty_table_and_bounds(spark):
    df = spark.createDataFrame([], "chunk_no bigint, text string")
    found = NearDuplicates(df)
    assert found.pairs().count() == 0 and found.groups().count() == 0
    assert most_differing_bits(0.9, 160, 512) < most_differing_bits(0.6, 160, 512) < 256


def test_the_sketch_estimates_the_similarity():
    import math

    import numpy as np

    rng = np.random.default_rng(0)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    sets = [np.concatenate((common, a)), np.concatenate((common, b))]
    mins = neardup.signatures(np.concatenate(sets), np.array([0, 900, 1800]), 1024)
    sketch = neardup.odd_sketches(mins, 512).view(np.uint64)
    d = int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())
    estimate = 1 + 512 / (4 * 1024) * math.log(1 - 2 * d / 512)
    assert abs(estimate - 0.8) < 0.05
