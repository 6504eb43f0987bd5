import numpy as np
import pytest

from chunkwright.llm.mixing import _marked, mix, mix_report, mixed_tokens, permuted, shard_draw, slots_needed


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 100, 1000, 4097])
def test_a_permutation_hits_every_index_once(n):
    assert sorted(permuted(np.arange(n), n, 7).tolist()) == list(range(n))
    assert n < 50 or permuted(np.arange(n), n, 7).tolist() != permuted(np.arange(n), n, 8).tolist()


def test_draws_add_up_to_the_quotas():
    quota = np.array([1000, 0, 37, 5000])
    shards, slots = -(-int(quota.sum()) // 64), 64
    at = np.zeros(4, int)
    for s in range(shards):
        before, drawn = shard_draw(s, shards, slots, quota, 3)
        assert (before == at).all() and drawn.sum() == (slots if s < shards - 1 else quota.sum() - slots * (shards - 1))
        at = at + drawn
    assert (at == quota).all()


@pytest.mark.parametrize(("marked", "others", "drawn"), [(2 * 10**9, 3 * 10**9, 10**9), (5, 10**12, 4 * 10**11), (10**12, 7, 6 * 10**11), (10**12, 10**12, 9), (10**11, 10**6, 10**11)])
def test_draws_of_any_size(marked, others, drawn):
    rng = np.random.default_rng(1)
    got = np.array([_marked(marked, others, drawn, rng) for _ in range(2000)], float)
    total = marked + others
    mean, var = drawn * marked / total, drawn * marked / total * (others / total) * ((total - drawn) / (total - 1))
    assert abs(got.mean() - mean) < 5 * (var / 2000) ** 0.5 + 1e-9 * mean and 0.8 * var < got.var() < 1.2 * var
    assert got.min() >= max(0, drawn - others) and got.max() <= min(marked, drawn)


def test_draws_of_huge_mixtures_add_up():
    quota = np.array([10**12, 10**10, 3, 0])
    shards = -(-int(quota.sum()) // 4096)
    before, drawn = shard_draw(shards // 3, shards, 4096, quota, 3)
    after, _ = shard_draw(shards // 3 + 1, shards, 4096, quota, 3)
    assert drawn.sum() == 4096 and (before + drawn == after).all()
    other, _ = shard_draw(shards // 3, shards, 4096, quota, 4)
    assert (other != before).any()


@pytest.mark.parametrize("size", [1, 63, 64, 65, 1000])
def test_slots_hold_the_target_whichever_blocks_they_are(size):
    n = -(-size // 64)
    for target in range(0, 3 * size + 2):
        q = slots_needed(target, size, 3, 64)
        assert 0 <= q <= 3 * n
        times, rest = divmod(q, n)
        worst = times * size + (min(rest * 64, rest * 64 - (n * 64 - size)) if rest else 0)
        assert worst >= min(target, 3 * size)
        assert q * 64 <= target + 2 * 64 + (times + 1) * (n * 64 - size)


def corpus(spark):
    rows = [(i, "a" * 700, "big") for i in range(200)] + [(1000 + i, "é" * 150, "small") for i in range(10)] + [(2000, None, "big"), (2001, "", "small"), (2002, "z" * 999, None), (2003, "q" * 500, "unlisted"), (2003, "q" * 500, "unlisted")]
    targets = [("big", 500, 1), ("small", 400, 3), ("none", 100, 2)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string"), spark.createDataFrame(targets, "source string, target_permille int, max_repeats int")


def test_shares_and_repeats(spark):
    df, targets = corpus(spark)
    total = 200 * 700 + 3000 + 999 + 1000
    report = {r["source"]: r for r in mix_report(df, targets, block=64, shard_slots=100).collect()}
    assert report["small"]["short"] and report["none"]["short"] and not report["big"]["short"]
    assert report["small"]["reached_size"] == 9000 and report["none"]["reached_size"] == 0 and report["none"]["source_size"] == 0
    assert abs(report["big"]["reached_size"] - total / 2) <= 128
    mixed, plan = mix(df, targets, block=64, shard_slots=100)
    rows = mixed.collect()
    uses = {}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in df.collect()}
    for r in rows:
        assert r["byte_start"] + r["byte_length"] <= len(texts[r["doc_id"]]) and r["byte_length"] > 0
        for b in range(r["byte_start"], r["byte_start"] + r["byte_length"]):
            uses[r["doc_id"], b] = uses.get((r["doc_id"], b), 0) + 1
    assert {n for (k, _), n in uses.items() if k >= 1000} == {3} and max(n for (k, _), n in uses.items() if k < 1000) == 1
    assert len({(r["shard"], r["slot"], r["part"]) for r in rows}) == len(rows)
    assert len({(r["shard"], r["slot"]) for r in rows}) == sum(plan.quota)
    slots = mixed_tokens(mixed, df.where("doc_id != 2003")).collect()
    assert len(slots) == sum(plan.quota) and all(0 < len(r["tokens"]) <= 64 for r in slots)
    assert {bytes(r["tokens"]) for r in slots if r["source"] == "big"} <= {b"a" * n for n in range(1, 65)}
    assert sum(len(r["tokens"]) for r in slots) == sum(r["byte_length"] for r in rows)


def test_empty_tables(spark):
    df, targets = corpus(spark)
    assert mix_report(df, targets.limit(0)).count() == 0
    empty = mix_report(df.limit(0), targets).collect()
    assert [r["reached_size"] for r in empty] == [0, 0, 0] and not any(r["short"] for r in empty)
