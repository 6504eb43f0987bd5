import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from chunkwright.llm.packing import Budget, best_fit, bin_completion, containers, cut_points, fillings, pack, packed_texts


def fewest(sizes, capacity):
    """By trying every assignment."""
    for n in range(1, len(sizes) + 1):
        for where in itertools.product(range(n), repeat=len(sizes)):
            if all(sum(s for s, w in zip(sizes, where) if w == b) <= capacity for b in range(n)):
                return n
    return 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=6))
def test_as_few_containers_as_any_assignment(sizes):
    bins = bin_completion(sizes, 20)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 20 for b in bins)
    assert len(bins) == fewest(sizes, 20)


def undominated(rest, room):
    """Fillings by size for which no set of items left out, each in place of items taken that together aren't larger, fills more, by trying all."""
    sets = {}
    for n in range(len(rest) + 1):
        for at in itertools.combinations(range(len(rest)), n):
            if sum(rest[i] for i in at) <= room:
                sets[tuple(sorted((rest[i] for i in at), reverse=True))] = at

    def dominated(taken):
        left = list(rest)
        for x in taken:
            left.remove(x)
        free = room - sum(taken)
        for n in range(len(taken) + 1):
            for away in itertools.combinations(taken, n):
                if any(sum(away) <= x <= sum(away) + free and (x > sum(away) or n > 1) for x in left):
                    return True
        return False

    return {f for f in sets if not dominated(f)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=7), st.integers(0, 30))
def test_every_undominated_filling_comes_once(rest, room):
    found = list(fillings(sorted(rest), room, room, Budget(None)))
    assert len(set(found)) == len(found) and set(found) == undominated(sorted(rest), room)
    waste = [room - sum(f) for f in found]
    few = list(fillings(sorted(rest), room, min(2, room), Budget(None)))
    assert set(few) == {f for f, w in zip(found, waste) if w <= 2}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=6))
def test_a_search_to_the_end_is_exact(sizes):
    assert len(bin_completion(sizes, 20, None)) == fewest(sizes, 20)


def test_many_small_items_are_searched_too():
    rng = random.Random(4)
    sizes = [rng.randint(1, 100) for _ in range(3000)]
    assert len(bin_completion(sizes, 8192)) == -(-sum(sizes) // 8192)


def test_the_search_beats_best_fit():
    sizes = [6, 5, 5, 4, 4, 3, 3]  # best fit needs 4 containers of 10
    assert len(best_fit(sizes, 10)) >= len(bin_completion(sizes, 10)) == 3
    rng = random.Random(1)
    better = 0
    for _ in range(30):
        sizes = [rng.randint(20, 70) for _ in range(40)]
        a, b = len(best_fit(sizes, 100)), len(bin_completion(sizes, 100, 30_000))
        assert b <= a
        better += b < a
    assert better


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \néジ🎉", max_size=200), st.integers(4, 40))
def test_cuts_are_whole_characters(text, capacity):
    raw = text.encode()
    cuts = cut_points(text, capacity)
    assert b"".join(raw[a : a + n] for a, n in cuts) == raw
    assert all(n <= capacity for _, n in cuts)
    for a, n in cuts:
        raw[a : a + n].decode()


def test_rows(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(1, 3000 if i % 40 else 9000)) for i in range(300)] + [(300, None), (301, ""), (302, "é" * 20_000), (5, "twice")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumnRenamed("x", "y")
    out = pack(df, shard_tokens=400_000).collect()
    whole = {}
    for r in out:
        whole.setdefault(r["doc_id"], []).append(r)
    assert set(whole) == set(range(303))
    assert whole[300][0]["container"] is None and whole[301][0]["container"] is None
    assert len(whole[302]) == 5 and len(whole[5]) == 2
    sizes = {k: len((t or "").encode()) for k, t in rows if k != 5}
    for k, parts in whole.items():
        if k != 5:
            assert sum(p["size"] for p in parts) == sizes[k] and (len(parts) > 1) == (sizes[k] > 8192)
    filled = containers(pack(df, shard_tokens=400_000)).collect()
    assert all(0 <= r["left_empty"] < 8192 for r in filled)
    assert len(filled) <= sum(sizes.values()) / 8192 + 6
    assert pack(df.limit(0)).count() == 0
    unique = df.where("doc_id != 5")
    texts = {}
    for r in sorted(packed_texts(pack(unique, shard_tokens=400_000), unique).collect(), key=lambda r: (r["doc_id"], r["piece_index"])):
        texts[r["doc_id"]] = None if r["text"] is None else texts.get(r["doc_id"], "") + r["text"]
    assert texts == {k: t for k, t in rows if k != 5}


def test_a_key_with_most_rows_is_spread(spark):
    df = spark.createDataFrame([(None if i % 2 else 7, "x" * 4000) for i in range(200)], "doc_id bigint, text string")
    shards = {}
    for r in pack(df, shard_rows=20).collect():
        shards[r["container"] >> 32] = shards.get(r["container"] >> 32, 0) + 1
    assert len(shards) == 10 and max(shards.values()) < 60


def test_keys_may_be_missing_or_large(spark):
    df = spark.createDataFrame([(None, "a" * 9000), (2**62 + 1, "b"), (None, None)], "doc_id bigint, text string")
    out = sorted((r["doc_id"] or 0, r["size"], r["container"] is None) for r in pack(df).collect())
    assert out[0] == (0, 0, True) and out[-1] == (2**62 + 1, 1, False) and sum(n for k, n, _ in out if not k) == 9000
