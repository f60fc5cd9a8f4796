from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftframe.llm import packing

from .helpers import corpus, prose, rows, ugly_rows, with_clashes


def brute(lengths, capacity):
    """Gaps of all bins after placing items one by one where the sum of squares is smallest."""
    gaps = []
    for n in lengths:
        whole, rest = divmod(n, capacity)
        gaps += [0] * whole
        if not rest:
            continue

        def cost(bins):
            return sum(c * c for g, c in Counter(bins).items() if g)

        choices = [(cost([*gaps[:i], g - rest, *gaps[i + 1 :]]), g - rest, 0, i) for i, g in enumerate(gaps) if g >= rest]
        choices.append((cost([*gaps, capacity - rest]), capacity - rest, 1, len(gaps)))
        _, gap, new, i = min(choices)
        gaps[i:] = [gap] if new else [gap, *gaps[i + 1 :]]
    return Counter(gaps)


def gaps_of(placed, capacity):
    used = Counter()
    for _, _, _, words, b, _ in placed:
        used[b] += words
    return Counter(capacity - u for u in used.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 25), max_size=40), st.integers(1, 12))
def test_places_where_the_sum_of_squares_is_smallest(lengths, capacity):
    placed = packing.pack_shard(lengths, capacity)
    assert gaps_of(placed, capacity) == brute(lengths, capacity)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(1, 16))
def test_every_word_has_a_place_of_its_own(lengths, capacity):
    taken = defaultdict(set)
    parts = defaultdict(list)
    for i, part, at, words, b, start in packing.pack_shard(lengths, capacity):
        place = set(range(start, start + words))
        assert not place & taken[b] and start + words <= capacity
        taken[b] |= place
        parts[i].append((part, at, words))
    for i, n in enumerate(lengths):
        assert [p[0] for p in sorted(parts[i])] == list(range(len(parts[i])))
        assert sum(p[2] for p in parts[i]) == n and all(p[1] == p[0] * capacity for p in parts[i])


@pytest.mark.parametrize("per_shard", [3, 1000])
def test_ugly_rows(spark, per_shard):
    docs = with_clashes(corpus(spark, ugly_rows()))
    out = [r.asDict() for r in packing.pack(docs, 64, per_shard).collect()]
    blank = [r for r in out if r["bin"] is None]
    assert Counter(r["doc_id"] for r in blank) == Counter([None, 1, 2, 3]) and all(r["n_words"] == r["part_words"] == 0 for r in blank)
    words = Counter()
    for r in out:
        words[r["doc_id"]] += r["part_words"]
    want = Counter()
    for i, t, *_ in ugly_rows():
        want[i] += len("".join(c if c > " " else " " for c in t or "").split())
    assert words == want
    full = Counter()
    for r in out:
        full[r["bin"]] += r["part_words"]
    assert max(full.values()) == 64


def test_same_result_whatever_the_order(spark):
    docs = corpus(spark, [(i, prose(i, 1 + i % 40)) for i in range(60)])
    assert rows(packing.pack(docs, 50)) == rows(packing.pack(docs.orderBy("text").repartition(5), 50))


def test_copies_of_one_row_go_to_all_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 7)
    out = packing.pack(corpus(spark, [(1, "one two three")] * 500), 50, rows_per_shard=50).collect()
    assert len(out) == 500 and len({r["bin"].split("-")[0] for r in out}) == 10
    places = {(r["bin"], r["bin_start"] + k) for r in out for k in range(3)}
    assert len(places) == 1500


def test_empty_table(spark):
    assert packing.pack(corpus(spark, [])).count() == 0
