import random
import re
import time
from itertools import combinations

import numpy as np

from weftframe.llm import jaccard
from weftframe.plans import scratch

from .helpers import corpus, prose, rows, ugly_rows, with_clashes


def grams(text, n=3):
    w = re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", (text or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def pairs(data, threshold):
    """(a, b, similarity) of rows, by their positions; equal documents once."""
    seen, sets = set(), {}
    for k, (i, x) in enumerate(data):
        if i is not None and grams(x) and (i, x) not in seen:
            seen.add((i, x))
            sets[k] = grams(x)
    out = []
    for (a, x), (b, y) in combinations(sets.items(), 2):
        s = len(x & y) / len(x | y)
        if s >= threshold:
            out.append((a, b, s))
    return out


def brute(data, threshold):
    """(doc_id, class_id, links) of each row."""
    root, links = list(range(len(data))), [0] * len(data)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in pairs(data, threshold):
        links[a] += 1
        links[b] += 1
        root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(data):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    first = {row: k for k, row in reversed(list(enumerate(data)))}
    return sorted(((i, least[find(first[i, x])] if links[first[i, x]] else None, links[first[i, x]]) for i, x in data), key=repr)


def near_copies(seed, base, copies, rate, start):
    rng = random.Random(seed)
    words = base.split()
    return [(start + c, " ".join(f"w{rng.randrange(10**6)}" if rng.random() < rate else w for w in words)) for c in range(copies)]


def mixture():
    data = [(i, prose(i, 60, fresh=True)) for i in range(60)]
    for g, rate in enumerate((0.005, 0.01, 0.02, 0.03, 0.04)):
        data += near_copies(g, prose(900 + g, 150, fresh=True), 12, rate, 1000 + 100 * g)
    return data + [(2000 + i, data[-1][1]) for i in range(5)]


def test_recall_and_precision(spark):
    data = mixture()
    got, want = rows(jaccard.join(corpus(spark, data), 0.5)), brute(data, 0.5)
    have, all_ = sum(r[2] for r in got), sum(r[2] for r in want)
    assert 0.95 * all_ <= have <= all_ and all_ > 400
    assert all(g[0] == w[0] and g[2] <= w[2] for g, w in zip(got, want, strict=True))
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.95 * len(want)


def test_large_groups_go_by_blocks(spark):
    data = near_copies(5, prose(7, 100, fresh=True), 70, 0.03, 0)
    data += [(500 + i, data[3][1]) for i in range(4)]
    got, want = rows(jaccard.join(corpus(spark, data), 0.5, block=16)), brute(data, 0.5)
    assert got == rows(jaccard.join(corpus(spark, data), 0.5)) == rows(jaccard.join(corpus(spark, data), 0.5, most=20_000))
    assert 0.95 * sum(r[2] for r in want) <= sum(r[2] for r in got) <= sum(r[2] for r in want)
    assert jaccard.drop_copies(corpus(spark, data)).count() == 1


def test_copies_do_not_multiply_rows(spark):
    data = [(i, "the same few words again") for i in range(3000)] + [(5000, "and other words here")]
    got = jaccard.join(corpus(spark, data))
    assert rows(got) == sorted([(i, 0, 2999) for i in range(3000)] + [(5000, None, 0)], key=repr)


def test_keys_that_go_over_many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        reps = spark.createDataFrame([(i, bytes([i % 3] * 8), [1, 100 + i % 2]) for i in range(50)], "th bigint, sketch binary, keys array<bigint>")
        got = rows(jaccard.neighbours(reps))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    root = list(range(50))
    for a, b in got:
        assert a < b
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    assert set(root) == {0} and len(got) <= 4 * 50


def test_compare_in_slices_equals_sets(monkeypatch):
    monkeypatch.setattr(jaccard, "WIDTH", 7)
    rng = np.random.default_rng(1)
    tokens = sorted((np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(40)), key=lambda t: t[0])
    left, right = np.arange(0, 40, 2), np.arange(1, 40, 2)
    hit = jaccard.compare(np.array([float(len(t)) for t in tokens]), tokens, np.array([t[0] for t in tokens]), 0.4, left, right)
    sets = [set(t.tolist()) for t in tokens]
    assert hit.any() and (hit == [[len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.4 for b in right] for a in left]).all()


def test_long_chains_are_tied():
    hit = np.zeros((30, 30), bool)
    hit[np.arange(29), np.arange(1, 30)] = hit[np.arange(1, 30), np.arange(29)] = True
    assert not jaccard.tied(hit, np.arange(30), np.arange(30), 30).any()


def test_ugly_rows(spark):
    docs = with_clashes(corpus(spark, ugly_rows()))
    assert rows(jaccard.join(docs)) == brute([(r[0], r[1]) for r in ugly_rows()], 0.5)
    out = jaccard.drop_copies(docs)
    assert out.columns == docs.columns
    ids = sorted((r["doc_id"] for r in out.collect()), key=repr)
    assert ids == sorted((r[0] for r in ugly_rows() if r[0] != 7), key=repr)


def test_one_id_with_similar_texts(spark):
    data = [(1, "one two three four"), (1, "one two three four five"), (2, "one two three four")]
    assert rows(jaccard.join(corpus(spark, data))) == brute(data, 0.5) == [(1, 1, 2), (1, 1, 2), (2, 1, 2)]
    assert jaccard.drop_copies(corpus(spark, data)).count() == 1


def test_short_texts_and_ties(spark):
    data = [(3, "one two"), (1, "One, two!"), (2, "two one"), (4, "one two three four"), (5, "one two three four")]
    assert rows(jaccard.join(corpus(spark, data))) == [(1, 1, 1), (2, None, 0), (3, 1, 1), (4, 4, 1), (5, 4, 1)]


def test_empty_table(spark):
    assert jaccard.join(corpus(spark, [])).count() == 0
    assert jaccard.drop_copies(corpus(spark, [])).count() == 0


def test_no_link_is_lost_between_groups(spark):
    rng = random.Random(3)
    data = [(i, prose(i, 40, fresh=True)) for i in range(20)]
    for g in range(60):  # pairs just at the threshold: one word in eight changed, and half of a text in another
        base = prose(5000 + g, 96, fresh=True).split()
        other = [f"z{rng.randrange(10**6)}" if k % 8 == 4 else w for k, w in enumerate(base)]
        data += [(100 + 4 * g, " ".join(base)), (101 + 4 * g, " ".join(other)), (102 + 4 * g, " ".join(base[:50])), (103 + 4 * g, " ".join(base[46:]))]
    want = brute(data, 0.5)
    assert sum(r[2] for r in want) > 200
    assert rows(jaccard.join(corpus(spark, data), 0.5)) == want
    assert rows(jaccard.join(corpus(spark, data), 0.37)) == brute(data, 0.37)


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(k).getName() for k in range(files.size()))
    return {name for name in names if name.startswith("shuffle_")}


def test_intermediate_tables_leave_no_shuffle_files(spark, monkeypatch):
    stash, left = jaccard._shared.stash, {}

    def watched(df, name, **more):
        before = shuffle_files(spark)
        out = stash(df, name, **more)
        for _ in range(40):  # they are deleted in the background
            left[name] = len(shuffle_files(spark) - before)
            if not left[name]:
                break
            time.sleep(0.05)
        return out

    was = spark.conf.get(scratch.RELEASE)
    monkeypatch.setattr(jaccard._shared, "stash", watched)
    data = mixture()
    assert rows(jaccard.join(corpus(spark, data))) == brute(data, 0.5)
    left.pop("edges")  # of components, which other operators share
    assert set(left) >= {"representatives", "promising", "tokens", "prefixes", "neighbours", "links"} and not any(left.values())
    assert spark.conf.get(scratch.RELEASE) == was


def test_texts_are_sent_once(spark):
    docs = corpus(spark, [(i, prose(i, 60)) for i in range(20)] + [(3, prose(3, 60))])
    left = jaccard.set_hashes(docs, 3).select("did", "th").distinct()
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tokens = jaccard._grams(docs, left.where("did % 2 = 1"), 3)
        plan = tokens._jdf.queryExecution().executedPlan().toString().splitlines()
        assert tokens.count() == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    joined = next(k for k, line in enumerate(plan) if "SortMergeJoin" in line)  # what it sends on stands above it
    assert not any("Exchange" in line for line in plan[:joined])


def test_blocks_of_sizes_too_far_apart_do_not_meet(spark):
    sizes = {k: 10 + k % 5 if k < 60 else 1000 + k % 300 for k in range(120)}
    member = spark.createDataFrame([(k, 1, s) for k, s in sizes.items()] + [(500, 2, 7), (501, 2, 900)], "th bigint, root bigint, size int")
    member = spark.createDataFrame(jaccard.blocked(member, 16, 16 << 20).collect())
    own = {r["th"]: r["own"] for r in member.collect() if r["root"] == 1}
    met = {(r["own"], r["other"]) for r in jaccard.block_pairs(member, 0.5).collect() if r["root"] == 1}
    blocks = set(own.values())
    assert 7 <= len(blocks) <= 9 and max(list(own.values()).count(b) for b in blocks) <= 32
    assert all((own[a], own[b]) in met for a in sizes for b in sizes if min(sizes[a], sizes[b]) >= 0.5 * max(sizes[a], sizes[b]))
    assert (min(blocks), max(blocks)) not in met and len(met) <= 0.7 * len(blocks) ** 2
    assert {r["own"] for r in member.collect() if r["root"] == 2} == {0}
