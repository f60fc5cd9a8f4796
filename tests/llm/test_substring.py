from collections import defaultdict

import numpy as np
import pytest

from weftframe.llm import substring

from .helpers import corpus, prose, rows, ugly_rows, with_clashes


def brute(data, k):
    """(doc_id, first, end, leads) runs of repeated windows, for rows that are told apart by id and text."""
    where = defaultdict(list)
    docs = defaultdict(int)
    for i, t in data:
        docs[i, t] += 1
    for (i, t), n in docs.items():
        w = [x for x in "".join(c if c > " " else " " for c in t or "").split(" ") if x]
        for a in range(len(w) - k + 1):
            where[tuple(w[a : a + k])].append((-(2**63) if i is None else i, a, t, n))
    marks = defaultdict(set)
    for places in where.values():
        if sum(p[3] for p in places) > 1:
            least = min(p[:2] for p in places)
            for i, a, t, _ in places:
                marks[i, t, (i, a) == least].add(a)
    out = set()
    for (i, t, leads), at in marks.items():
        for a in sorted(at):
            if a - 1 not in at:
                e = a
                while e in at:
                    e += 1
                out.add((i, a, e, leads))
    return sorted(out)


def found(docs, k, m, most=8 << 20):
    return sorted({(r["did"], r["first"], r["end"], r["leads"]) for r in substring.repeats(docs, k, m, most).collect()})


@pytest.mark.parametrize(("k", "m", "most", "longest"), [(8, 3, 8 << 20, 512), (5, 5, 0, 512), (50, 10, 8 << 20, 7), (50, 10, 2000, 20)])
def test_equals_brute_force(spark, monkeypatch, k, m, most, longest):
    monkeypatch.setattr(substring, "LONGEST", longest)
    passage = prose(50, 70, fresh=True)
    data = [(i, prose(i, 40)) for i in range(25)]
    data += [(100 + i, f"{prose(100 + i, 30, fresh=True)} {passage} {prose(200 + i, 20, fresh=True)}") for i in range(6)]
    data += [(300, " ".join([passage] * 3)), (301, "a b " * 60), (302, passage.replace(" ", "\n\t ")), (303, passage)]
    assert found(corpus(spark, data), k, m, most) == brute(data, k)


def test_numbers_are_equal_where_runs_are():
    rng = np.random.default_rng(3)
    for k in (1, 2, 3, 7, 50):
        ids = np.tile(rng.integers(0, 3, 90), 3)
        got = substring.numbered(ids, k)
        want = [tuple(ids[i : i + k]) for i in range(len(ids) - k + 1)]
        assert len({*zip(got.tolist(), want, strict=True)}) == len({*got.tolist()}) == len({*want})
    assert len(substring.numbered(np.array([1, 2]), 5)) == 0


def test_a_long_repetition_is_one_short_string(spark):
    text = "word " * 400_000  # 2 MB
    docs = corpus(spark, [(1, text), (2, "other " + text)])
    n = 400_000 - 49
    assert found(docs, 50, 10) == [(1, 0, 1, True), (1, 1, n, False), (2, 1, n + 1, False)]
    keyed = docs.selectExpr("doc_id did", "doc_id th", "text")
    minis = substring.places(keyed, 50, 10)
    strings = substring.packed(keyed, minis.select("did", "th", "start", "windows", "mini"), 50)
    assert strings.select("words").distinct().count() <= 5


def test_ugly_rows(spark):
    data = [(r[0], r[1]) for r in ugly_rows()]
    docs = with_clashes(corpus(spark, ugly_rows()))
    assert found(docs, 50, 10) == brute(data, 50)
    out = substring.cut(docs)
    assert out.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in out.collect()]
    same = data[7][1]
    assert (6, same) in left and (7, same) not in left  # the first copy stays; a row that loses all its words goes
    assert {(i, t) for i, t in data if i not in (6, 7)} - {*left} == set()  # rows without words had none to lose


def test_cut_removes_later_occurrences_only(spark):
    p = prose(9, 60, fresh=True)
    docs = corpus(spark, [(1, f"first {p} end"), (2, f"second {p} stop"), (3, p)])
    assert rows(substring.cut(docs).select("doc_id", "text", "n_chars")) == [(1, f"first {p} end", len(p) + 10), (2, "second stop", 11)]


def test_empty_table(spark):
    docs = corpus(spark, [])
    assert substring.repeats(docs).count() == 0
    assert substring.cut(docs).count() == 0
