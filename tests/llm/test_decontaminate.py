import random

from weftframe.llm import _text, decontaminate

from .helpers import corpus, prose, rows, ugly_rows, with_clashes

ITEMS = "item_id bigint, text string"


def distance(item, text):
    """The smallest edit distance between item and any passage of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def brute(docs, items, rate=0.06):
    out = []
    for i, t in docs:
        for k, a in {(k, _text.plain_text(q or "")) for k, q in items}:
            b, budget = _text.plain_text(t or ""), int(len(a) * rate)
            if not a or not b:
                continue
            if not budget:
                d = 0 if f" {a} " in f" {b} " else 1
            else:
                d = distance(a, b)
            if d <= budget:
                out.append((i, k, d, budget))
    return sorted(out, key=repr)


def edited(rng, text, edits):
    for _ in range(edits):
        at = rng.randrange(len(text))
        text = rng.choice([text[:at] + "q" + text[at:], text[:at] + text[at + 1 :], text[:at] + "q" + text[at + 1 :]])
    return text


def test_equals_brute_force(spark):
    rng = random.Random(3)
    items = [(k, prose(500 + k, 14, fresh=True)) for k in range(6)] + [(6, "too short"), (7, None), (8, "!!!"), (None, prose(600, 12)), (9, prose(500, 14, fresh=True).upper())]
    docs = [(i, prose(i, 25, fresh=True)) for i in range(10)]
    docs += [(100 + 10 * k + e, f"{prose(k, 8)} {edited(rng, items[k][1], e)} {prose(e, 8)}") for k in range(6) for e in (0, 1, 3, 5, 8, 12)]
    docs += [(300, "This one is too short."), (301, "too, SHORT"), (302, "too shortly"), (303, "not too"), (304, "short"), (305, "too short")]
    docs += [(200, items[0][1]), (200, items[0][1]), (None, items[1][1]), (201, items[2][1][3:]), (202, items[2][1][:-4])]
    got = rows(decontaminate.contaminated(corpus(spark, docs), spark.createDataFrame(items, ITEMS)))
    assert got == brute(docs, items)
    assert {r[0] for r in got if r[1] == 6} == {300, 301, 305}
    in_parts = rows(decontaminate.contaminated(corpus(spark, docs), spark.createDataFrame(items, ITEMS), part_bytes=200, chunk_bytes=1000))
    assert in_parts == got
    left = decontaminate.drop_contaminated(corpus(spark, docs), spark.createDataFrame(items, ITEMS), part_bytes=200, chunk_bytes=1000)
    assert sorted((r["doc_id"] for r in left.collect()), key=repr) == sorted((i for i, _ in docs if i not in {r[0] for r in got}), key=repr)


def test_ugly_rows_and_clashing_columns(spark):
    item = prose(2, 120, fresh=True)
    bench = with_clashes(spark.createDataFrame([(1, item), (1, item), (None, None), (2, "")], ITEMS))
    docs = with_clashes(corpus(spark, ugly_rows()))
    assert {r[0] for r in rows(decontaminate.contaminated(docs, bench))} == {6, 7}
    out = decontaminate.drop_contaminated(docs, bench)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == sorted((r[0] for r in ugly_rows() if r[0] not in (6, 7)), key=repr)


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], ITEMS), spark.createDataFrame([(1, prose(1, 30))], ITEMS)
    docs = corpus(spark, [(1, prose(1, 30))])
    assert decontaminate.contaminated(docs, none).count() == 0
    assert decontaminate.drop_contaminated(docs, none).count() == 1
    assert decontaminate.drop_contaminated(corpus(spark, []), items).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    d = "/root/testdata/sf0.001"
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    short = [(i, t[:400]) for i, t in docs[:40]] + [(10_000 + i, f"before {edited(rng, q[:150], i % 9)} after") for i, q in items]
    items = [(i, q[:150]) for i, q in items]
    corpus(spark, short).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert rows(decontaminate.op4_decontamination(spark, str(tmp_path))) == brute(short, items)
    whole = {(r["doc_id"], r["item_id"]) for r in decontaminate.op4_decontamination(spark, d).collect()}
    items = [(r[0], _text.plain_text(r[1])) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert {(i, k) for i, t in docs for k, q in items if q in _text.plain_text(t)} <= whole
