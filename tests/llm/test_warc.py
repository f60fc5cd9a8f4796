import random

import pytest
from pyspark.sql import functions as F

from weftframe.llm import _shared, warc

from .helpers import rows

SCHEMA = "page_id bigint, url string, html string"
FAKE = "WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: {}\r\n\r\n"


def pages(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def back(spark, df, split, parts=2):
    folder = _shared.scratch_path(spark, "warc-test")
    warc.write_warc(df.repartition(parts), folder)
    return warc.pages_of(warc.read_warc(spark, folder, split))


@pytest.mark.parametrize("split", [64, 500, 4096, 1 << 20])
def test_round_trip_with_magic_in_payloads(spark, split):
    rng = random.Random(split)
    fakes = ["".join(FAKE.format(rng.choice([0, 3, 10, 57, 10**9])) + "y" * rng.randrange(40) for _ in range(rng.randrange(5))) for _ in range(30)]
    data = [(i, f"http://h/{i}", f) for i, f in enumerate(fakes)]
    assert rows(back(spark, pages(spark, data), split)) == sorted(data, key=repr)


def test_a_whole_file_as_payload(spark):
    inner = b"".join(warc.record(i, f"u{i}", "z" * i) for i in range(20)).decode()
    data = [(1, "a", inner), (2, "b", inner + "tail"), (3, "c", inner[5:])]
    assert rows(back(spark, pages(spark, data), 100)) == sorted(data, key=repr)


def test_nulls_empties_repeats_and_odd_urls(spark):
    data = [(None, None, None), (1, "u", None), (1, "u", ""), (1, "u", ""), (2, None, "x"), (3, " spaced\r\nurl: % + ü", "y"), (4, "u", "é" * 50_000)]
    assert rows(back(spark, pages(spark, data).withColumn("offset", F.lit(1)), 1000)) == sorted(data, key=repr)


def test_empty_table(spark):
    assert back(spark, pages(spark, []), 1000).count() == 0


def test_a_damaged_file_ends_where_its_chain_does(spark, tmp_path):
    a, b = warc.record(1, "a", "one"), warc.record(2, "b", "two")
    (tmp_path / "x.warc").write_bytes(a + b"garbage" + b)
    (tmp_path / "empty.warc").write_bytes(b"")
    assert rows(warc.pages_of(warc.read_warc(spark, f"file://{tmp_path}", 50))) == [(1, "a", "one")]
    assert [r["path"].endswith("x.warc") for r in warc.damaged(spark, f"file://{tmp_path}", 50).collect()] == [True]


@pytest.mark.parametrize("split", [1000, 64 << 10, 1 << 20, 32 << 20])
def test_headers_of_any_length(spark, tmp_path, split):
    a, b, c = (warc.record(i, f"u{i}", "z" * 100) for i in range(3))
    (tmp_path / "x.warc").write_bytes(a + b.replace(b"WARC-Date", b"X-Long: " + b"y" * (3 << 20) + b"\r\nWARC-Date") + c)
    if split < 64 << 10:  # as many splits as that take long
        (tmp_path / "x.warc").write_bytes(a + b.replace(b"WARC-Date", b"X-Long: " + b"y" * 20_000 + b"\r\nWARC-Date") + c)
    assert [r[0] for r in rows(warc.pages_of(warc.read_warc(spark, f"file://{tmp_path}", split)))] == [0, 1, 2]
    assert warc.damaged(spark, f"file://{tmp_path}", split).count() == 0


def test_magic_without_an_end_reads_the_file_once(tmp_path):
    (tmp_path / "x.warc").write_bytes(b"WARC/1.0\r\nno end " * 20_000)
    size = (tmp_path / "x.warc").stat().st_size
    view = warc.Window(f"file://{tmp_path}", str(tmp_path / "x.warc"), size, 0, 1000)
    assert warc.split_links(view, 0, 1000) == {} and view.blank[1] == -1


def test_clashing_columns(spark):
    names = "path size lo at then entry offset headers content rows part".split()
    data = [(1, "u", "x"), (2, None, None)]
    assert rows(back(spark, pages(spark, data).withColumns({n: F.lit("mine") for n in names}), 50)) == data


def test_query_reads_back_all_pages(spark):
    d = "/root/testdata/sf0.001"
    assert rows(warc.op1_warc(spark, d)) == rows(spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html"))
