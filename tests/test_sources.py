"""Import, export and rendering."""

import gzip
import io
import json
import lzma
import tarfile
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import pytest

from weftframe import AuthenticationWarning, FixedWidthReader, PathNotFoundError, Table
from weftframe.sources import fetch

TEXT = "a,b,c\n" + "".join(f"{a},{b},{c}\n" for a in range(3) for b in range(3) for c in range(3))


def table(spark):
    return Table(spark=spark)


@pytest.fixture
def archives(tmp_path):
    (tmp_path / "abc.csv").write_text(TEXT)
    (tmp_path / "abc.csv.gz").write_bytes(gzip.compress(TEXT.encode()))
    (tmp_path / "abc.csv.xz").write_bytes(lzma.compress(TEXT.encode()))
    for name, members in (("abc.csv.zip", ["abc.csv", "other"]), ("abc.zip", ["data.csv"])):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for m in members:
                z.writestr(m, TEXT if m.endswith("csv") else "x\n1\n")
    with tarfile.open(tmp_path / "abc.csv.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("abc.csv")
        info.size = len(TEXT)
        t.addfile(info, io.BytesIO(TEXT.encode()))
    return tmp_path


@pytest.mark.parametrize("name", ["abc.csv", "abc.csv.gz", "abc.csv.xz", "abc.csv.zip", "abc.zip", "abc.csv.tar.gz"])
def test_archives(spark, archives, name):
    t = table(spark).csv_import(str(archives / name), transforms={"*": int})
    assert len(t) == 27 and [tuple(r) for r in t[:2]] == [(0, 0, 0), (0, 0, 1)] and t.import_source.endswith(name)
    assert len(table(spark).csv_import(Path(archives / name))) == 27


def test_archive_members(archives):
    assert fetch.read_text(str(archives / "abc.csv.zip"), zippath="other") == "x\n1\n"
    with zipfile.ZipFile(archives / "two.zip", "w") as z:
        z.writestr("p", "1")
        z.writestr("q", "2")
    with pytest.raises(ValueError, match="members"):
        fetch.read_text(str(archives / "two.zip"))


def test_transforms_filters_and_limits(spark):
    t = table(spark).csv_import(TEXT, transforms={"a": int, "b": (int, 0), "c": lambda v: v.cast("double"), "d": 7}, filters={"a": Table.gt(0), "b": 1}, limit=4)
    assert [tuple(r) for r in t] == [(1, 1, 0.0, 7), (1, 1, 1.0, 7), (1, 1, 2.0, 7), (2, 1, 0.0, 7)]
    bad = table(spark).csv_import("a,b\n1,x\n,2\n", transforms={"a": (int, -1), "b": lambda v: int(v) * 2})
    assert [tuple(r) for r in bad] == [(1, None), (-1, 4)]
    wild = table(spark).csv_import("a,b\n1,x\n2,3\n", transforms={"*": int})
    assert wild.df.dtypes[0][1] == "bigint" and [tuple(r) for r in wild] == [(1, "x"), (2, "3")]
    assert len(table(spark).csv_import(TEXT, limit=0)) == 0
    assert [tuple(r) for r in table(spark).csv_import('x,y\n,""\n"a\nb","c ""d"""\n')] == [("", ""), ("a\nb", 'c "d"')]


def test_names_and_accumulation(spark, archives):
    t = table(spark).csv_import(iter(["1,2", "3,4"]), fieldnames="p q").csv_import(io.StringIO("p,q\n5,6\n"))
    assert [tuple(r) for r in t] == [("1", "2"), ("3", "4"), ("5", "6")] and t.import_source is None
    with pytest.raises(Exception, match="column names"):
        table(spark).csv_import("a,b,c\n1,2,3,4\n")
    assert [tuple(r) for r in table(spark).tsv_import("a\tb\n1\t2\n")] == [("1", "2")]
    t = table(spark).csv_import(str(archives / "abc.csv"), fieldnames=["x", "y", "z"])
    assert len(t) == 28 and t.columns == ["x", "y", "z"]


def test_delimited_export(spark, tmp_path):
    t = table(spark).csv_import(TEXT)
    assert t.csv_export() == TEXT and t.tsv_export(fieldnames="c a").splitlines()[:2] == ["c\ta", "0\t0"]
    t.csv_export(tmp_path / "out.csv")
    assert (tmp_path / "out.csv").read_text() == TEXT
    assert t[:0].csv_export(fieldnames="a b") == "a,b\n"
    t.folder_export(str(tmp_path / "many"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "many")).count() == 27
    assert list(t.as_dataframe("a b").columns) == ["a", "b"]


def test_json(spark, tmp_path):
    rows = [{"a": 1, "d": {"x": 1.5, "y": None}, "l": [1, 2]}, {"a": 2, "d": {"x": 2.5, "y": "q"}, "l": []}]
    t = table(spark).json_import(json.dumps(rows) + "\n")
    assert json.loads(t.json_export()) == rows
    lines = t.json_export(streaming=True)
    assert lines.splitlines() == [json.dumps(r, separators=(",", ":")) for r in rows]
    t.json_export(str(tmp_path / "x.jsonl"))
    assert (tmp_path / "x.jsonl").read_text() == lines and len(table(spark).json_import(str(tmp_path / "x.jsonl"))) == 2
    assert table(spark).json_import('{"a":\n1}\n{"a": 2}\n', streaming=True).frame.count() == 2
    nested = json.dumps({"p": {"q": rows}}) + "\n"
    assert len(table(spark).json_import(nested, path="p.q", limit=1)) == 1
    with pytest.raises(PathNotFoundError):
        table(spark).json_import(nested, path="p.z")
    with pytest.raises(ValueError, match="path"):
        table(spark).json_import(nested, path="p", streaming=True)
    assert json.loads(table(spark).json_export()) == []


def test_json_encoders(spark):
    import datetime as dt

    class Dates(json.JSONEncoder):
        def default(self, o):
            return o.isoformat() if isinstance(o, dt.date) else super().default(o)

    class Nothing(json.JSONEncoder):
        def default(self, o):
            return super().default(o)

    t = table(spark).insert({"d": dt.date(2020, 1, 2)})
    assert json.loads(t.json_export(json_encoder=Dates)) == json.loads(t.json_export(json_encoder=(Nothing, Dates))) == [{"d": "2020-01-02"}]


def test_fixed_width(spark, tmp_path):
    text = "ab  12 x\ncd  34 y\n\n"
    spec = [("Name", 0), (None, 2), ("N", 4, 6, int), ("tail", 7)]
    want = [{"name": "ab", "n": 12, "tail": "x"}, {"name": "cd", "n": 34, "tail": "y"}]
    assert list(FixedWidthReader(spec, text)) == want == list(FixedWidthReader(spec, io.StringIO(text)))
    (tmp_path / "f.txt").write_text(text)
    plain = FixedWidthReader([("name", 0), ("n", 4, 6), ("tail", 7)], str(tmp_path / "f.txt"))
    assert [tuple(r) for r in plain.frame(spark).orderBy("name").collect()] == [("ab", "12", "x"), ("cd", "34", "y")]
    assert [r["n"] for r in table(spark).insert_many(FixedWidthReader(spec, text))] == [12, 34] and len(spec) == 4


def test_http(spark):
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def answer(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            seen.append((self.command, self.headers.get("X-Mark"), self.headers.get("Authorization"), body))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"a,b\n1,2\n")

        do_GET = do_POST = answer  # noqa: N815

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/x.csv"
    t = table(spark).csv_import(url, headers={"X-Mark": "m"}, data=b"q=1")
    assert [tuple(r) for r in t] == [("1", "2")] and seen[-1] == ("POST", "m", None, "q=1") and t.import_source_type == "url"
    with pytest.warns(AuthenticationWarning):
        table(spark).csv_import(url, username="u", password="p")  # noqa: S106
    assert seen[-1][2] == "Basic dTpw"
    server.shutdown()


def test_spreadsheets_need_their_library(spark, tmp_path):
    try:
        import openpyxl  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="openpyxl"):
            table(spark).excel_import(str(tmp_path / "x.xlsx"))
        with pytest.raises(RuntimeError, match="openpyxl"):
            table(spark).insert({"a": 1}).excel_export(str(tmp_path / "x.xlsx"))
        return
    table(spark).insert_many([{"a": 1, "b": "x"}, {"a": 2, "b": None}]).excel_export(str(tmp_path / "x.xlsx"))
    assert [tuple(r) for r in table(spark).excel_import(str(tmp_path / "x.xlsx"))] == [(1, "x"), (2, None)]


def test_markdown_html_and_text(spark):
    t = table(spark).insert_many([{"g": "p", "n": 1, "f": "Y"}, {"g": "p", "n": 2, "f": "N"}, {"g": "q", "n": 2, "f": ""}])
    assert t.as_markdown(groupby="g", formats={int: "{:.1f}"}).splitlines() == ["| g | n | f |", "|---|---:|:---:|", "| p | 1.0 | Y |", "|  | 2.0 | N |", "| q | 2.0 |  |"]
    page = t.as_html("n g", formats={"g": str.upper}, table_properties={"border": 1})
    assert page.startswith('<table border="1">') and page.count("<tr>") == 4 and '<td><div align="right">1</div></td><td><div align="left">P</div></td>' in page
    out = io.StringIO()
    t.present("g n", file=out, groupby="g")
    assert out.getvalue().splitlines() == ["+---+---+", "| G | N |", "+---+---+", "| p | 1 |", "|   | 2 |", "| q | 2 |", "+---+---+"]


def test_streams_take_the_same_filters(spark, tmp_path):
    from pyspark.sql import functions as F

    from weftframe import streaming

    data = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", i % 2) for i in range(30)], "id bigint, t string, k int").withColumn("t", F.col("t").cast("timestamp"))
    data.write.parquet(f"{tmp_path}/in")
    t = streaming.follow(spark, f"{tmp_path}/in", data.schema).where(k=1)
    q = streaming.write(t.select("id k").frame, f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 15
    sums = streaming.summarized(t, "t", "1 minute", "10 minutes", ["k"], n=F.count("*"))
    q = streaming.write(sums, f"{tmp_path}/sums", f"{tmp_path}/ck2")
    q.awaitTermination(120)
    assert {r["n"] for r in spark.read.parquet(f"{tmp_path}/sums").collect()} <= {5}


def test_rows_of_other_lengths_in_files_and_texts(spark, tmp_path):
    long, short = "a,b,c\nx,xx,1\ny,\"y,y\",2,3\n", "a,b,c\nx,xx,1\ny,\nz,,\n"
    (tmp_path / "long.csv").write_text(long)
    (tmp_path / "short.csv").write_text(short)
    for source in (long, str(tmp_path / "long.csv")):
        with pytest.raises(Exception, match="column names in header"):
            Table(spark=spark).csv_import(source).select("a").frame.collect()
    with pytest.raises(Exception, match="column names in header"):
        len(Table(spark=spark).csv_import(str(tmp_path / "long.csv")))
    for source in (short, str(tmp_path / "short.csv")):
        t = Table(spark=spark).csv_import(source)
        assert [tuple(r) for r in t.frame.collect()] == [("x", "xx", "1"), ("y", "", None), ("z", "", "")]
        assert len(t) == 3


def test_star_transforms_take_one_pass_and_types_of_all_rows(spark):
    text = "a,b,c\n" + "".join(f"{i},{i}.5,{'x' if i == 60 else i}\n" for i in range(80))
    t = Table(spark=spark).csv_import(text, transforms={"*": float})
    assert dict(t.frame.dtypes) == {"a": "double", "b": "double", "c": "string"}
    t = Table(spark=spark).csv_import(text, transforms={"a": lambda s: int(s) if int(s) < 50 else int(s) / 4})
    assert {r["a"] for r in t.frame.collect() if r["b"] in ("3.5", "79.5")} == {3.0, 19.75}
