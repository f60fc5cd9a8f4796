"""Queries over the driver's tables, one or more for each kind of operation, and the same in SQL."""

from __future__ import annotations

import datetime as dt
import gzip
import http.server
import importlib.util
import io
import json
import lzma
import re
import tarfile
import threading
import warnings
import zipfile
from collections import Counter
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import streaming
from .errors import AuthenticationWarning
from .functions.words import plain_word
from .operators.fields import attrgetter
from .plans.scratch import scratch_path
from .sources.read import FixedWidthReader
from .table import Table, csv_import

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

MONEY = "decimal(18,2)"  # sums of doubles would depend on their order


def query(sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> Table:
    return Table(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"))


@query("""SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 10 GROUP BY c_mktsegment""")
def flagship(spark, d):
    """Joins, a filter, a grouped summary, a sort."""
    lines = table(spark, d, "lineitem").where(l_quantity=Table.gt(10))
    joined = table(spark, d, "customer").join(table(spark, d, "orders"), c_custkey="o_custkey").join(lines, o_orderkey="l_orderkey")
    revenue = F.sum(F.col("l_extendedprice").cast(MONEY) * (1 - F.col("l_discount").cast(MONEY))).cast("double")
    return joined.groupby_with_summaries("c_mktsegment", n=len, revenue=revenue).orderby("revenue desc").sorted_frame


def _where(name: str, source: str, columns: str, condition: str, **tests) -> None:
    def run(spark, d):
        return table(spark, d, source).where(**tests).select(columns).frame

    run.__name__ = name
    query(f"SELECT {', '.join(columns.split())} FROM {source} WHERE {condition}")(run)


_where("where_eq", "orders", "o_orderkey o_orderstatus", "o_orderstatus = 'F'", o_orderstatus="F")
_where("where_lt", "lineitem", "l_orderkey l_linenumber l_quantity", "l_quantity < 10", l_quantity=Table.lt(10))
_where("where_le", "lineitem", "l_orderkey l_linenumber l_quantity", "l_quantity <= 10", l_quantity=Table.le(10))
_where("where_gt", "lineitem", "l_orderkey l_linenumber l_quantity", "l_quantity > 40", l_quantity=Table.gt(40))
_where("where_ge", "lineitem", "l_orderkey l_linenumber l_quantity", "l_quantity >= 40", l_quantity=Table.ge(40))
_where("where_between", "lineitem", "l_orderkey l_linenumber l_quantity", "l_quantity > 10 AND l_quantity < 20", l_quantity=Table.between(10, 20))
_where("where_within", "lineitem", "l_orderkey l_linenumber l_quantity", "l_quantity BETWEEN 10 AND 20", l_quantity=Table.within(10, 20))
_where("where_in_range", "lineitem", "l_orderkey l_linenumber l_quantity", "l_quantity >= 10 AND l_quantity < 20", l_quantity=Table.in_range(10, 20))
_where("where_is_in", "customer", "c_custkey c_mktsegment", "c_mktsegment IN ('BUILDING', 'MACHINERY')", c_mktsegment=Table.is_in(["BUILDING", "MACHINERY"]))
_where("where_startswith", "part", "p_partkey p_name", "starts_with(p_name, 'red')", p_name=Table.startswith("red"))
_where("where_endswith", "part", "p_partkey p_name", "p_name LIKE '%bolt'", p_name=Table.endswith("bolt"))
_where("where_startswith_number", "orders", "o_orderkey", "starts_with(CAST(o_orderkey AS VARCHAR), '12')", o_orderkey=Table.startswith("12"))
_where("where_regex", "part", "p_partkey p_brand", "regexp_matches(p_brand, '[13]$')", p_brand=re.compile("[13]$").search)
_where("where_two_fields", "lineitem", "l_orderkey l_linenumber l_tax", "l_returnflag = 'R' AND l_tax >= 0.05", l_returnflag="R", l_tax=Table.ge(0.05))


@query("SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type END AS t FROM events WHERE NOT (event_type = 'click')")
def where_ne_keeps_nulls(spark, d):
    t = table(spark, d, "events").select("event_id", t=F.nullif("event_type", F.lit("view")))
    return t.where(t=Table.ne("click")).frame


@query("SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type END AS t FROM events WHERE event_type NOT IN ('click', 'purchase')")
def where_not_in_keeps_nulls(spark, d):
    t = table(spark, d, "events").select("event_id", t=F.nullif("event_type", F.lit("view")))
    return t.where(t=Table.not_in(["click", "purchase"])).frame


@query("""WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN '' ELSE event_type END AS t FROM events)
SELECT 'is_none' AS test, count(*) AS n FROM e WHERE t IS NULL UNION ALL SELECT 'is_not_none', count(*) FROM e WHERE t IS NOT NULL
UNION ALL SELECT 'is_null', count(*) FROM e WHERE t IS NULL OR t = '' UNION ALL SELECT 'is_not_null', count(*) FROM e WHERE t <> ''""")
def where_nulls(spark, d):
    t = F.col("event_type")
    base = table(spark, d, "events").select("event_id", t=F.when(t == "view", None).when(t == "click", "").otherwise(t))
    tests = {"is_none": Table.is_none(), "is_not_none": Table.is_not_none(), "is_null": Table.is_null(), "is_not_null": Table.is_not_null()}
    counts = base.frame.agg(*[F.count_if(p.to_column(F.col("t"))).alias(n) for n, p in tests.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in tests]), F.array(*tests))).alias("test", "n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 * o_custkey % 100000 OR o_orderstatus = 'P'")
def where_row_function(spark, d):
    return table(spark, d, "orders").where(lambda r: (r.o_totalprice > 1000 * r.o_custkey % 100000) | (r.o_orderstatus == "P")).select("o_orderkey o_totalprice").frame


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-07-01'")
def index_range(spark, d):
    t = table(spark, d, "orders").create_index("o_orderdate")
    return t.by.o_orderdate[dt.datetime(1995, 1, 1) : dt.datetime(1996, 7, 1)].select("o_orderkey o_orderdate").frame


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING'")
def index_chained(spark, d):
    t = table(spark, d, "customer").create_index("c_nationkey").create_index("c_mktsegment")
    return t.by.c_nationkey[7].by.c_mktsegment["BUILDING"].select("c_custkey c_name").frame


@query("SELECT DISTINCT p_brand FROM part")
def index_keys(spark, d):
    return table(spark, d, "part").create_index("p_brand").by.p_brand.key_frame()


@query("SELECT CAST(o_totalprice > 150000 AS BOOLEAN) AS side, count(*) AS n FROM orders GROUP BY 1")
def splitby_counts(spark, d):
    no, yes = table(spark, d, "orders").splitby(lambda r: r.o_totalprice > 150000)
    side = lambda t, v: t.frame.groupBy().agg(F.count("*").alias("n")).select(F.lit(v).alias("side"), "n")
    return side(no, False).union(side(yes, True))


@query("SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS gross, l_returnflag || '/' || l_linestatus AS flags FROM lineitem")
def select_exprs(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey l_linenumber", gross=lambda r: r.l_quantity * r.l_extendedprice, flags="{l_returnflag}/{0.l_linestatus}").frame


@query("SELECT n_nationkey, n_name FROM nation")
def select_all_but(spark, d):
    return table(spark, d, "nation").select("* -n_regionkey").frame


@query("SELECT s_suppkey, s_acctbal, CASE WHEN s_acctbal < 0 THEN 'owes' ELSE 'owed' END AS state FROM supplier")
def compute_field(spark, d):
    t = table(spark, d, "supplier").compute_field("state", lambda r: F.when(r.s_acctbal < 0, "owes").otherwise("owed"))
    return t.select("s_suppkey s_acctbal state").frame


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.' || 'k') AS DOUBLE) AS k, CAST(ts AS DATE) AS day FROM events")
def convert_fields(spark, d):
    t = table(spark, d, "events").compute_field("k", Table.convert_numeric(F.get_json_object("props", "$.k"))).compute_field("text", F.date_format("ts", "dd/MM/yyyy"))
    return t.compute_field("day", Table.parse_date("%d/%m/%Y")(F.col("text"))).select("event_id k day").frame


@query("SELECT c_custkey, c_name, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_inner(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, ["c_custkey", "c_name", (n, "n_name", "nation")], c_nationkey="n_nationkey").frame


@query("SELECT l1.l_orderkey, l1.l_linenumber, l1.l_quantity AS q, l2.l_quantity AS q2 FROM lineitem l1 JOIN lineitem l2 ON l1.l_orderkey = l2.l_orderkey AND l1.l_linenumber = l2.l_linenumber WHERE l2.l_returnflag = 'R'")
def join_two_keys(spark, d):
    a, b = table(spark, d, "lineitem"), table(spark, d, "lineitem").where(l_returnflag="R")
    return a.join(b, ["l_orderkey", "l_linenumber", (a, "l_quantity", "q"), (b, "l_quantity", "q2")], l_orderkey="l_orderkey", l_linenumber="l_linenumber").frame


def _open_orders(spark, d) -> Table:
    return table(spark, d, "orders").where(o_orderstatus="P", o_totalprice=Table.gt(200000))


@query("SELECT c_custkey, coalesce(o_custkey, c_custkey) AS o_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000) ON c_custkey = o_custkey")
def join_keep_self(spark, d):
    return table(spark, d, "customer").outer_join(Table.RIGHT_OUTER_JOIN, _open_orders(spark, d), "c_custkey o_custkey o_orderkey", c_custkey="o_custkey").frame


@query("SELECT coalesce(c_custkey, o_custkey) AS c_custkey, o_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) RIGHT JOIN orders ON c_custkey = o_custkey")
def join_keep_other(spark, d):
    rich = table(spark, d, "customer").where(c_acctbal=Table.gt(5000))
    return rich.outer_join(Table.LEFT_OUTER_JOIN, table(spark, d, "orders"), "c_custkey o_custkey o_orderkey", c_custkey="o_custkey").frame


@query("SELECT coalesce(c_custkey, o_custkey) AS c_custkey, coalesce(c_custkey, o_custkey) AS o_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) FULL JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000) ON c_custkey = o_custkey")
def join_full(spark, d):
    rich = table(spark, d, "customer").where(c_acctbal=Table.gt(5000))
    return rich.outer_join(Table.FULL_OUTER_JOIN, _open_orders(spark, d), "c_custkey o_custkey o_orderkey", c_custkey="o_custkey").frame


@query("""WITH a AS (SELECT n_nationkey AS x, n_regionkey AS y, n_name FROM nation), b AS (SELECT s_nationkey AS x, CAST(s_suppkey % 5 AS INTEGER) AS y, s_suppkey FROM supplier),
u AS (SELECT x FROM a UNION SELECT x FROM b), v AS (SELECT y FROM a UNION SELECT y FROM b)
SELECT u.x, v.y, n_name, s_suppkey FROM u CROSS JOIN v LEFT JOIN a ON a.x = u.x AND a.y = v.y LEFT JOIN b ON b.x = u.x AND b.y = v.y""")
def join_full_two_keys(spark, d):
    a = table(spark, d, "nation").select("n_name", x=F.col("n_nationkey"), y=F.col("n_regionkey"))
    b = table(spark, d, "supplier").select("s_suppkey", x=F.col("s_nationkey"), y=(F.col("s_suppkey") % 5).cast("int"))
    return a.outer_join(Table.FULL_OUTER_JOIN, b, "x y n_name s_suppkey", x="x", y="y").frame


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 200000)")
def join_anti(spark, d):
    return table(spark, d, "customer").anti_join(_open_orders(spark, d), c_custkey="o_custkey").select("c_custkey c_name").frame


@query("SELECT r_name, n_name, c_custkey FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey")
def join_terms(spark, d):
    r, n, c = (table(spark, d, x) for x in ("region", "nation", "customer"))
    r.create_index("r_regionkey")
    n.create_index("n_regionkey").create_index("n_nationkey")
    c.create_index("c_nationkey")
    both = (r.join_on("r_regionkey") + n.join_on("n_regionkey")).join_on("n_nationkey")
    return (both + c.join_on("c_nationkey"))(["r_name", "n_name", "c_custkey"]).frame


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, max(l_extendedprice) AS top FROM lineitem GROUP BY ALL")
def groupby_summary(spark, d):
    t = table(spark, d, "lineitem")
    return t.groupby_with_summaries("l_returnflag l_linestatus", n=len, quantity=F.sum(F.col("l_quantity").cast("bigint")), top=(max, "l_extendedprice")).frame


@query("SELECT CAST(floor(p_size / 10) AS BIGINT) AS band, count(*) AS n, min(p_retailprice) AS low FROM part GROUP BY 1")
def groupby_derived_key(spark, d):
    return table(spark, d, "part").groupby_with_summaries(("band", lambda r: F.floor(r.p_size / 10)), n=len, low=(min, "p_retailprice")).frame


@query("SELECT c_mktsegment, CAST(max(c_nationkey) - min(c_nationkey) AS BIGINT) AS reach FROM customer GROUP BY 1")
def groupby_python(spark, d):
    reach = lambda rows: max(r.c_nationkey for r in rows) - min(r.c_nationkey for r in rows)
    return table(spark, d, "customer").select("c_mktsegment c_nationkey").groupby_with_summaries("c_mktsegment", {"reach": "bigint"}, reach=reach).frame


_RUNS_SQL = """WITH a AS (SELECT *, lag(event_type) OVER w IS DISTINCT FROM event_type AS fresh FROM events WINDOW w AS ({over} ORDER BY ts, event_id)),
b AS (SELECT *, sum(CAST(fresh AS INT)) OVER ({over} ORDER BY ts, event_id) AS run FROM a)
SELECT {key} event_type, count(*) AS n, min(event_id) AS first_id FROM b GROUP BY {key} event_type, run"""


@query(_RUNS_SQL.format(over="", key=""))
def groupby_runs(spark, d):
    """Runs over all rows."""
    t = table(spark, d, "events").orderby("ts,event_id").run_ids("event_type")
    return t.frame.groupBy("run", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).drop("run")


@query(_RUNS_SQL.format(over="PARTITION BY user_id", key="user_id,"))
def groupby_runs_by_user(spark, d):
    t = table(spark, d, "events").orderby("ts,event_id").run_ids("event_type", partition=["user_id"])
    return t.frame.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).drop("run")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def unique_first(spark, d):
    return table(spark, d, "events").orderby("ts,event_id").unique("user_id").select("user_id event_id event_type").frame


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def unique_rows(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag l_linestatus l_linenumber").frame.distinct()


_STATS = ", ".join(f"{f} AS {n}" for f, n in (("round(avg(x), 6)", "mean"), ("median(x)", "median"), ("min(x)", "min"), ("max(x)", "max"), ("round(var_samp(x), 4)", "variance"), ("round(stddev_samp(x), 6)", "std_dev"), ("count(x)", "count"), ("count(*) - count(x)", "missing")))


@query(f"SELECT 'p_size' AS name, {_STATS} FROM (SELECT CAST(p_size AS DOUBLE) AS x FROM part) UNION ALL SELECT 'p_retailprice', {_STATS} FROM (SELECT p_retailprice AS x FROM part)")
def stats_by_field(spark, d):
    out = table(spark, d, "part").stats("p_size p_retailprice", rounded=False).frame
    return out.withColumns({"mean": F.round("mean", 6), "variance": F.round("variance", 4), "std_dev": F.round("std_dev", 6)})


@query("""WITH s AS (SELECT avg(l_quantity) AS mean, median(l_quantity) AS median, min(l_quantity) AS min, max(l_quantity) AS max, var_samp(l_quantity) AS variance, stddev_samp(l_quantity) AS std_dev,
CAST(count(l_quantity) AS DOUBLE) AS count, CAST(0 AS DOUBLE) AS missing FROM lineitem)
SELECT stat, round(l_quantity, 4) AS l_quantity FROM (UNPIVOT s ON mean, median, min, max, variance, std_dev, count, missing INTO NAME stat VALUE l_quantity)""")
def stats_transposed(spark, d):
    return table(spark, d, "lineitem").stats("l_quantity", by_field=False, rounded=False).frame.withColumn("l_quantity", F.round("l_quantity", 4))


@query("SELECT l_returnflag, count(*) AS Count FROM lineitem GROUP BY 1")
def pivot_one(spark, d):
    return table(spark, d, "lineitem").create_index("l_returnflag").pivot("l_returnflag").as_table().frame


@query("""SELECT a.o_orderstatus, b.o_orderpriority, coalesce(n, 0) AS "Count" FROM (SELECT DISTINCT o_orderstatus FROM orders) a CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) b
LEFT JOIN (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) USING (o_orderstatus, o_orderpriority)""")
def pivot_two_dense(spark, d):
    t = table(spark, d, "orders").create_index("o_orderstatus").create_index("o_orderpriority")
    return t.pivot("o_orderstatus o_orderpriority").as_table().frame


@query("""SELECT a.l_suppkey, b.l_shipmode, coalesce(n, 0) AS "Count" FROM (SELECT DISTINCT l_suppkey FROM lineitem) a CROSS JOIN (SELECT DISTINCT l_returnflag || l_linestatus || l_linenumber AS l_shipmode FROM lineitem) b
LEFT JOIN (SELECT l_suppkey, l_returnflag || l_linestatus || l_linenumber AS l_shipmode, count(*) AS n FROM lineitem GROUP BY ALL) USING (l_suppkey, l_shipmode)""")
def pivot_with_empty_cells(spark, d):
    t = table(spark, d, "lineitem").compute_field("l_shipmode", F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")))
    return t.create_index("l_suppkey").create_index("l_shipmode").pivot("l_suppkey l_shipmode").as_table().frame


@query("""SELECT a.l_returnflag, b.l_linestatus, c.l_linenumber, coalesce(q, 0) AS quantity FROM (SELECT DISTINCT l_returnflag FROM lineitem) a CROSS JOIN (SELECT DISTINCT l_linestatus FROM lineitem) b
JOIN (SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem) c USING (l_returnflag)
LEFT JOIN (SELECT l_returnflag, l_linestatus, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) USING (l_returnflag, l_linestatus, l_linenumber)""")
def pivot_three(spark, d):
    t = table(spark, d, "lineitem")
    for f in ("l_returnflag", "l_linestatus", "l_linenumber"):
        t.create_index(f)
    return t.pivot("l_returnflag l_linestatus l_linenumber").as_table(sum, "l_quantity", "quantity").frame


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def rank_rows(spark, d):
    return table(spark, d, "orders").orderby("o_totalprice desc,o_orderkey").rank().select("o_orderkey rank").frame


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk(spark, d):
    return table(spark, d, "orders").orderby("o_totalprice desc,o_orderkey")[:20].select("o_orderkey o_totalprice").frame


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 7")
def tail_rows(spark, d):
    return table(spark, d, "customer").orderby("c_acctbal,c_custkey").tail(7).select("c_custkey c_acctbal").frame


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) WHERE k >= 100 AND k < 5000 AND (k - 100) % 7 = 0")
def slice_step(spark, d):
    return table(spark, d, "orders").orderby("o_orderkey")[100:5000:7].select("o_orderkey").frame


@query("SELECT CAST(floor((row_number() OVER (ORDER BY c_custkey) - 1) / 100) AS BIGINT) AS batch, c_custkey FROM customer")
def batched_rows(spark, d):
    return table(spark, d, "customer").orderby("c_custkey").batch_ids(100).select("batch c_custkey").frame


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey LIMIT 50")
def orderby_mixed(spark, d):
    return table(spark, d, "orders").orderby("o_orderstatus desc, o_totalprice, o_orderkey").head(50).select("o_orderkey o_orderstatus o_totalprice").frame


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, d):
    return (table(spark, d, "customer").select(k=F.col("c_nationkey")) + table(spark, d, "supplier").select(k=F.col("s_nationkey"))).frame


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return (table(spark, d, "customer").select(k=F.col("c_nationkey")) + table(spark, d, "supplier").select(k=F.col("s_nationkey"))).unique().frame


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def remove_rows(spark, d):
    return table(spark, d, "customer").select(k=F.col("c_nationkey")).remove_many(table(spark, d, "supplier").select(k=F.col("s_nationkey"))).frame


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'click' OR value <= 50")
def delete_rows(spark, d):
    t = table(spark, d, "events")
    t.delete(event_type="click", value=Table.gt(50))
    return t.select("event_id event_type").frame


@query("SELECT event_id, user_id, NULL::VARCHAR AS note FROM events UNION ALL SELECT -1, 7, 'new'")
def insert_rows(spark, d):
    return table(spark, d, "events").select("event_id user_id").insert({"event_id": -1, "user_id": 7, "note": "new"}).frame


_SEARCH_SQL = """WITH t AS (SELECT doc_id, list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM documents)
SELECT doc_id, {score} AS text_search_score FROM t WHERE {where}"""


def _search(name: str, text: str, sql: str | None = None, **options) -> None:
    def run(spark, d):
        t = table(spark, d, "documents").select("doc_id", text=F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
        found = t.create_search_index("text", stopwords=()).search.text(text, **options)
        return found.select("doc_id text_search_score").frame

    run.__name__ = name
    query(sql)(run)


_HAS = "CAST(list_contains(w, '{0}') AS BIGINT)".format
_search("search_plain", "idiot clown", _SEARCH_SQL.format(score=f"100 * {_HAS('idiot')} + 100 * {_HAS('clown')}", where="list_has_any(w, ['idiot', 'clown'])"))
_search("search_signed", "+idiot -clown thing", _SEARCH_SQL.format(score=f"1000 * {_HAS('idiot')} - 1000 * {_HAS('clown')} + 100 * {_HAS('thing')}", where="list_has_any(w, ['idiot', 'clown', 'thing'])"), min_score=-10000)
_search("search_required", "++idiot thing", _SEARCH_SQL.format(score=f"1000 * {_HAS('idiot')} + 100 * {_HAS('thing')}", where="list_contains(w, 'idiot')"))
_search("search_excluded", "thing --idiot", _SEARCH_SQL.format(score="CAST(100 AS BIGINT)", where="list_contains(w, 'thing') AND NOT list_contains(w, 'idiot')"))


def _file(spark, t: Table, kind: str, **options) -> str:
    """t written by the tasks as a folder that all executors share."""
    path = scratch_path(spark, kind)
    t.folder_export(path, kind, **options)
    return path


def _local(spark, name: str) -> Path:
    """A file of the driver's, for what isn't read by tasks."""
    folder = scratch_path(spark, "files").removeprefix("file:")
    Path(folder).mkdir(parents=True)
    return Path(folder, name)


_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
_TYPES = {"c_custkey": lambda c: c.cast("bigint"), "c_nationkey": lambda c: c.cast("int"), "c_acctbal": float}
_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
_NATION_TYPES = {"n_nationkey": lambda c: c.cast("int"), "n_regionkey": lambda c: c.cast("int")}


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_round_trip(spark, d):
    path = _file(spark, table(spark, d, "orders").select("* -o_orderdate"), "csv")
    whole = lambda c: c.cast("bigint")
    return Table(spark=spark).csv_import(path, transforms={"o_orderkey": whole, "o_custkey": whole, "o_totalprice": float}).frame


@query(_CUSTOMER)
def tsv_round_trip(spark, d):
    return Table(spark=spark).tsv_import(_file(spark, table(spark, d, "customer"), "tsv"), transforms=_TYPES).frame


@query("SELECT c_custkey AS \"c custkey\", c_name FROM customer")
def csv_fieldnames(spark, d):
    """A text without a header; names with blanks, from a list."""
    path = scratch_path(spark, "csv")
    table(spark, d, "customer").select("c_custkey c_name").frame.write.option("header", False).csv(path)
    return Table(spark=spark).csv_import(path, fieldnames=["c custkey", "c_name"], transforms={"c custkey": lambda c: c.cast("bigint")}).frame


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def import_filters(spark, d):
    """Filters come after the transforms."""
    path = _file(spark, table(spark, d, "orders").select("o_orderkey o_totalprice o_orderstatus"), "csv")
    t = Table(spark=spark).csv_import(path, transforms={"o_orderkey": lambda c: c.cast("bigint"), "o_totalprice": float}, filters={"o_orderstatus": "F", "o_totalprice": Table.gt(100000)})
    return t.select("o_orderkey o_totalprice").frame


@query("SELECT CAST(s_suppkey AS DOUBLE) AS s_suppkey, s_name, CAST(s_nationkey AS DOUBLE) AS s_nationkey, 'x' AS s_acctbal FROM supplier")
def import_star_transform(spark, d):
    """All columns that convert as a whole do, but for one with a transform of its own."""
    return Table(spark=spark).csv_import(_file(spark, table(spark, d, "supplier"), "csv"), transforms={"*": float, "s_acctbal": "x"}).frame


@query("SELECT s_suppkey, coalesce(TRY_CAST(s_name AS DOUBLE), -1) AS s_name FROM supplier")
def import_transform_default(spark, d):
    path = _file(spark, table(spark, d, "supplier").select("s_suppkey s_name"), "csv")
    return Table(spark=spark).csv_import(path, transforms={"s_suppkey": lambda c: c.cast("bigint"), "s_name": (float, -1.0)}).frame


@query(f"{_NATION} WHERE n_regionkey = 1 ORDER BY n_nationkey LIMIT 3")
def import_limit(spark, d):
    """The limit comes after the filters."""
    text = table(spark, d, "nation").orderby("n_nationkey").csv_export()
    return Table(spark=spark).csv_import(text, transforms=_NATION_TYPES, filters={"n_regionkey": 1}, limit=3).frame


@query("SELECT o_orderkey, 'odd' AS kind FROM orders WHERE o_custkey % 2 = 1 UNION ALL SELECT o_orderkey, 'even' FROM orders WHERE o_custkey % 2 = 0")
def import_python_transform(spark, d):
    """A transform that only Python can do."""
    path = _file(spark, table(spark, d, "orders").select("o_orderkey", kind=F.col("o_custkey")), "csv")
    return Table(spark=spark).csv_import(path, transforms={"o_orderkey": lambda c: c.cast("bigint"), "kind": lambda v: {0: "even", 1: "odd"}[int(v) % 2]}).frame


@query(_NATION)
def import_module_function(spark, d):
    text = table(spark, d, "nation").csv_export()
    return csv_import(text, transforms=_NATION_TYPES, row_class=dict).frame


@query(f"{_NATION} UNION ALL {_NATION}")
def import_accumulates(spark, d):
    """A second import adds to the first; from lines, then from a path."""
    text = table(spark, d, "nation").csv_export()
    path = _local(spark, "nation.csv")
    path.write_text(text)
    return Table(spark=spark).csv_import(text.splitlines(), transforms=_NATION_TYPES).csv_import(path, transforms=_NATION_TYPES).frame


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, n_nationkey, n_name FROM nation" for k in ("gz", "xz", "zip", "tar.gz")))
def import_archives(spark, d):
    data = table(spark, d, "nation").select("n_nationkey n_name").csv_export().encode()
    out = None
    for kind in ("gz", "xz", "zip", "tar.gz"):
        path = _local(spark, f"nation.csv.{kind}")
        if kind in ("gz", "xz"):
            path.write_bytes((gzip if kind == "gz" else lzma).compress(data))
        elif kind == "zip":
            with zipfile.ZipFile(path, "w") as z:
                z.writestr("nation.csv", data)
        else:
            with tarfile.open(path, "w:gz") as t:
                entry = tarfile.TarInfo("nation.csv")
                entry.size = len(data)
                t.addfile(entry, io.BytesIO(data))
        part = Table(spark=spark).csv_import(str(path), transforms={"n_nationkey": lambda c: c.cast("int")}).select("n_nationkey n_name", kind=F.lit(kind)).frame.select("kind", "n_nationkey", "n_name")
        out = part if out is None else out.union(part)
    return out


@query("SELECT r_regionkey, r_name FROM region")
def import_from_the_web(spark, d):
    """Served by this process for as long as it takes."""
    text = table(spark, d, "region").csv_export().encode()

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.send_response(200)
            self.end_headers()
            self.wfile.write(text)

        def log_message(self, *args):
            pass

    with http.server.HTTPServer(("127.0.0.1", 0), Answer) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        t = Table(spark=spark).csv_import(f"http://127.0.0.1:{server.server_port}/region.csv", transforms={"r_regionkey": lambda c: c.cast("int")})
        server.shutdown()
    return t.frame


@query("SELECT 'AuthenticationWarning' AS warning, 'URLError' AS error")
def credentials_over_plain_http(spark, d):
    """A warning comes before the request, which nothing answers here."""
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        try:
            Table(spark=spark).csv_import("http://127.0.0.1:9/none.csv", username="u", password="p", timeout=2)
            error = "none"
        except OSError as e:
            error = type(e).__name__
    names = [w.category.__name__ for w in said if w.category is AuthenticationWarning]
    return spark.createDataFrame([(" ".join(names), error)], "warning string, error string")


@query(_CUSTOMER)
def fixed_width(spark, d):
    path = scratch_path(spark, "fixed")
    pad = lambda c, n: F.rpad(F.col(c).cast("string"), n, " ")
    line = F.concat(pad("c_custkey", 12), pad("c_name", 24), pad("c_nationkey", 4), pad("c_acctbal", 14), F.lit("gap "), F.col("c_mktsegment"))
    table(spark, d, "customer").frame.select(line.alias("value")).write.text(path)
    spec = [("C_CUSTKEY", 0, None, Table.convert_numeric()), ("c_name", 12), ("c_nationkey", 36), ("c_acctbal", 40, 54), (None, 54), ("c_mktsegment", 58)]
    df = FixedWidthReader(spec, path).frame(spark)
    return df.withColumns({"c_custkey": F.col("c_custkey").cast("bigint"), "c_nationkey": F.col("c_nationkey").cast("int"), "c_acctbal": F.col("c_acctbal").cast("double")})


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_array(spark, d):
    t = Table(spark=spark).json_import(table(spark, d, "nation").json_export())
    return t.frame.select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int"))


@query("SELECT r_regionkey, r_name FROM region")
def json_under_a_path(spark, d):
    rows = table(spark, d, "region").json_export()
    t = Table(spark=spark).json_import('{"data": {"regions": ' + rows + "}}", path="data.regions")
    return t.frame.select(F.col("r_regionkey").cast("int"), "r_name")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def json_round_trip(spark, d):
    path = _file(spark, table(spark, d, "orders").select("* -o_orderdate"), "json")
    return Table(spark=spark).json_import(path, streaming=True).frame


@query("SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS n FROM orders GROUP BY 1")
def json_encoders(spark, d):
    """A type that JSON lacks, by an encoder."""

    class Dates(json.JSONEncoder):
        def default(self, o):
            return o.isoformat() if isinstance(o, dt.date) else super().default(o)

    days = table(spark, d, "orders").select(day=F.col("o_orderdate").cast("date")).groupby_with_summaries("day", n=len)
    return Table(spark=spark).json_import(days.json_export(streaming=True, json_encoder=Dates), streaming=True).frame


@query(_CUSTOMER)
def parquet_round_trip(spark, d):
    return Table(spark=spark).parquet_import(_file(spark, table(spark, d, "customer"), "parquet")).frame


@query("SELECT r_name AS name, count(*) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def as_dataframe(spark, d):
    t = table(spark, d, "region").join(table(spark, d, "nation"), r_regionkey="n_regionkey").groupby_with_summaries("r_name", nations=len)
    pdf = t.as_dataframe()
    return spark.createDataFrame(pdf.rename(columns={"r_name": "name"}))


def _lines(spark, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.rstrip("\n").split("\n"))), "line int, text string")


@query("""SELECT 0 AS line, '| r_regionkey | r_name |' AS text UNION ALL SELECT 1, '|---:|---|' UNION ALL SELECT 2 + row_number() OVER (ORDER BY r_regionkey) - 1, '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region""")
def as_markdown(spark, d):
    return _lines(spark, table(spark, d, "region").orderby("r_regionkey").as_markdown())


@query("""SELECT 0 AS line, '| n_regionkey | n_name |' AS text UNION ALL SELECT 1, '|---:|---|' UNION ALL SELECT CAST(1 + row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS INTEGER),
'| ' || CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) = 1 THEN CAST(n_regionkey AS VARCHAR) ELSE '' END || ' | ' || n_name || ' |' FROM nation""")
def markdown_groups(spark, d):
    """A group's repeated values are left blank."""
    return _lines(spark, table(spark, d, "nation").orderby("n_regionkey,n_nationkey").as_markdown("n_regionkey n_name", groupby="n_regionkey"))


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY r_regionkey) AS k, count(*) OVER () AS n,
'<tr><td><div align="right">' || printf('%03d', r_regionkey) || '</div></td><td><div align="left">' || r_name || '</div></td></tr>' AS t FROM region)
SELECT 0 AS line, '<table border="1">' AS text UNION ALL SELECT 1, '<thead>' UNION ALL SELECT 2, '<tr><th><div align="center">r_regionkey</div></th><th><div align="center">r_name</div></th></tr>' UNION ALL SELECT 3, '</thead>'
UNION ALL SELECT CAST(3 + k AS INTEGER), CASE WHEN k = 1 THEN '<tbody>' ELSE '' END || t FROM r UNION ALL SELECT DISTINCT CAST(4 + n AS INTEGER), '</tbody>' FROM r UNION ALL SELECT DISTINCT CAST(5 + n AS INTEGER), '</table>' FROM r""")
def as_html(spark, d):
    return _lines(spark, table(spark, d, "region").orderby("r_regionkey").as_html(formats={"r_regionkey": "{:03d}"}, table_properties={"border": 1}))


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY r_regionkey) AS k, count(*) OVER () AS n, '| ' || lpad(CAST(r_regionkey AS VARCHAR), 11, ' ') || ' | ' || rpad(r_name, 11, ' ') || ' |' AS t FROM (SELECT r_regionkey, r_name FROM region UNION ALL SELECT 9, 'ELEVENCHARS')),
bar AS (SELECT '+-------------+-------------+' AS b)
SELECT 0 AS line, '            region' AS text UNION ALL SELECT 1, b FROM bar UNION ALL SELECT 2, '| R Regionkey | R Name      |' UNION ALL SELECT 3, b FROM bar UNION ALL SELECT CAST(3 + k AS INTEGER), t FROM r UNION ALL SELECT DISTINCT CAST(4 + n AS INTEGER), b FROM r, bar""")
def present(spark, d):
    out = io.StringIO()
    (table(spark, d, "region") + [{"r_regionkey": 9, "r_name": "ELEVENCHARS"}])("region").orderby("r_regionkey").present(file=out)
    return _lines(spark, out.getvalue())


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS line, n_name || ' in ' || n_regionkey AS text FROM nation")
def format_rows(spark, d):
    return _lines(spark, "\n".join(table(spark, d, "nation").orderby("n_nationkey").format("{n_name} in {n_regionkey}")))


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, coalesce(CASE WHEN event_type <> 'view' THEN event_type END, 'None') AS kind FROM events")
def formatted_table(spark, d):
    return table(spark, d, "events").select("event_id", kind=F.nullif("event_type", F.lit("view"))).formatted_table("event_id kind").frame


@query("SELECT 'orders' AS name, count(*) AS len, 'o_custkey:false,o_orderkey:true' AS indexes, 6 AS fields FROM orders")
def info(spark, d):
    found = table(spark, d, "orders").create_index("o_orderkey", unique=True).create_index("o_custkey").info()
    indexes = ",".join(sorted(f"{k}:{str(v).lower()}" for k, v in found["indexes"]))
    return spark.createDataFrame([(found["name"], found["len"], indexes, len(found["fields"]))], "name string, len bigint, indexes string, fields int")


@query("SELECT count(*) AS rows, false AS any, 0 AS none, 0 AS cleared, 0 AS template FROM orders")
def table_sizes(spark, d):
    t = table(spark, d, "orders")
    return spark.createDataFrame([(len(t), bool(t.clone().clear()), len(Table(spark=spark)), len(t.clone().clear()), len(t.copy_template()))], "rows bigint, any boolean, none int, cleared int, template int")


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders) WHERE NOT (k >= 10 AND k < 5000 AND (k - 10) % 3 = 0) AND k <> 0 AND k <> n - 1")
def delete_positions(spark, d):
    t = table(spark, d, "orders").orderby("o_orderkey")
    del t[10:5000:3]
    t.pop(0)
    t.pop()
    return t.select("o_orderkey o_custkey").frame


@query("SELECT o_orderkey, o_totalprice FROM orders")
def shuffled(spark, d):
    """All rows are still there."""
    return table(spark, d, "orders").select("o_orderkey o_totalprice").shuffle(seed=3).frame


@query("SELECT c_nationkey AS k, 'both' AS name FROM customer UNION ALL SELECT s_nationkey, 'both' FROM supplier")
def union_in_place(spark, d):
    t = table(spark, d, "customer").select(k=F.col("c_nationkey"))
    t += table(spark, d, "supplier").select(k=F.col("s_nationkey"))
    t("both")
    return t.frame.withColumn("name", F.lit(t.table_name))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 7, 'ATLANTIS' UNION ALL SELECT 8, NULL")
def union_with_rows(spark, d):
    return (table(spark, d, "region") + [{"r_regionkey": 7, "r_name": "ATLANTIS"}, {"r_regionkey": 8}]).frame


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders) UNION ALL SELECT -1, NULL, NULL")
def index_unique(spark, d):
    """A unique key gives a row, and an unknown one the default."""
    t = table(spark, d, "orders").select("o_orderkey o_custkey o_totalprice").create_index("o_orderkey", unique=True)
    top = t.frame.agg(F.max("o_orderkey")).first()[0]
    row, none = t.by.o_orderkey[top], t.by.o_orderkey.get(-1, (-1, None, None))
    return spark.createDataFrame([tuple(row), tuple(none)], t.frame.schema)


@query("""SELECT c_mktsegment AS key, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'len', count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'in', 1 UNION ALL SELECT 'not in', 0 UNION ALL SELECT 'values', count(*) FROM customer""")
def index_items(spark, d):
    t = table(spark, d, "customer").create_index("c_mktsegment")
    by = t.by("c_mktsegment")
    rows = [(k, len(v)) for k, v in by.items()]
    rows += [("len", len(by)), ("in", int("BUILDING" in by)), ("not in", int("none" in by)), ("values", sum(len(v) for v in by.values()))]
    return spark.createDataFrame(rows, "key string, n bigint")


@query("SELECT 'c_nationkey' AS before, '' AS after, 'c name' AS odd, min(c_name) AS value FROM customer")
def index_names(spark, d):
    """An index that is dropped, and a name that is no attribute."""
    t = table(spark, d, "customer").create_index("c_nationkey").compute_field("c name", F.col("c_name"))
    before = " ".join(k for k, _ in t.info()["indexes"])
    t.drop_index("c_nationkey")
    after = " ".join(k for k, _ in t.info()["indexes"])
    value = t.orderby("c_name").all("c name")
    return spark.createDataFrame([(before, after, value.name, next(iter(value)))], "before string, after string, odd string, value string")


@query("SELECT event_id FROM events WHERE event_type = 'view' UNION ALL SELECT -event_id FROM events WHERE event_type = 'click'")
def where_eq_none(spark, d):
    """eq(None) and is_none() are the same; eq of a value as well."""
    t = table(spark, d, "events").select("event_id", t=F.nullif("event_type", F.lit("view")))
    return t.where(t=Table.eq(None)).select("event_id").frame.union(t.where(t=Table.eq("click")).select(event_id=-F.col("event_id")).frame)


@query("SELECT o_orderkey FROM orders WHERE substr(o_orderpriority, 1, 1) IN ('1', '5')")
def where_python_value(spark, d):
    """A test of single values that only Python can do."""
    return table(spark, d, "orders").where(o_orderpriority=lambda v: {"1": True, "5": True}.get(v[0], False)).select("o_orderkey").frame


@query("SELECT o_orderkey FROM orders WHERE (o_custkey + length(o_orderstatus)) % 3 = 0")
def where_python_row(spark, d):
    """A test of rows that only Python can do."""
    return table(spark, d, "orders").where(lambda r: (int(r.o_custkey) + len(str(r.o_orderstatus))) % 3 == 0 if not isinstance(r.o_custkey, Column) else None).select("o_orderkey").frame


@query("""SELECT 'field' AS test, CASE WHEN n_regionkey = 0 THEN 0 ELSE 1 END AS side, count(*) AS n FROM nation GROUP BY ALL UNION ALL SELECT 'value', CASE WHEN n_regionkey = 1 THEN 1 ELSE 0 END, count(*) FROM nation GROUP BY ALL
UNION ALL SELECT 'fails', CASE WHEN n_regionkey = 0 THEN 2 WHEN 12 // n_regionkey > 4 THEN 1 ELSE 0 END, count(*) FROM nation GROUP BY ALL UNION ALL SELECT 'true', CASE WHEN n_regionkey = 0 OR 12 // n_regionkey > 4 THEN 1 ELSE 0 END, count(*) FROM nation GROUP BY ALL""")
def splitby_forms(spark, d):
    """By a field's truth, by a value, and with rows that fail returned or counted as true."""
    t = table(spark, d, "nation")
    fails = lambda r: 12 // int(r.n_regionkey) > 4
    sides = {"field": t.splitby("n_regionkey"), "value": t.splitby(n_regionkey=1), "fails": t.splitby(fails, errors="return"), "true": t.splitby(fails, errors={ZeroDivisionError: True})}
    return spark.createDataFrame([(k, i, len(s)) for k, v in sides.items() for i, s in enumerate(v)], "test string, side int, n bigint")


@query("""WITH f AS (SELECT max(o_orderkey) AS k FROM orders) SELECT true AS found, false AS other, (SELECT count(*) - 1 FROM orders) AS place, (SELECT count(*) FROM orders, f WHERE o_orderkey = k) AS times""")
def find_row(spark, d):
    t = table(spark, d, "orders").select("o_orderkey o_custkey").orderby("o_orderkey")
    row = t[-1]
    return spark.createDataFrame([(row in t, {"o_orderkey": -5, "o_custkey": 1} in t, t.index(row), t.count(row))], "found boolean, other boolean, place bigint, times bigint")


@query("SELECT o_orderpriority FROM (SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1")
def values_unique(spark, d):
    return table(spark, d, "orders").orderby("o_orderkey").all.o_orderpriority.unique.frame()


@query("SELECT sum(CAST(p_size AS BIGINT)) AS total, min(p_size) AS low, max(p_size) AS high, count(DISTINCT p_type) AS kinds, count(*) AS n FROM part")
def values_aggregates(spark, d):
    """The built-in functions over a column's values, which stream to the driver; groupby_with_summaries() does it in the tasks."""
    t = table(spark, d, "part")
    return spark.createDataFrame([(sum(t.all.p_size), min(t.all.p_size), max(t.all.p_size), len(Counter(t.all.p_type)), len(t))], "total bigint, low int, high int, kinds bigint, n bigint")


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'sum', CAST(sum(o_custkey) AS BIGINT) FROM orders UNION ALL SELECT 'range', max(o_custkey) - min(o_custkey) FROM orders UNION ALL SELECT 'distinct', count(DISTINCT o_custkey) FROM orders")
def values_in_tasks(spark, d):
    """The same without bringing values to the driver."""
    t = table(spark, d, "orders")
    keys = t.all.o_custkey
    rest = [("sum", keys.sum()), ("range", keys.max() - keys.min()), ("distinct", keys.unique.count())]
    return t.all.o_orderpriority.counts().union(spark.createDataFrame(rest, "value string, n bigint"))


class _Nation:
    def __init__(self, n_nationkey: int, n_name: str, n_regionkey: int):
        self.label, self.region = f"{n_name}/{n_nationkey}", n_regionkey


@query("SELECT n_name || '/' || n_nationkey AS label, n_regionkey AS region FROM nation")
def import_row_class(spark, d):
    """Rows as objects of a class of the caller's."""
    text = table(spark, d, "nation").csv_export()
    t = Table(spark=spark).csv_import(text, transforms=_NATION_TYPES, row_class=_Nation)
    return spark.createDataFrame([(r.label, r.region) for r in t.orderby("n_nationkey")], "label string, region int")


@query("SELECT n_name AS name, n_regionkey AS region, -1 AS missing FROM nation")
def namedtuples(spark, d):
    t = table(spark, d, "nation").select("n_name n_regionkey").orderby("n_name")
    kind, get = t.namedtuple_from_fields("Nation"), attrgetter("n_name", "n_regionkey", "missing", defaults={"missing": -1})
    return spark.createDataFrame([get(kind(*r)) for r in t], "name string, region int, missing int")


@query("SELECT c_custkey, c_acctbal, s.s_suppkey, c_nationkey AS nationkey FROM customer JOIN supplier s ON c_nationkey = s_nationkey")
def join_same_names(spark, d):
    """A name that both sides have is the left side's."""
    c = table(spark, d, "customer").select("c_custkey", c_acctbal=F.col("c_acctbal"), nationkey=F.col("c_nationkey"))
    s = table(spark, d, "supplier").select("s_suppkey", c_acctbal=F.col("s_acctbal"), nationkey=F.col("s_nationkey"))
    return c.join(s, nationkey="nationkey").select("c_custkey c_acctbal s_suppkey nationkey").frame


_ODD = "SELECT CASE WHEN n_regionkey <> 1 THEN n_regionkey END AS k, n_name FROM nation"


@query(f"SELECT 'inner' AS kind, a.k, n_name, r_name FROM ({_ODD}) a JOIN region ON r_regionkey = k UNION ALL SELECT 'left', a.k, n_name, r_name FROM ({_ODD}) a LEFT JOIN region ON r_regionkey = k WHERE a.k IS NOT NULL "
f"UNION ALL SELECT 'full', coalesce(a.k, r_regionkey), n_name, r_name FROM (SELECT * FROM ({_ODD}) WHERE k IS NOT NULL) a FULL JOIN region ON r_regionkey = k")
def join_null_keys(spark, d):
    """Null keys match nothing, and rows with them go."""
    n = table(spark, d, "nation").select("n_name", k=F.nullif("n_regionkey", F.lit(1)))
    r, out = table(spark, d, "region"), None
    for kind in ("inner", "left", "full"):
        made = n.join(r, k="r_regionkey") if kind == "inner" else n.outer_join("", r, how=kind, k="r_regionkey")
        part = made.select("k n_name r_name", kind=F.lit(kind)).frame.select("kind", "k", "n_name", "r_name")
        out = part if out is None else out.union(part)
    return out


@query("SELECT 'inner' AS kind, 0 AS n UNION ALL SELECT 'outer', count(*) FROM customer UNION ALL SELECT 'self', count(*) FROM customer")
def join_edges(spark, d):
    """With an empty side, and an outer join of a table with itself."""
    c, none = table(spark, d, "customer"), table(spark, d, "nation").copy_template()
    sizes = [("inner", len(c.join(none, c_nationkey="n_nationkey"))), ("outer", len(c.outer_join(Table.RIGHT_OUTER_JOIN, none, c_nationkey="n_nationkey"))), ("self", len(c.outer_join(Table.FULL_OUTER_JOIN, c, c_custkey="c_custkey")))]
    return spark.createDataFrame(sizes, "kind string, n bigint")


@query("SELECT '(customer:c_nationkey^nation:n_nationkey)' AS inner_name, '(customer:c_nationkey|nation:n_nationkey)' AS outer_name")
def join_names(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    made = c.join(n, c_nationkey="n_nationkey").table_name, c.outer_join(Table.FULL_OUTER_JOIN, n, c_nationkey="n_nationkey").table_name
    return spark.createDataFrame([made], "inner_name string, outer_name string")


@query("SELECT o_orderstatus AS key, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1")
def groupby_iterated(spark, d):
    """Each group as a table of its own, one job each."""
    groups = table(spark, d, "orders").groupby("o_orderstatus", sort=True)
    return spark.createDataFrame([(k, len(t), t.orderby("o_totalprice desc")[0].o_totalprice) for k, t in groups], "key string, n bigint, top double")


_ROUND = "CASE WHEN abs({0}) > 1 THEN round({0}, CAST(greatest(4 - floor(log10(abs({0}))) - 1, 0) AS INTEGER)) ELSE {0} END".format


@query(f"SELECT 'l_quantity' AS name, {_ROUND('avg(x)')} AS mean, {_ROUND('median(x)')} AS median, min(x) AS min, max(x) AS max, {_ROUND('var_samp(x)')} AS variance, {_ROUND('stddev_samp(x)')} AS std_dev, count(x) AS count, count(*) - count(x) AS missing FROM (SELECT l_quantity AS x FROM lineitem) "
f"UNION ALL SELECT 'l_extendedprice', {_ROUND('avg(x)')}, {_ROUND('median(x)')}, min(x), max(x), {_ROUND('var_samp(x)')}, {_ROUND('stddev_samp(x)')}, count(x), count(*) - count(x) FROM (SELECT l_extendedprice AS x FROM lineitem)")
def stats_rounded(spark, d):
    return table(spark, d, "lineitem").stats("l_quantity l_extendedprice").frame


@query("SELECT 'none' AS name, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS std_dev, 0 AS count, count(*) AS missing FROM region UNION ALL SELECT 'one', 2.0, 2.0, NULL, 1, count(*) - 1 FROM region")
def stats_edges(spark, d):
    """A column of nulls, and one of a single value."""
    t = table(spark, d, "region").select(none=F.lit(None).cast("double"), one=F.when(F.col("r_regionkey") == 2, F.col("r_regionkey")))
    return t.stats().select("name mean median std_dev count missing").frame


_COUNTS = "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL"


@query(f"SELECT 'o_orderstatus:' || s AS path, p AS key, n FROM ({_COUNTS}) UNION ALL SELECT '', s, sum(n)::BIGINT FROM ({_COUNTS}) GROUP BY s")
def pivot_access(spark, d):
    """Groups by key, and the groups in them."""
    pivot = table(spark, d, "orders").create_index("o_orderstatus").create_index("o_orderpriority").pivot("o_orderstatus o_orderpriority")
    rows = [(pivot.pivot_key_str(), k, len(sub)) for k, sub in pivot.items()]
    rows += [(sub.pivot_key_str(), k, len(sub[k])) for _, sub in pivot.items() for k in sub.keys() if sub.has_subtables()]
    return spark.createDataFrame(rows, "path string, key string, n bigint")


@query("""WITH n AS (SELECT r_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation JOIN region ON r_regionkey = n_regionkey),
t AS (SELECT r_regionkey AS a, 0 AS b, 'n_regionkey:' || r_regionkey AS text FROM n WHERE k = 1 UNION ALL SELECT r_regionkey, k, '  ' || n_name FROM n)
SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INTEGER) AS line, text FROM t""")
def pivot_dump(spark, d):
    out = io.StringIO()
    table(spark, d, "nation").orderby("n_nationkey").create_index("n_regionkey").pivot("n_regionkey").dump(out, row_fn=lambda r: r.n_name)
    return _lines(spark, out.getvalue())


_CELL = "lpad(CAST({0} AS VARCHAR), 15, ' ')".format


@query(f"""WITH c AS ({_COUNTS}), p AS (SELECT p, row_number() OVER (ORDER BY p) AS k FROM (SELECT DISTINCT p FROM c)),
r AS (SELECT s, string_agg({_CELL('coalesce(n, 0)')}, ' ' ORDER BY p) AS cells, sum(n) AS n FROM (SELECT DISTINCT s FROM c) CROSS JOIN (SELECT DISTINCT p FROM c) LEFT JOIN c USING (s, p) GROUP BY s)
SELECT 0 AS line, 'Pivot: o_orderstatus,o_orderpriority' AS text UNION ALL SELECT 1, '      ' || string_agg({_CELL('p')}, ' ' ORDER BY p) || ' ' || {_CELL("'Total'")} FROM p
UNION ALL SELECT CAST(1 + row_number() OVER (ORDER BY s) AS INTEGER), rpad(s, 5, ' ') || ' ' || cells || ' ' || {_CELL('CAST(n AS BIGINT)')} FROM r
UNION ALL SELECT CAST(2 + (SELECT count(*) FROM r) AS INTEGER), 'Total ' || (SELECT string_agg({_CELL('n')}, ' ' ORDER BY p) FROM (SELECT p, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY p)) || ' ' || (SELECT {_CELL('CAST(sum(n) AS BIGINT)')} FROM c)""")
def pivot_dump_counts(spark, d):
    """A grid of counts with totals."""
    out = io.StringIO()
    table(spark, d, "orders").create_index("o_orderstatus").create_index("o_orderpriority").pivot("o_orderstatus o_orderpriority").dump_counts(out, colwidth=15)
    return _lines(spark, out.getvalue())


@query("""WITH c AS (SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY r_name) AS k, count(*) OVER () AS m, '<tr><td><div align="left">' || r_name || '</div></td><td><div align="right">' || n || '</div></td></tr>' AS t FROM c)
SELECT 0 AS line, '<table>' AS text UNION ALL SELECT 1, '<thead>' UNION ALL SELECT 2, '<tr><th><div align="center">r_name</div></th><th><div align="center">nations</div></th></tr>' UNION ALL SELECT 3, '</thead>'
UNION ALL SELECT CAST(3 + k AS INTEGER), CASE WHEN k = 1 THEN '<tbody>' ELSE '' END || t FROM r UNION ALL SELECT DISTINCT CAST(4 + m AS INTEGER), '</tbody>' FROM r UNION ALL SELECT DISTINCT CAST(5 + m AS INTEGER), '</table>' FROM r""")
def pivot_summary_html(spark, d):
    t = table(spark, d, "region").join(table(spark, d, "nation"), r_regionkey="n_regionkey").create_index("r_name")
    return _lines(spark, t.pivot("r_name").summarize(col_label="nations").as_html())


@query("SELECT c_mktsegment, c_nationkey, max(c_acctbal) AS max_c_acctbal FROM (SELECT DISTINCT c_mktsegment FROM customer) CROSS JOIN (SELECT DISTINCT c_nationkey FROM customer) LEFT JOIN customer USING (c_mktsegment, c_nationkey) GROUP BY ALL")
def pivot_max(spark, d):
    return table(spark, d, "customer").create_index("c_mktsegment").create_index("c_nationkey").pivot("c_mktsegment c_nationkey").as_table(max, "c_acctbal").frame


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_size DESC, p_name, p_partkey) AS BIGINT) AS place FROM part")
def orderby_forms(spark, d):
    """Pairs and names in a list."""
    return table(spark, d, "part").orderby([("p_size", "desc"), "p_name", ("p_partkey", "asc")]).rank("place").select("p_partkey place").frame


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_size % 7 DESC, p_partkey) - 1 AS BIGINT) AS place FROM part")
def orderby_function(spark, d):
    t = table(spark, d, "part").orderby("p_partkey").orderby(lambda r: r.p_size % 7, reverse=True)
    return t.rank("place", start=0).select("p_partkey place").frame


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY CASE WHEN event_type <> 'view' THEN event_type END ASC NULLS LAST, event_id) AS BIGINT) AS up, CAST(row_number() OVER (ORDER BY CASE WHEN event_type <> 'view' THEN event_type END DESC NULLS FIRST, event_id) AS BIGINT) AS down FROM events")
def orderby_nulls(spark, d):
    """Nulls come last, first where descending."""
    t = table(spark, d, "events").select("event_id", t=F.nullif("event_type", F.lit("view")))
    return t.orderby("t, event_id").rank("up").orderby("t desc, event_id").rank("down").select("event_id up down").frame


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey DESC) - 1 AS INTEGER) AS line, n_name AS text FROM nation")
def reversed_rows(spark, d):
    return _lines(spark, "\n".join(r.n_name for r in reversed(table(spark, d, "nation").orderby("n_nationkey"))))


@query("SELECT CAST((row_number() OVER (ORDER BY n_nationkey) - 1) // 4 AS INTEGER) AS batch, n_name FROM nation")
def batches_iterated(spark, d):
    """Batches as tables, one job each; batch_ids() does it at once."""
    found = [(i, r.n_name) for i, b in enumerate(table(spark, d, "nation").orderby("n_nationkey").batched(4)) for r in b]
    return spark.createDataFrame(found, "batch int, n_name string")


@query("SELECT o_orderkey, o_orderdate AS at, CAST(date_diff('second', date_trunc('day', o_orderdate + INTERVAL (o_custkey % 86400) SECOND), o_orderdate + INTERVAL (o_custkey % 86400) SECOND) AS BIGINT) AS seconds FROM orders")
def parse_times(spark, d):
    """Dates and times of day from text."""
    clock = F.date_format(F.timestamp_seconds(F.col("o_custkey") % 86400), "HH:mm:ss")
    t = table(spark, d, "orders").select("o_orderkey", text=F.date_format("o_orderdate", "MM/dd/yyyy HH.mm"), clock=clock)
    t.compute_field("at", Table.parse_datetime("%m/%d/%Y %H.%M")(F.col("text"))).compute_field("time", Table.parse_timedelta("%H:%M:%S")(F.col("clock")))
    return t.frame.select("o_orderkey", "at", (F.extract(F.lit("HOUR"), "time") * 3600 + F.extract(F.lit("MINUTE"), "time") * 60 + F.extract(F.lit("SECOND"), "time")).cast("bigint").alias("seconds"))


_TOKENS = [
    ("nochange", "nochange"), ("ToLower", "tolower"), ("I.B.M.", "i.b.m. ibm"), ("M.", ""), ("MM.xyz", "mm mm.xyz xyz"), ("Threading.isAlive()", "isalive threading threading.isalive"), ("*xxx-hhh", "hhh xxx xxx-hhh"),
    ("foxes", "fox foxes"), ("churches", "church churches"), ("dress", "dress"), ("toys", "toy toys"), ("babies", "babies baby"), ("addenda", "addenda addendum"), ("rabies", "rabies"), ("laziness", "laziness"), ("physics", "physics"),
    ("Python's", "python"), ("ValueError", "error valueerror"), ("terror", "terror"), ("those", ""), ("can", "can"), ("isn't", ""),
]


@query("SELECT * FROM (VALUES " + ", ".join("('" + w.replace("'", "''") + f"', '{f}')" for w, f in _TOKENS) + ") v(word, forms)")
def tokenizer(spark, d):
    """Word forms as search keeps them, with the default stopwords."""
    t = Table("words", spark.createDataFrame([(w,) for w, _ in _TOKENS], "word string"))
    found = t.create_search_index("word").search.word([f"+{w}" for w, _ in _TOKENS], include_words=True)
    have = found.frame.select("word", F.array_join("word_search_words", " ").alias("forms"))
    return t.frame.join(have, "word", "left").select("word", F.coalesce("forms", F.lit("")).alias("forms"))


_WORDS = [("Hello, world", "hello"), ("U.S.A. today", "usa"), ("...", ""), ("re-entry!", "re-entry"), ("(snake_case)", "snake_case"), ("", "")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{w}')" for t, w in _WORDS) + ") v(text, word)")
def word_normaliser(spark, d):
    """The first word of a text."""
    return spark.createDataFrame([(t, plain_word(t)) for t, _ in _WORDS], "text string, word string")


_NAMES = "SELECT p_partkey, string_split(p_name, ' ') AS w FROM part"


@query(f"SELECT p_partkey, 1000 * CAST(list_contains(w, 'ring') AS BIGINT) + 100 * CAST(list_contains(w, 'red') AS BIGINT) AS p_name_search_score, array_to_string(list_sort(w), ' ') AS words FROM ({_NAMES}) WHERE list_has_any(w, ['ring', 'red'])")
def search_words(spark, d):
    """Plurals find singulars' rows; the words of each row come along."""
    found = table(spark, d, "part").create_search_index("p_name").search.p_name("red +ring", include_words=True)
    return found.frame.select("p_partkey", "p_name_search_score", F.array_join("p_name_search_words", " ").alias("words"))


@query(f"SELECT p_partkey, s AS p_name_search_score FROM (SELECT p_partkey, 1000 * CAST(list_contains(w, 'ring') AS BIGINT) + 100 * CAST(list_contains(w, 'red') AS BIGINT) AS s, list_contains(w, 'ring') AS a FROM ({_NAMES}) WHERE list_has_any(w, ['ring', 'red'])) ORDER BY s DESC, a DESC, p_partkey LIMIT 25")
def search_limit(spark, d):
    """The best rows; of equal scores those with the earlier term, then in order."""
    return table(spark, d, "part").orderby("p_partkey").create_search_index("p_name").search.p_name("red +ring", limit=25).select("p_partkey p_name_search_score").frame


@query(f"SELECT p_partkey, 100 * CAST(list_contains(w, 'red') AS BIGINT) - 1000 * CAST(list_contains(w, 'ring') AS BIGINT) AS p_name_search_score FROM ({_NAMES}) WHERE list_has_any(w, ['ring', 'red'])")
def search_sign_conflict(spark, d):
    """The last of a word's signs counts."""
    return table(spark, d, "part").create_search_index("p_name").search.p_name("+ring red -ring ring", min_score=None).select("p_partkey p_name_search_score").frame


@query(f"SELECT p_partkey, 100 AS p_name_search_score FROM ({_NAMES}) WHERE list_contains(w, 'ring') UNION ALL SELECT -1, 100")
def search_rebuilt(spark, d):
    """After a change, and from several fields."""
    t = table(spark, d, "part").select("p_partkey p_name p_type").create_search_index("p_name")
    t.insert({"p_partkey": -1, "p_name": "a last ring", "p_type": "NEW"})
    t.rebuild_search_index("p_name")
    return t.search.p_name("rings").select("p_partkey p_name_search_score").frame


@query("SELECT p_partkey, 200 AS both_search_score FROM part WHERE p_type = 'PROMO' AND p_name LIKE '% ring'")
def search_using(spark, d):
    t = table(spark, d, "part").create_search_index("both", using="p_name p_type")
    return t.search.both("ring promo", min_score=200).select("p_partkey both_search_score").frame


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_summary(spark, d):
    """The events as a stream, in hours; the table arrives at once, and a last row beyond the watermark closes all windows."""
    source, out = scratch_path(spark, "arrived"), scratch_path(spark, "hours")
    events = spark.read.parquet(f"{d}/events.parquet").select("ts", "event_type")
    events.write.parquet(source)
    events.agg((F.max("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts"), F.lit(None).cast("string").alias("event_type")).write.mode("append").parquet(source)
    stream = streaming.follow(spark, source, events.schema)
    hours = streaming.summarized(stream, "ts", "2 days", "1 hour", ["event_type"], n=F.count("*"))
    streaming.write(hours, out, scratch_path(spark, "offsets")).awaitTermination()
    return spark.read.schema(hours.schema).parquet(out).where("event_type is not null").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT event_id, value FROM events WHERE event_type = 'click' AND value > 50")
def stream_filter(spark, d):
    source, out = scratch_path(spark, "arrived"), scratch_path(spark, "clicks")
    events = spark.read.parquet(f"{d}/events.parquet")
    events.write.parquet(source)
    clicks = streaming.follow(spark, source, events.schema).where(event_type="click", value=Table.gt(50)).select("event_id value")
    streaming.write(clicks.frame, out, scratch_path(spark, "offsets")).awaitTermination()
    return spark.read.schema(clicks.frame.schema).parquet(out)


_ERRORS = {
    "batches of none": "ValueError", "comparator without its field": "AttributeError", "excel": "RuntimeError", "index twice": "ValueError", "index unknown": "AttributeError", "index written": "ReadonlyIndexAccessError", "join kind": "ValueError", "join without indexes": "ValueError",
    "json path": "PathNotFoundError", "json path in a stream": "ValueError", "key null": "KeyError", "key twice": "KeyError", "key unknown": "KeyError", "pivot of four": "ValueError", "pivot of three as a grid": "ValueError", "position": "IndexError", "rebuild unknown": "NoSuchIndexError",
    "row unknown": "ValueError", "search stale": "SearchIndexInconsistentError", "search unknown": "ValueError", "split policy": "ValueError", "too many cells": "Exception",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _ERRORS.items()) + ") v(what, error)")
def errors_raised(spark, d):
    n = table(spark, d, "nation").create_index("n_regionkey").create_index("n_nationkey", unique=True)
    stale = table(spark, d, "nation").create_search_index("n_name").insert({"n_name": "x"})
    for c in ("n_name", "more", "most"):
        n.compute_field(c, F.col("n_name")).create_index(c)
    tries = {
        "batches of none": lambda: next(n.batched(0)),
        "comparator without its field": lambda: n.where(zz=Table.lt(1)),
        "excel": lambda: n.excel_export("/dev/null") if importlib.util.find_spec("openpyxl") is None else _raise(RuntimeError),
        "index twice": lambda: n.create_index("n_regionkey"),
        "index unknown": lambda: n.by.zz,
        "index written": lambda: n.by.n_regionkey.__setitem__(1, None),
        "join kind": lambda: n.outer_join("sideways", n.clone(), n_regionkey="n_regionkey"),
        "join without indexes": lambda: n.join(table(spark, d, "region"), auto_create_indexes=False, n_regionkey="r_regionkey"),
        "json path": lambda: Table(spark=spark).json_import('{"a":\n[]}', path="b"),
        "json path in a stream": lambda: Table(spark=spark).json_import("{}\n{}", path="b", streaming=True),
        "key null": lambda: n.clone().insert({"n_nationkey": None}),
        "key twice": lambda: n.clone().insert({"n_nationkey": 3}),
        "key unknown": lambda: n.by.n_nationkey[-1],
        "pivot of four": lambda: n.pivot("n_regionkey n_name more most"),
        "pivot of three as a grid": lambda: n.pivot("n_regionkey n_name more").dump_counts(io.StringIO()),
        "position": lambda: n[1000],
        "rebuild unknown": lambda: n.rebuild_search_index("n_name"),
        "row unknown": lambda: n.index({"n_nationkey": -1}),
        "search stale": lambda: stale.search.n_name("x"),
        "search unknown": lambda: n.search.n_name("x"),
        "split policy": lambda: n.splitby("n_regionkey", errors="ignore"),
        "too many cells": lambda: Table(spark=spark).csv_import("a,b\n1,2,3\n"),
    }

    def said(attempt: Callable[[], object]) -> str:
        try:
            attempt()
        except Exception as e:  # its kind is the result  # noqa: BLE001
            return type(e).__name__
        return "none"

    return spark.createDataFrame([(k, said(f)) for k, f in tries.items()], "what string, error string")


def _raise(kind: type[Exception]) -> None:
    raise kind
