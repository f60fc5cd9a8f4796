"""The table API on small tables, with the results that its users rely on."""

import datetime as dt
import random
import re
from collections import namedtuple
from dataclasses import dataclass

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftframe import SearchIndexInconsistentError, Table, attrgetter
from weftframe.errors import NoSuchIndexError, ReadonlyIndexAccessError
from weftframe.functions import words
from weftframe.operators import search
from weftframe.operators.fields import parse_fields, parse_sort
from weftframe.plans.scratch import BATCHES, stash


@pytest.fixture(scope="module")
def cube(spark):
    return Table("cube", spark.range(125).selectExpr("id div 25 a", "id div 5 % 5 b", "id % 5 c").coalesce(1))


def make(spark, rows, name="t"):
    return Table(name, spark=spark).insert_many(rows)


def values(t, name):
    return list(t.all(name))


@pytest.mark.parametrize(
    ("test", "n"),
    [(Table.lt(2), 50), (Table.le(2), 75), (Table.gt(2), 50), (Table.ge(2), 75), (Table.eq(2), 25), (Table.ne(2), 100), (Table.between(1, 3), 25), (Table.within(1, 3), 75), (Table.in_range(1, 3), 50)]
    + [(Table.is_in([1, 3]), 50), (Table.is_in([]), 0), (Table.not_in([1, 3]), 75), (Table.not_in([]), 125), (Table.is_none(), 0), (Table.is_not_none(), 125), (Table.startswith("3"), 25), (Table.endswith("4"), 25)]
    + [(2, 25), (lambda v: v % 2 == 0, 75), (re.compile("[12]").match, 50)],
)
def test_where(cube, test, n):
    assert len(cube.where(c=test)) == n


def test_where_combines_and_takes_row_functions(cube):
    assert len(cube.where(a=1, b=Table.gt(2))) == 10
    assert len(cube.where(lambda r: r.a + r.b == r.c)) == 15
    assert len(cube.where(lambda r: int(r.a) in (1, 2) and r.b > 3)) == 10
    assert len(cube.where()) == 125


def test_nulls_follow_two_valued_logic(spark):
    t = make(spark, [{"a": 1, "b": "x"}, {"a": None, "b": ""}, {"a": 4, "b": None}])
    count = lambda **kw: len(t.where(**kw))
    assert [count(a=Table.ne(4)), count(a=Table.not_in([4])), count(a=Table.not_in([4, None])), count(a=None), count(a=Table.is_in([None])), count(a=Table.lt(9))] == [2, 2, 1, 1, 1, 2]
    assert [count(b=Table.is_null()), count(b=Table.is_not_null()), count(b=Table.is_none()), count(b=Table.startswith("x"))] == [2, 1, 1, 1]
    assert t.delete(a=Table.lt(3)) == 1 and len(t) == 2 and t.delete() == 0


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).write.parquet(f"{tmp_path}/x")
    plan = Table(df=spark.read.parquet(f"{tmp_path}/x")).where(id=Table.within(3, 7)).df._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(id,3)" in plan and "LessThanOrEqual(id,7)" in plan


def test_order_slices_and_positions(spark):
    letters = [{"A": c} for c in "abcdefghijklmnopqrstuvwxyz"]
    t = make(spark, letters)
    text = "".join(r["A"] for r in letters)
    joined = lambda x: "".join(values(x, "A"))
    for key in (slice(3), slice(-4, None), slice(5, 20, 3), slice(None, None, -1), slice(20, 2, -4), slice(30, 40), slice(-3, None)):
        assert joined(t[key]) == text[key]
    assert (t[0]["A"], t[-1]["A"], t[7]["A"]) == ("a", "z", "h")
    with pytest.raises(IndexError):
        t[26]
    assert joined(t.head(3)) == "abc" and joined(t.tail(3)) == "xyz" and joined(t.tail(0)) == ""
    assert [joined(b) for b in t[:7].batched(3)] == ["abc", "def", "g"]
    with pytest.raises(ValueError, match="rows"):
        next(t.batched(0))
    assert "".join(r["A"] for r in reversed(t)) == text[::-1]
    assert t.pop()["A"] == "z" and t.pop(0)["A"] == "a" and len(t) == 24
    del t[2:10:2]
    assert joined(t) == "bcegi" + text[10:-1] or joined(t) == "".join(c for i, c in enumerate(text[1:-1]) if i not in (2, 4, 6, 8))
    assert t.index({"A": "c"}) == 1 and {"A": "c"} in t and {"A": "z"} not in t and t.count({"A": "c"}) == 1
    assert sorted(joined(t.clone().shuffle(1))) == sorted(joined(t))


def test_sort_is_stable_and_mixed(spark):
    rng = random.Random(1)
    rows = [{"a": rng.randrange(3), "b": rng.randrange(3), "n": i} for i in range(40)]
    t = make(spark, rows)
    assert values(t.clone().orderby("a, b desc"), "n") == [r["n"] for r in sorted(rows, key=lambda r: (r["a"], -r["b"]))]
    assert values(t.clone().orderby([("a", "desc"), "b"]), "n") == [r["n"] for r in sorted(rows, key=lambda r: (-r["a"], r["b"]))]
    assert values(t.clone().orderby("a", reverse=True), "n") == [r["n"] for r in sorted(rows, key=lambda r: -r["a"])]
    assert values(t.clone().orderby(lambda r: r.a * 3 + r.b), "n") == [r["n"] for r in sorted(rows, key=lambda r: r["a"] * 3 + r["b"])]
    ranked = t.clone().orderby("a").rank(start=5)
    assert values(ranked, "rank") == list(range(5, 45)) and values(ranked, "a") == sorted(r["a"] for r in rows)
    nulls = make(spark, [{"x": 2}, {"x": None}, {"x": 1}])
    assert values(nulls.clone().orderby("x"), "x") == [1, 2, None] and values(nulls.orderby("x desc"), "x") == [None, 2, 1]


def test_field_language():
    cols = ["a", "b", "c"]
    assert [parse_fields(f, cols) for f in (None, "*", "c *", "* -b", "-b", "a c", ["b", "x"])] == [cols, cols, ["c", "a", "b"], ["a", "c"], ["a", "c"], ["a", "c"], ["b", "x"]]
    assert [(k.name, k.descending) for k in parse_sort("a, b desc", True)] == [("a", True), ("b", False)]
    with pytest.raises(ValueError, match="sort order"):
        parse_sort("a down")


def test_projection(spark):
    t = make(spark, [{"a": 1, "b": "x"}, {"a": 2, "b": None}])
    assert [tuple(r) for r in t.select("b nope", twice=lambda r: r.a * 2, s="{b}-{0.a}")] == [("x", None, 2, "x-1"), (None, None, 4, "None-2")]
    assert [tuple(r) for r in t.select(n=lambda r: len(str(r.b)))] == [(1,), (4,)]
    t.compute_field("c", lambda r: 6 // (r.a - 1), default=-1).add_field("d", "b")
    assert values(t, "c") == [-1, 6] and values(t, "d") == ["x", None]
    assert list(t.format("{a}:{b}")) == ["1:x", "2:None"]
    assert [tuple(r) for r in t.formatted_table("a b")] == [("1", "x"), ("2", "None")]
    assert attrgetter("a", "z", defaults={"z": 9})(t[0]) == (1, 9) and t.namedtuple_from_fields("N")._fields == ("a", "b", "c", "d")
    assert values(make(spark, [{"k": v} for v in "baab"]), "k") == list("baab") and list(make(spark, [{"k": v} for v in "baab"]).all.k.unique) == ["b", "a"]


def test_rows_of_many_kinds(spark):
    point, other = namedtuple("P", "x y"), None

    @dataclass
    class D:
        x: int
        y: str

    class S:
        __slots__ = ("x", "y")

        def __init__(self, x, y):
            self.x, self.y = x, y

    t = Table(spark=spark).insert_many([point(1, "a"), D(2, "b"), S(3, "c"), {"x": 4}, {"x": 5, "z": 2.5}])
    assert [tuple(r) for r in t] == [(1, "a", None), (2, "b", None), (3, "c", None), (4, None, None), (5, None, 2.5)] and other is None
    t.insert({"x": 6, "y": "q"})
    assert values(t, "x") == [1, 2, 3, 4, 5, 6]
    assert len(t.clear()) == 0 and len(Table(spark=spark)) == 0


def test_remove_takes_first_matches(spark):
    t = make(spark, [{"v": x, "n": 0} for x in (1, 2, 1, 3, 1, None)])
    t.remove_many([{"v": 1, "n": 0}, {"v": 1, "n": 0}, {"v": 9, "n": 0}, {"v": None, "n": 0}])
    assert values(t, "v") == [2, 3, 1]


def test_indexes(spark):
    t = make(spark, [{"k": f"{a}{b}", "a": a, "n": i} for i, (a, b) in enumerate((a, b) for a in "AB" for b in "XYZ")])
    t.create_index("k", unique=True).create_index("a").create_index("n")
    assert t.by.k["AY"]["n"] == 1 and values(t.by.a["B"], "n") == [3, 4, 5] and len(t.by.a["Q"]) == 0
    assert values(t.by.n[2:4], "n") == [2, 3] and values(t.by.n[:2], "n") == [0, 1] and values(t.by.n[4:], "n") == [4, 5]
    for bad in (slice(4, 2), slice(None), slice(1, 4, 2)):
        with pytest.raises(ValueError, match="slice"):
            t.by.n[bad]
    with pytest.raises(KeyError):
        t.by.k["nope"]
    assert t.by.k.get("nope", 7) == 7 and "AX" in t.by.k and t.by.a.keys() == ["A", "B"] and len(t.by.a) == 2 and list(t.by.a) == ["A", "B"]
    assert values(t.by.a["A"].by.k.get("AZ") and t.by.a["A"], "n") == [0, 1, 2]
    with pytest.raises(AttributeError):
        t.by.zzz  # noqa: B018
    with pytest.raises(ValueError, match="exists"):
        t.create_index("a")
    with pytest.raises(KeyError):
        t.create_index("a", unique=True, force=True)
    with pytest.raises(KeyError):
        t.insert({"k": "AX", "a": "A", "n": 9})
    with pytest.raises(KeyError):
        t.insert({"k": None, "a": "A", "n": 9})
    with pytest.raises(ReadonlyIndexAccessError):
        t.get_index("a")["A"] = 1
    assert t.info()["indexes"][0] == ("k", True) and len(t) == 6 and "a" in dir(t.by)
    assert "a" not in t.drop_index("a").drop_index("a").info()["indexes"]
    with pytest.raises(TypeError):
        make(spark, [{"l": [1]}]).create_index("l")


@pytest.fixture(scope="module")
def shop(spark):
    catalog = make(spark, [dict(zip(("sku", "color", "size"), r, strict=True)) for r in (("001", "red", "XL"), ("002", "blue", "S"), ("003", "green", None), ("004", "black", "M"))], "catalog")
    prices = make(spark, [dict(zip(("sku", "unit_price", "size"), r, strict=True)) for r in (("001", "10", "XL"), ("002", "12", None), ("003", "9", None), ("005", "7", "M"))], "prices")
    return catalog, prices


def test_joins(spark, shop):
    c, p = shop
    assert len(c.join(p, sku="sku")) == 3 and len(c.join(p, sku="sku", size="size")) == 1
    named = c.join(p, ["sku", (p, "size", "psize"), (c, "color")], sku="sku")
    assert named.columns == ["sku", "psize", "color"] and named.table_name == "(catalog:sku^prices:sku)"
    assert c.join(p, sku="sku").columns == ["sku", "color", "size", "unit_price"]
    keep_self = c.outer_join(Table.RIGHT_OUTER_JOIN, p, sku="sku")
    assert sorted(values(keep_self, "sku")) == ["001", "002", "003", "004"] and keep_self.where(unit_price=None)[0]["sku"] == "004"
    assert sorted(values(c.outer_join(Table.LEFT_OUTER_JOIN, p, sku="sku"), "sku")) == ["001", "002", "003", "005"]
    assert len(c.outer_join(Table.FULL_OUTER_JOIN, p, sku="sku")) == 5 and len(c.outer_join(None, p, how="left", sku="sku")) == 4
    skus, sizes = 5, 3
    assert len(c.outer_join(Table.FULL_OUTER_JOIN, p, sku="sku", size="size")) == skus * sizes
    assert len(c.outer_join(Table.FULL_OUTER_JOIN, p, compat=False, sku="sku", size="size")) == 4
    assert len(c.outer_join(Table.RIGHT_OUTER_JOIN, p, sku="sku", size="size")) == 3  # the row with a null size has no key
    assert values(c.anti_join(p, sku="sku"), "sku") == ["004"]
    for bad, error in (({}, TypeError), ({"sku": 1}, TypeError), ({"nope": "sku"}, ValueError)):
        with pytest.raises(error):
            c.join(p, **bad)
    with pytest.raises(ValueError, match="one of"):
        c.outer_join("sideways", p, sku="sku")
    with pytest.raises(ValueError, match="no field"):
        c.join(p, "sku nope", sku="sku")
    with pytest.raises(ValueError, match="index"):
        c.join_on("color")
    assert len(c.join(p.where(sku="nope"), sku="sku")) == 0


def test_join_of_a_heavy_key_is_dealt_to_several_tasks(spark):
    rows = lambda n, name: Table(name, spark.range(n).selectExpr("if(id % 1000 = 7, null, id % 1000 div 500) k", f"id {name}").union(spark.sql(f"select {2 if name == 'x' else 3} k, -1L {name}")).coalesce(1))
    x, y = rows(6000, "x"), rows(4000, "y")
    plain = x.frame.join(y.frame.withColumnRenamed("k", "k2"), F.expr("k = k2"), "full")
    for joined, padded in ((x.join(y, k="k"), "x is not null and y is not null"), (x.outer_join("", y, how="left", k="k"), "x is not null"), (x.outer_join("", y, how="right", k="k"), "y is not null")):
        found = joined.frame.select("x", "y", F.spark_partition_id().alias("task"))
        each = found.groupBy("task").agg(F.count("*").alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("h")).collect()
        expected = plain.where(padded).where("coalesce(k, k2) is not null").agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        assert (sum(r.n for r in each), sum(r.h for r in each)) == tuple(expected)
        assert max(r.n for r in each) < 0.45 * expected[0]  # two keys: without shares, a task has half of the rows at least


def test_join_terms(spark, shop):
    c, p = (t.clone().create_index("sku") for t in shop)
    assert len((c.join_on("sku") + p.join_on("sku"))()) == 3
    assert (c.join_on("sku") + p)("sku unit_price").columns == ["sku", "unit_price"] and len((c + p.join_on("sku"))()) == 3
    third = make(spark, [{"sku": "001", "x": 1}], "third").create_index("sku")
    assert values((c.join_on("sku") + p.join_on("sku") + third.join_on("sku"))(), "x") == [1]


def test_groups_and_unique(spark):
    t = make(spark, [{"k": k, "v": v} for k, v in zip("aabbabbb", range(8), strict=True)])
    out = t.groupby_with_summaries("k", n=len, total=(sum, "v"), spread=lambda rows: max(r.v for r in rows) - min(r.v for r in rows))
    assert [tuple(r) for r in out] == [("a", 3, 5, 4), ("b", 5, 23, 5)]
    assert [tuple(r) for r in t.groupby_with_summaries(("odd", lambda r: r.v % 2), n=len)] == [(0, 4), (1, 4)]
    with pytest.raises(TypeError):
        t.groupby_with_summaries(3, n=len)
    assert [(k, values(g, "v")) for k, g in t.groupby("k")] == [("a", [0, 1]), ("b", [2, 3]), ("a", [4]), ("b", [5, 6, 7])]
    assert [(k, values(g, "v")) for k, g in t.groupby("k", sort=True)] == [("a", [0, 1, 4]), ("b", [2, 3, 5, 6, 7])]
    assert values(t.unique("k"), "v") == [0, 2] and values(t.unique(lambda r: r.v % 3), "v") == [0, 1, 2]
    assert values((t + t).unique(), "v") == list(range(8)) and len(t + t) == 16
    t += [{"k": "z", "v": 9}]
    assert len(t) == 9


def test_runs_cross_blocks(spark, monkeypatch):
    from weftframe.plans import order

    monkeypatch.setattr(order, "BLOCK", 2)
    rng = random.Random(3)
    keys = [k for k in "abcabca" for _ in range(rng.randrange(1, 11))]
    t = make(spark, [{"k": k, "n": i} for i, k in enumerate(keys)])
    want = [0]
    for i in range(1, len(keys)):
        want.append(want[-1] if keys[i] == keys[i - 1] else i)
    assert values(t.run_ids("k"), "run") == want


def test_splitby(spark):
    t = make(spark, [{"v": v} for v in (0, 1, None, 3)])
    assert [values(x, "v") for x in t.splitby("v")] == [[0, None], [1, 3]]
    assert [values(x, "v") for x in t.splitby(v=1)] == [[0, None, 3], [1]]
    bad = lambda r: int(r.v) > 1
    assert [values(x, "v") for x in t.splitby(bad)] == [[0, 1], [3]]
    assert [values(x, "v") for x in t.splitby(bad, errors="return")] == [[0, 1], [3], [None]]
    assert [values(x, "v") for x in t.splitby(bad, errors=True)] == [[0, 1], [None, 3]]
    assert [values(x, "v") for x in t.splitby(bad, errors={TypeError: False})] == [[0, 1, None], [3]]
    with pytest.raises(Exception, match="NoneType"):
        values(t.splitby(bad, errors="raise")[0], "v")
    with pytest.raises(ValueError, match="policy"):
        t.splitby(bad, errors="maybe")


def test_stats(spark):
    t = make(spark, [{"a": 1, "b": 2, "s": "x"}, {"a": 3, "b": None, "s": "y"}, {"a": 5, "b": 4, "s": "z"}])
    assert [tuple(r) for r in t.stats()] == [("a", 3.0, 3.0, 1.0, 5.0, 4.0, 2.0, 3, 0), ("b", 3.0, 3.0, 2.0, 4.0, 2.0, 1.414, 2, 1)]
    turned = {r["stat"]: (r["a"], r["b"]) for r in t.stats(by_field=False)}
    assert turned["mean"] == (3.0, 3.0) and turned["missing"] == (0.0, 1.0)
    assert len(t[:0].stats()) == 0 and t[:1].stats("a")[0]["variance"] is None
    assert values(make(spark, [{"x": v} for v in (1, 2, 3, 5)]).stats(), "median") == [2.5]


def test_pivot(spark):
    rows = [{"a": a, "b": b, "c": c} for a, b, c in (("x", 1, "p"), ("x", 1, "q"), ("y", 2, "p"), ("z", None, "p"))]
    t = make(spark, rows)
    for f in "abc":
        t.create_index(f)
    assert [tuple(r) for r in t.pivot("a").as_table()] == [("x", 2), ("y", 1), ("z", 1)]
    assert [tuple(r) for r in t.pivot("a b").as_table()] == [("x", 1, 2), ("x", 2, 0), ("y", 1, 0), ("y", 2, 1), ("z", 1, 0), ("z", 2, 0)]
    assert [tuple(r) for r in t.pivot("a b c").as_table() if r["Count"]] == [("x", 1, "p", 1), ("x", 1, "q", 1), ("y", 2, "p", 1)]
    assert t.pivot("a b").as_table(max, "b").columns == ["a", "b", "max_b"]
    p = t.pivot("a b")
    assert p.keys() == ["x", "y", "z"] and p["x"].keys() == [1] and len(p["x"][1]) == 2 and p["x"].pivot_key_str() == "a:x" and p.has_subtables()
    import io

    out = io.StringIO()
    p.dump_counts(out, colwidth=5)
    assert out.getvalue().splitlines() == ["Pivot: a,b", "          1     2 Total", "x         2     0     2", "y         0     1     1", "z         0     0     0", "Total     2     1     3"]
    out = io.StringIO()
    p.dump(out, row_fn=lambda r: r["c"])
    assert out.getvalue().splitlines() == ["a:x", "  b:1", "    p", "    q", "a:y", "  b:2", "    p", "a:z"]
    assert p.summarize().as_html().count("<tr>") == 5
    for bad in ("a nope", "a b c a"):
        with pytest.raises(ValueError, match="pivot"):
            t.pivot(bad)
    with pytest.raises(ValueError, match="one or two"):
        t.pivot("a b c").dump_counts()


RECIPES = """tuna, noodles, Cream of Mushroom Soup|pizza dough pineapple ham tomato sauce|pizza dough cheese pesto artichoke hearts|pizza dough cheese tomato sauce pepperoni|bread cheese butter
tuna mayonnaise tomato bread cheese|hot dog chili onion bun|egg milk vanilla bread maple syrup|bread bacon lettuce tomato mayonnaise|rye bread sauerkraut corned beef swiss cheese russian dressing thousand island
ground beef bun lettuce ketchup mustard pickle|ground beef bun lettuce ketchup mustard pickle cheese|ground beef bun lettuce ketchup mustard pickle cheese bacon"""


def test_search(spark):
    t = make(spark, [{"id": i, "ingredients": s} for i, s in enumerate(re.split(r"[|\n]", RECIPES), 1)])
    t.create_search_index("ingredients")
    find = lambda q, **kw: [r.id for r, *_ in t.search.ingredients(q, as_table=False, **{"min_score": -10000, **kw})]
    for q, want in {
        "": [],
        "tuna": [1, 6],
        "tuna +cheese": [6, 3, 4, 5, 10, 12, 13, 1],
        "pineapple +bacon lettuce beef -sauerkraut tomato": [9, 13, 2, 11, 12, 4, 6, 10],
        "pizza dough -pineapple": [3, 4, 2],
        "pizza dough --pineapple": [3, 4],
        "bread bacon": [9, 5, 6, 8, 10, 13],
        "bread ++bacon": [9, 13],
        "bread ++anchovies": [],
        "bread ++bacon ++anchovies": [],
        "bread bacon --anchovies": [9, 5, 6, 8, 10, 13],
        "++pineapple ++bacon": [],
    }.items():
        assert find(q) == want, q
    assert find("bread bacon", limit=2) == [9, 5] and find("tuna -noodle", min_score=0) == [6]
    table = t.search.ingredients("tuna", include_words=True)
    assert table[0]["ingredients_search_score"] == 100 and set(table[0]["ingredients_search_words"]) == {"noodles", "noodle", "tuna", "soup", "cream", "mushroom"}
    with pytest.raises(ValueError, match="no search index"):
        t.search.nope("x")
    t.pop(0)
    with pytest.raises(SearchIndexInconsistentError):
        t.search.ingredients("tuna")
    assert [r["id"] for r in t.rebuild_search_index("ingredients").search.ingredients("tuna")] == [6]
    with pytest.raises(NoSuchIndexError):
        t.rebuild_search_index("nope")
    t.create_search_index("both", using="id ingredients")
    assert [r["id"] for r in t.search.both("13")] == [13]


@pytest.mark.parametrize(
    ("word", "forms"),
    [("NoChange", "nochange"), ("I.B.M.", "i.b.m. ibm"), ("M.", "m"), ("MM.xyz", "mm mm.xyz xyz"), ("Threading.isAlive()", "isalive threading threading.isalive"), ("*xxx-hhh", "hhh xxx xxx-hhh"), ("foxes", "fox foxes")]
    + [("churches", "church churches"), ("dress", "dress"), ("bias", "bias"), ("toys", "toy toys"), ("babies", "babies baby"), ("addenda", "addenda addendum"), ("rabies", "rabies"), ("laziness", "laziness"), ("physics", "physics")]
    + [("Python's", "python"), ("ValueError", "error valueerror"), ("terror", "terror"), ("error", "error"), ("babies'", "babies baby"), ("cakes!", "cake cakes"), ("antique", "antique"), ("men.", "man men"), ("a.b.Cd", "a.b.cd cd")],
)
def test_word_forms(word, forms):
    assert sorted(words.word_forms(word)) == sorted(forms.split())


def test_stopwords():
    assert list(words.words("The cat isn't on those mats", words.STOPWORDS)) == ["cat", "mat", "mats"]
    assert words.plain_word("I.B.M. x") == "ibm" and words.plain_word("*snake_case-x!") == "snake_case-x"


def test_conversions(spark):
    t = make(spark, [{"s": s} for s in ("1000", "3.14", "", "text")])
    assert values(t.clone().compute_field("n", Table.convert_numeric(F.col("s"))), "n") == [1000.0, 3.14, None, None]
    assert values(t.clone().compute_field("n", Table.convert_numeric(empty=0, non_numeric=-1)(F.col("s"))), "n") == [1000.0, 3.14, 0.0, -1.0]
    assert [Table.convert_numeric(v) for v in ("7", "7.5", "", "x")] == [7, 7.5, "", "x"] and Table.convert_numeric("7", force_float=True) == 7.0
    d = make(spark, [{"s": s} for s in ("2001-02-03", "2001-02-30", "")])
    assert values(d.clone().compute_field("d", Table.parse_date("%Y-%m-%d")(F.col("s"))), "d") == [dt.date(2001, 2, 3), None, None]
    assert values(d.clone().compute_field("d", Table.parse_datetime("%Y-%m-%d", on_error=dt.datetime(1999, 1, 1))(F.col("s"))), "d")[1] == dt.datetime(1999, 1, 1)
    h = make(spark, [{"s": "0:03:45"}]).compute_field("d", Table.parse_timedelta("%H:%M:%S")(F.col("s")))
    assert values(h, "d") == [dt.timedelta(seconds=225)] and Table.parse_timedelta("%H:%M")("1:30") == dt.timedelta(hours=1.5)


def test_search_words_are_made_in_parts():
    texts = [" ".join(f"w{i}x{j % 9}" for j in range(i, i + 700)) for i in range(400)] + [None, "", " ".join(f"u{i}" for i in range(100_000)), "w1x1 last"]
    parts = list(search.tokens(frozenset()).func(iter([pa.array(texts), pa.array([], pa.string()), pa.array(["w1x1"])])))
    assert [x for part in parts for x in part.to_pylist()] == [sorted(set((t or "").split())) for t in [*texts, "w1x1"]]
    assert len(parts) > 3 and max(sum(len(w) + 1 for words_ in p.to_pylist() for w in words_) for p in parts) < 2 * search.PIECE


def test_batches_sent_to_python_are_bounded(spark):
    seen = F.arrow_udf(lambda x: pa.array([len(x)] * len(x), pa.int64()), "bigint")
    before = [spark.conf.get(k) for k in BATCHES]
    df = spark.range(3000).coalesce(1).select(F.repeat(F.lit("x"), F.lit(10_000)).alias("text"), seen("text").alias("n"))
    assert stash(df, "test", batch=(100, 1 << 30)).agg(F.max("n"), F.count("*")).first()[:] == (100, 3000)
    assert stash(df, "test", batch=(10_000, 1 << 17)).agg(F.max("n")).first()[0] < 30
    assert [spark.conf.get(k) for k in BATCHES] == before


def test_can_is_searchable():
    assert "can" not in words.STOPWORDS and {"can't", "isn't", "she'd", "t", ""} <= words.STOPWORDS
    assert list(words.words("you can do", words.STOPWORDS)) == ["can"]


def test_comparators_need_their_field(spark):
    t = Table(spark=spark).insert_many([{"a": 1}, {"a": 2}])
    for test in (Table.lt(3), Table.eq(None), Table.is_none(), Table.is_in([1]), Table.startswith("x"), Table.between(0, 3)):
        with pytest.raises(AttributeError):
            t.where(zz=test)
    assert len(t.where(zz=Table.is_null())) == 2 and len(t.where(zz=Table.is_not_null())) == 0
    assert len(t.where(zz=5)) == len(t.where(zz=None)) == 0
    assert len(Table(spark=spark).where(zz=Table.lt(3))) == 0


def test_attrgetter_gives_tuples_with_defaults():
    rows_ = [{"a": "x", "c": 1}, {"a": "y", "c": None}, {"a": "a"}]
    assert [attrgetter("a")(r) for r in rows_] == [("x",), ("y",), ("a",)]
    assert [attrgetter("a", "c")(r) for r in rows_] == [("x", 1), ("y", None), ("a", None)]
    assert [attrgetter("a", "c", defaults={"c": -1})(r) for r in rows_] == [("x", 1), ("y", None), ("a", -1)]


def test_types_come_from_all_rows(spark):
    t = Table("t", spark.range(100).withColumnRenamed("id", "a"))
    t.compute_field("half", lambda r: r.a if int(r.a) < 50 else int(r.a) / 2)
    t.compute_field("mixed", lambda r: None if int(r.a) < 30 else int(r.a) if int(r.a) < 60 else f"x{int(r.a)}")
    t.compute_field("late", lambda r: 1 / (int(r.a) - 40) if int(r.a) >= 40 else None, default=7)
    got = {r["a"]: r for r in t.frame.collect()}
    assert got[3]["half"] == 3.0 and got[99]["half"] == 49.5
    assert [got[i]["mixed"] for i in (5, 40, 99)] == [None, "40", "x99"]
    assert got[40]["late"] == 7.0 and got[42]["late"] == 0.5
    with pytest.raises(Exception, match="is no bigint"):
        t.compute_field("bad", lambda r: int(r.a) / 2, returns="bigint").frame.collect()


def test_medians_are_exact(spark):
    import statistics

    values = [(i % 7, float((i * 37) % 101), None if i % 3 else i) for i in range(500)]
    t = Table("t", spark.createDataFrame(values, "a int, b double, c bigint").repartition(5))
    got = {r["name"]: r["median"] for r in t.stats(rounded=False).frame.collect()}
    for k, name in enumerate("abc"):
        assert got[name] == statistics.median(v[k] for v in values if v[k] is not None)


def test_present_options(spark):
    import io

    out = io.StringIO()
    Table("Numbers", spark=spark).insert_many([{"a": 1, "b": "x"}, {"a": 20, "b": "y"}]).present(file=out, caption="two rows", show_header=False, show_lines=True)
    assert out.getvalue().splitlines() == [" Numbers", "+----+---+", "|  1 | x |", "+----+---+", "| 20 | y |", "+----+---+", " two rows"]


def test_remove_many_takes_the_first_equal_rows(spark):
    t = Table(spark=spark).insert_many([{"a": v, "b": i} for i, v in enumerate("xyxzx")]).select("a b")
    t.remove_many([{"a": "x", "b": 0}, {"a": "x", "b": 0}, {"a": "q", "b": 1}])
    assert [r["b"] for r in t] == [1, 2, 3, 4]
    u = Table(spark=spark).insert_many([{"a": v} for v in "xyxzx"])
    assert [r["a"] for r in u.remove_many([{"a": "x"}, {"a": "x"}])] == ["y", "z", "x"]


def test_scratch_tables_can_be_cleared(spark):
    from weftframe.plans import scratch

    scratch.stash(spark.range(5), "some")
    assert scratch.clear(spark) >= 1 and scratch.clear(spark) == 0


def test_dense_grids_have_a_bound(spark):
    from weftframe.plans import scratch

    sets = [spark.range(100).toDF("a"), spark.range(100).toDF("b")]
    assert scratch.product(sets).count() == 10_000
    with pytest.raises(ValueError, match="10000 cells"):
        scratch.product(sets, most=9_999)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from weftframe.plans import scratch

    def session(master, folder=None):
        conf = SimpleNamespace(get=lambda key, default: folder)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch.shared_dir(session(master))
        assert scratch.shared_dir(session(master, "hdfs://x/y/")) == "hdfs://x/y"
