"""Leaves, paths and differences of nested records against plain Python walks."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from sigmark.operators import records


def table(spark, docs):
    return spark.createDataFrame([(k, d) for k, d in docs.items()], "k int, j string").repartition(3).select("k", F.parse_json("j").alias("record"))


def nest(depth: int) -> str:
    return '{"k":' * depth + "[1]" + "}" * depth


def walk(x, path=""):
    if isinstance(x, dict) and x:
        for k, v in x.items():
            yield from walk(v, f"{path}.{k}" if path else k)
    elif path:
        yield path


@pytest.mark.parametrize("depth", [4, 8, 9, 40])
def test_leaves_of_any_depth(spark, depth):
    docs = {1: nest(depth), 2: '{"a": null, "b": {}, "c": [{"d": 1}], "e": {"f": "x", "g": {"h": false}}}', 3: "[1]", 4: "{}", 5: None, 6: '{"only": 1}'}
    got = sorted((r.k, r.path) for r in records.leaves(table(spark, docs), ["k"]).collect())
    assert got == sorted((k, p) for k, d in docs.items() if d for p in walk(json.loads(d)))


def test_leaves_four_hundred_deep(spark, monkeypatch):
    monkeypatch.setattr(records, "LEVELS", 25)
    rows = records.leaves(table(spark, {1: nest(400)}), ["k"]).collect()
    assert [r.path for r in rows] == [".".join(["k"] * 400)]


def test_resolve(spark):
    doc = '{"a": {"b": [{"k": "x", "c": 1}, {"k": 2, "c": null}, {"k": "x", "c": 3}, 7], "n": null}, "list": [10, [20]], "t": "s"}'
    want = {
        "a.b[k=x].c": (True, "1"), "a.b[k=2].c": (True, None), "a.b[k=none].c": (False, None), "a.b[0].c": (True, "1"), "a.b[3]": (True, "7"), "a.b[4]": (False, None),
        "a.n": (True, None), "a.n.x": (False, None), "list[1][0]": (True, "20"), "list[-1]": (False, None), "list[x]": (False, None), "list.0": (False, None), "t": (True, "s"),
        "t[0]": (False, None), "a.b[k=x": (False, None), "": (False, None), "gone": (False, None), "a..t": (False, None), "t[k=s]": (False, None),
    }
    rows = table(spark, {1: doc}).join(spark.createDataFrame([(p,) for p in want], "path string"))
    r = rows.select("path", records.resolve(F.col("record"), F.col("path")).alias("r")).select("path", "r.found", F.col("r.value").try_cast("string").alias("v"))
    assert {x.path: (x.found, x.v) for x in r.collect()} == want
    none = table(spark, {1: None}).select(records.resolve(F.col("record"), F.lit("a")).alias("r")).first().r
    assert (none.found, none.value) == (False, None)


def test_underived(spark):
    docs = table(spark, {1: '{"a": 1, "b": null, "c": "x"}', 2: '{"a": 2.5}'})
    nodes = [(1, "a", "1"), (1, "a", "1.0"), (1, "a", "2"), (1, "b", None), (1, "b", "0"), (1, "c", "x"), (1, "d", None), (2, "a", "2.50"), (3, "a", "1")]
    got = records.underived(spark.createDataFrame(nodes, "k int, path string, value string"), docs, "k").collect()
    assert sorted((r.k, r.path, r.value) for r in got) == [(1, "a", "2"), (1, "b", "0"), (1, "d", None), (3, "a", "1")]


DOC = '{"a": {"b": [{"k": "x", "c": 1}, {"k": 2, "c": null}, {"k": "x", "c": 3}, 7], "n": null}, "list": [10, [20], {"it\'s": [{"q\'": 1, "z": 5}]}], "t": "s"}'
WAYS = ["a.b[k=x].c", "a.b[k=2].c", "a.b[k=none].c", "a.b[0].c", "a.b[3]", "a.b[4]", "a.b[k=x]", "a", "a.n", "a.n.x", "list[1][0]", "list[-1]", "list[x]", "list[+1][0]", "list[99999999999]", "list.0", "t", "t[0]", "a.b[k=x", "", "gone", "a..t", "t[k=s]", "list[2].it's[q'=1].z", "list[2].it's[=1]", "[0]", "a.b[].c"]


def test_known_paths_lead_where_others_do(spark):
    rows = table(spark, {1: DOC, 2: "[[3]]", 3: "null", 4: None}).cache()
    for p in WAYS:
        r = rows.select("k", records.resolve(F.col("record"), F.lit(p)).alias("r"), records.led(F.col("record"), p).alias("v"))
        for x in r.select("k", "r.found", F.to_json("r.value").alias("a"), F.col("v").isNotNull().alias("there"), F.to_json("v").alias("b")).collect():
            assert (x.found, x.a) == (x.there, x.b), (p, x)


def test_unlike_of_known_and_other_paths(spark):
    docs = table(spark, {1: '{"a": 1, "b": null, "c": "x"}', 2: '{"a": 2.5}'})
    nodes = spark.createDataFrame([(1, "a", "1"), (1, "a", "1.0"), (1, "a", "2"), (1, "b", None), (1, "b", "0"), (1, "c", "x"), (1, "d", None), (2, "a", "2.50"), (3, "a", "1")], "k int, path string, value string")
    whole = sorted((r.k, r.path, r.value or "", r.found, r.source or "") for r in records.underived(nodes, docs, "k").collect())
    assert whole == sorted((r.k, r.path, r.value or "", r.found, r.source or "") for r in records.underived(nodes, docs, "k", ["a", "d"]).collect())
    assert [x[:2] for x in whole] == [(1, "a"), (1, "b"), (1, "d"), (3, "a")]


@pytest.mark.parametrize("name", ["x04_resolve_path", "x08_no_derivation"])
def test_lines_of_orders_are_read_once_and_their_paths_at_once(spark, name):
    """No record is opened step by step where its paths are known, and lines are grouped once."""
    from sigmark.plans import load

    plan = load()[0][name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linenumber") and plan.count("collect_list") == 1 and "regexp_extract_all" not in plan and "Generate explode([[" not in plan
    assert plan.count("Relation") == 2


def diff(a, b, path="$"):
    kind = lambda x: "object" if isinstance(x, dict) else "list" if isinstance(x, list) else "number" if isinstance(x, (int, float)) and not isinstance(x, bool) else type(x).__name__
    if kind(a) != kind(b):
        yield path, "type_changed"
    elif isinstance(a, dict):
        for k in sorted({*a, *b}):
            if k not in b:
                yield f"{path}.{k}", "key_removed"
            elif k not in a:
                yield f"{path}.{k}", "unexpected_new_key"
            else:
                yield from diff(a[k], b[k], f"{path}.{k}")
    elif isinstance(a, list):
        text = lambda v: json.dumps(v, sort_keys=True)
        if len(a) != len(b):
            yield path, "list_length_changed"
        elif a != b and sorted(map(text, a)) == sorted(map(text, b)):
            yield path, "list_order_changed"
        else:
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                yield from diff(x, y, f"{path}[{i}]")
    elif a != b:
        yield path, "value_changed"


def test_typed_diff(spark):
    rng = random.Random(2)

    def value(depth):
        k = rng.randrange(8 if depth else 5)
        return [None, True, rng.randrange(3), rng.randrange(3) / 2 + 0.25, rng.choice("xy")][k] if k < 5 else [value(depth - 1) for _ in range(rng.randrange(3))] if k == 5 else {c: value(depth - 1) for c in rng.sample("abcd", rng.randrange(4))}

    def changed(x):
        if rng.random() < 0.15:
            return value(2)
        if isinstance(x, dict):
            return {k: changed(v) for k, v in x.items()}
        if isinstance(x, list):
            out = [changed(v) for v in x]
            rng.shuffle(out)
            return out
        return x

    old = {k: {c: value(3) for c in "pq"} for k in range(150)}
    new = {k: changed(v) for k, v in old.items()}
    del old[3], new[5]
    want = sorted((k, *d) for k in old if k in new for d in diff(old[k], new[k])) + [(3, "$", "record_added"), (5, "$", "record_removed")]
    made = lambda x: table(spark, {k: json.dumps(v) for k, v in x.items()})
    got = records.typed_diff(made(old), made(new), ["k"]).collect()
    assert sorted((r.k, r.path, r.issue) for r in got) == sorted(want) and len({w[2] for w in want}) >= 7
    fewer = records.typed_diff(made(old), made(new), ["k"], [r"\.[ab]$"]).collect()
    assert sorted(tuple(r) for r in fewer) == sorted(w for w in want if not (w[2] == "unexpected_new_key" and w[1][-1] in "ab"))
