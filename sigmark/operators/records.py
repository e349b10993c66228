"""Nested records as VARIANT: their leaves, what a path leads to, and typed differences between two versions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut

#: Levels that are opened in one job.
LEVELS = 8
#: Keys that can stand in a path of variant_get.
PLAIN = re.compile(r"[^'\"\\]+")


def _members(v: Column) -> Column:
    """A variant's members by key, null if it is no object."""
    return v.try_cast("map<string,variant>")


def _items(v: Column) -> Column:
    return v.try_cast("array<variant>")


def leaves(records: DataFrame, keys: list[str], record: str = "record") -> DataFrame:
    """keys, path and value of every leaf: lists, nulls, empty objects and scalars; path joins the keys by dots.

    Records are opened level by level until none is open, however deep they are;
    each few levels are a table, and what is closed by then is done.
    """
    open_ = lambda v: F.coalesce(F.size(_members(v)), F.lit(0)) > 0
    level, out = records.where(F.col(record).isNotNull()).select(*keys, F.lit(None).cast("string").alias("path"), F.col(record).alias("value")), None
    while True:
        for _ in range(LEVELS):
            each = level.select(*keys, "path", "value", F.explode_outer(F.when(open_(F.col("value")), F.map_entries(_members(F.col("value"))))).alias("e"))
            level = each.select(*keys, F.when(F.col("e").isNull(), F.col("path")).otherwise(F.concat_ws(".", "path", "e.key")).alias("path"), F.when(F.col("e").isNull(), F.col("value")).otherwise(F.col("e.value")).alias("value"))
        level = cut(level.withColumn("open", open_(F.col("value"))), "leaves")
        done = level.where("not open and path is not null").drop("open")
        out = done if out is None else out.unionByName(done)
        level = level.where("open").drop("open")
        if not level.limit(1).count():
            return out


def resolve(record: Column, path: Column) -> Column:
    """{found, value}: what a path such as ``a.b[k=v].c`` or ``a[0]`` leads to; found tells a stored null from nothing.

    A step is a key, a place in a list, or the first object of a list whose member
    k has the text v.  A path without steps, or with a bracket left open, leads nowhere.
    """
    steps = F.regexp_extract_all(path, F.lit(r"\[[^\]]*\]|[^.\[\]]+"), F.lit(0))
    sound = path.rlike(r"^(?:[^\[\]]|\[[^\]]*\])+$") & (F.size(steps) > 0)
    state = lambda found, v: F.struct(F.coalesce(found, F.lit(False)).alias("found"), v.alias("value"))

    def step(at: Column, s: Column) -> Column:
        v, inner = at["value"], F.substring(s, F.lit(2), F.length(s) - 2)
        own, items = _members(v), _items(v)
        name, want = F.substring_index(inner, "=", 1), F.substring(inner, F.instr(inner, "=") + 1, F.length(inner))
        hits = F.filter(items, lambda x: F.try_element_at(_members(x), name).try_cast("string") == want)
        index = inner.try_cast("int")
        by_key = state(at["found"] & F.map_contains_key(own, s), F.try_element_at(own, s))
        by_place = state(at["found"] & (index >= 0) & (index < F.size(items)), F.get(items, F.greatest(index, F.lit(0))))
        by_value = state(at["found"] & (F.size(hits) > 0), F.get(hits, F.lit(0)))
        return F.when(~s.startswith("["), by_key).when(F.instr(inner, "=") > 0, by_value).otherwise(by_place)

    led = F.aggregate(F.when(sound, steps).otherwise(F.array().cast("array<string>")), state(F.lit(True), record), step)
    ok = F.coalesce(sound, F.lit(False)) & led["found"]
    return F.struct(ok.alias("found"), F.when(ok, led["value"]).alias("value"))


def _text(v: Column, key: str) -> Column:
    """A member's text, null where there is none."""
    return F.try_variant_get(v, f"$['{key}']", "string") if PLAIN.fullmatch(key) else F.try_element_at(_members(v), F.lit(key)).try_cast("string")


def led(record: Column, path: str) -> Column:
    """What a path that is known beforehand leads to, as resolve() has it: a variant, null (not a stored null) where it leads nowhere.

    Its keys and places are one path of variant_get, so no member that it doesn't name is opened.
    """
    steps = re.findall(r"\[[^\]]*\]|[^.\[\]]+", path)
    nowhere = F.when(F.lit(False), record)
    if not steps or not re.fullmatch(r"(?:[^\[\]]|\[[^\]]*\])+", path):
        return nowhere
    v, at = record, "$"
    for s in steps:
        inner = s[1:-1]
        if not s.startswith("["):
            if PLAIN.fullmatch(s):
                at += f"['{s}']"
            else:
                v, at = F.try_element_at(F.try_variant_get(v, at, "map<string,variant>"), F.lit(s)), "$"
        elif "=" in inner:
            name, want = inner.split("=", 1)
            v, at = F.get(F.filter(F.try_variant_get(v, at, "array<variant>"), lambda x: _text(x, name) == want), F.lit(0)), "$"  # noqa: B023
        elif re.fullmatch(r"\s*\+?\d+\s*", inner, re.ASCII) and int(inner) < 1 << 31:
            at += f"[{int(inner)}]"
        else:
            return nowhere
    return v if at == "$" else F.try_variant_get(v, at, "variant")


def unlike(rows: DataFrame, known: Iterable[str] = ()) -> DataFrame:
    """The rows (record, path, value as text) whose value isn't what their path leads to in their record, with found and source, which is that.

    Paths told in known are led to by expressions of their own, others step by step.
    """
    j = rows.withColumn("_k", F.coalesce(*[F.when(F.col("path") == p, i) for i, p in enumerate(known)], F.lit(-1)))
    other = F.when(F.col("_k") < 0, resolve(F.col("record"), F.col("path")))
    j = j.withColumns({"_r": other, "_v": F.coalesce(*[F.when(F.col("_k") == i, led(F.col("record"), p)) for i, p in enumerate(known)], F.lit(None).cast("variant"))})
    v = F.coalesce("_v", "_r.value")
    found = F.when(F.col("_k") < 0, F.col("_r.found")).otherwise(F.col("_v").isNotNull())
    own, number = v.try_cast("string"), v.try_cast("double")
    same = (own == F.col("value")) | (number == F.col("value").try_cast("double")) | (own.isNull() & F.col("value").isNull())
    return j.withColumns({"found": found, "source": own}).where(~(F.col("found") & F.coalesce(same, F.lit(False)))).drop("_k", "_r", "_v")


def underived(nodes: DataFrame, records: DataFrame, key: str, known: Iterable[str] = ()) -> DataFrame:
    """The nodes (key, path, value as text) whose value isn't what their path leads to in the record of their key, with that."""
    j = nodes.join(records.select(key, "record"), key, "left")
    return unlike(j, known).select(*nodes.columns, "found", "source")


def _nodes(records: DataFrame, keys: list[str]) -> DataFrame:
    """Every object, list and scalar of the records with its path, its ancestors' paths and its kind."""
    level, out = records.where("record is not null").select(*keys, F.lit("$").alias("path"), F.array().cast("array<string>").alias("above"), F.col("record").alias("value")), None
    while True:
        level = cut(level, "nodes")
        if not level.limit(1).count():
            return level if out is None else out
        out = level if out is None else out.unionByName(level)
        path, v = F.col("path"), F.col("value")
        members = F.transform(F.map_entries(_members(v)), lambda e: F.struct(F.concat(path, F.lit("."), e["key"]).alias("path"), e["value"].alias("value")))
        items = F.transform(_items(v), lambda x, i: F.struct(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")).alias("path"), x.alias("value")))
        level = level.select(*keys, F.explode(F.coalesce(members, items)).alias("c"), F.concat("above", F.array("path")).alias("above")).select(*keys, "c.path", "above", "c.value")


def typed_diff(old: DataFrame, new: DataFrame, keys: list[str], allowed: list[str] | None = None) -> DataFrame:
    """keys, path and issue of each difference between two versions of records (keys, record).

    record_removed, record_added, key_removed, unexpected_new_key, type_changed
    (integers and fractions are one type), list_length_changed, list_order_changed
    (the same items in another order), value_changed.  What lies below a difference
    is not told again.  allowed: patterns of paths of keys that may be new.
    """
    kind = F.when(_members(F.col("value")).isNotNull(), "object").when(_items(F.col("value")).isNotNull(), "list")
    scalar = F.regexp_replace(F.regexp_extract(F.schema_of_variant("value"), r"^[A-Z]+", 0), "^(BIGINT|DECIMAL|DOUBLE|FLOAT)$", "NUMBER")
    texts = F.transform(_items(F.col("value")), lambda x: F.to_json(x))
    told = lambda df: _nodes(df, keys).select(*keys, "path", "above", F.struct(F.coalesce(kind, scalar).alias("kind"), F.size(_items(F.col("value"))).alias("size"), texts.alias("items"), F.when(kind.isNull(), F.to_json("value")).alias("text"), F.col("value").try_cast("double").alias("number")).alias("x"))
    j = told(old).withColumnsRenamed({"x": "a", "above": "above_a"}).join(told(new).withColumnsRenamed({"x": "b", "above": "above_b"}), [*keys, "path"], "full_outer")
    a, b, root = F.col("a"), F.col("b"), F.col("path") == "$"
    fine = F.lit(False)
    for p in allowed or []:
        fine = fine | F.col("path").rlike(p)
    same = F.when((a["kind"] == "NUMBER") & a["number"].isNotNull(), a["number"].eqNullSafe(b["number"])).otherwise(a["text"].eqNullSafe(b["text"]))
    issue = (
        F.when(b.isNull(), F.when(root, "record_removed").otherwise("key_removed"))
        .when(a.isNull(), F.when(root, "record_added").when(fine, "allowed").otherwise("unexpected_new_key"))
        .when(a["kind"] != b["kind"], "type_changed")
        .when((a["kind"] == "list") & (a["size"] != b["size"]), "list_length_changed")
        .when((a["kind"] == "list") & (a["items"] != b["items"]) & (F.array_sort(a["items"]) == F.array_sort(b["items"])), "list_order_changed")
        .when(~a["kind"].isin("object", "list") & ~same, "value_changed")
    )
    found = cut(j.select(*keys, "path", F.coalesce("above_a", "above_b").alias("above"), issue.alias("issue")).where("issue is not null"), "differences")
    below = found.select(*keys, "path", F.explode("above").alias("top")).join(found.select(*keys, F.col("path").alias("top")), [*keys, "top"], "left_semi").select(*keys, "path").distinct()
    return found.join(below, [*keys, "path"], "left_anti").where("issue <> 'allowed'").select(*keys, "path", "issue")
