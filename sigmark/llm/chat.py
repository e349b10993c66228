"""Chat formatting as a prefix tree of conversations.

A conversation is its turns in order of ``turn`` (nulls first; ties by role, then
text).  Conversations with equal first turns share a path of nodes; a node is
known by its depth and the exclusive or of the hashes of all (place, turn) up to
it, 128 bits, so prefixes are running aggregates.  The forest is laid out depth
first, and each shared turn's formatted text is emitted once.  A node has its
place in the layout, its length, the position id of its first code point (what
its ancestors take up), its loss span, and the intervals of its ancestors,
adjacent ones as one: what it may attend to besides itself.

A node belongs to the least conversation through it.  What belongs to a
conversation is a chain, laid out as one block, and hangs on a node of another
one's block; blocks follow their parent's, those that hang deeper first, which is
depth-first order with each chain ahead of its branches.  Ways from the root over
blocks are found by doubling, and offsets are prefix sums over range partitions.

The template is ``[INST] text [/INST]`` for user turns, `` text </s>`` for
assistant turns, and ``<<role>> text <</role>>`` for others; roles and texts
escape ``<``, ``>`` and ``[``, which all control strings have, and ``\\`` by a
backslash before them, which ``unescape`` takes back.  Loss is on assistant
texts.  Places and lengths are in code points.

Null role or text is empty.  Repeated turns are turns.  A conversation whose id
is null is left out.  Extra columns are ignored.

Turns are sorted in range partitions of (conv_id, turn), whose totals are joined
back, so one conversation with a third of all rows is no hot group; reading back
hashes each conversation as a stream.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut, release

# What opens and closes a turn, by role.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
ESCAPED = r"([\\<>\[])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"\\$1")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _mark(role: Column, side: int) -> Column:
    known = F.when(role == "user", MARKS["user"][side]).when(role == "assistant", MARKS["assistant"][side])
    other = F.concat(F.lit("<<"), escape(role), F.lit(">> ")) if side == 0 else F.concat(F.lit(" <</"), escape(role), F.lit(">>"))
    return known.otherwise(other)


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of a node's formatted text."""
    for role, (head, tail) in MARKS.items():
        if formatted.startswith(head) and formatted.endswith(tail):
            return role, unescape(formatted[len(head) : len(formatted) - len(tail)])
    role = re.match(r"<<((?:\\.|[^\\>])*)>> ", formatted, re.S)[1]
    return unescape(role), unescape(formatted[len(role) + 5 : len(formatted) - len(role) - 6])


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ahead(totals: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """For each partition of a key, aggregates over the key's earlier partitions: as many rows as partitions hold a key."""
    w = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", key, *[F.coalesce(f.over(w), F.lit(0)).alias(name) for name, f in sums.items()])


def turns(conversations: DataFrame) -> DataFrame:
    """One row a turn: conv_id, k (from 0), node, parent, formatted, length, loss_from, loss_to, position."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    body = escape(F.col("text"))
    rows = rows.select("*", F.concat(_mark(F.col("role"), 0), body, _mark(F.col("role"), 1)).alias("formatted"), F.length(_mark(F.col("role"), 0)).alias("head"), F.length(body).alias("body"))
    rows = rows.withColumn("length", F.length("formatted").cast("long"))
    ranged = cut(rows.repartitionByRange(_parts(rows), "conv_id", "turn").withColumn("part", F.spark_partition_id()), "chat-ranges")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    own = Window.partitionBy("part", "conv_id").orderBy(*order)
    count = ranged.groupBy("part", "conv_id").agg(F.count("*").alias("n"), F.sum("length").alias("size"))
    before = _ahead(count, "conv_id", {"k0": F.sum("n"), "p0": F.sum("size")})
    numbered = ranged.withColumn("k", F.row_number().over(own) - 1).join(before, ["part", "conv_id"]).withColumn("k", F.col("k") + F.col("k0"))
    numbered = cut(numbered.withColumns({"f": F.xxhash64("k", "role", "text"), "g": F.xxhash64(F.lit("second"), "k", "role", "text")}), "chat-numbered")
    xors = _ahead(numbered.groupBy("part", "conv_id").agg(F.bit_xor("f").alias("f"), F.bit_xor("g").alias("g")), "conv_id", {"f0": F.bit_xor("f"), "g0": F.bit_xor("g")})
    upto = Window.partitionBy("part", "conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = numbered.join(xors, ["part", "conv_id"])
    rows = rows.withColumns({"x": F.bit_xor("f").over(upto).bitwiseXOR(F.col("f0")), "y": F.bit_xor("g").over(upto).bitwiseXOR(F.col("g0")), "position": F.sum("length").over(upto) - F.col("length") + F.col("p0")})
    name = lambda k, x, y: F.concat_ws(":", k, x, y)
    node = name(F.col("k"), F.col("x"), F.col("y"))
    parent = F.when(F.col("k") > 0, name(F.col("k") - 1, F.col("x").bitwiseXOR(F.col("f")), F.col("y").bitwiseXOR(F.col("g"))))
    learn = F.col("role") == "assistant"
    return rows.select("conv_id", "k", node.alias("node"), parent.alias("parent"), "formatted", "length", F.when(learn, F.col("head")).alias("loss_from"), F.when(learn, F.col("head") + F.col("body")).alias("loss_to"), "position")


def forest(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes, each with the least conversation through it (lead), and the steps (conv_id, k, node) of each conversation."""
    rows = cut(turns(conversations), "chat-turns")
    rest = ["parent", "formatted", "length", "loss_from", "loss_to", "position"]
    nodes = rows.groupBy("node").agg(F.min("conv_id").alias("lead"), F.min("k").alias("depth"), *[F.first(c).alias(c) for c in rest])
    return cut(nodes, "chat-nodes"), rows.select("conv_id", "k", "node")


def blocks(nodes: DataFrame) -> DataFrame:
    """One row a conversation that nodes belong to: conv, size, start, the node it hangs on, and the way of blocks from the root."""
    own = nodes.groupBy(F.col("lead").alias("conv")).agg(F.sum("length").alias("size"), F.min_by(F.struct("depth", "parent", "position"), "depth").alias("s"))
    own = own.select("conv", "size", F.col("s.depth").alias("start"), F.col("s.parent").alias("hook"), F.col("s.position").alias("position"))
    above = nodes.select(F.col("node").alias("hook"), F.col("lead").alias("up"))
    step = F.array(F.struct((-F.col("start")).alias("deep"), F.col("conv").alias("conv")))
    way = cut(own.join(above, "hook", "left").select("conv", "size", "start", "hook", "position", "up", step.alias("way")), "chat-blocks")
    while way.where("up is not null").limit(1).count():
        higher = way.select(F.col("conv").alias("up"), F.col("up").alias("_up"), F.col("way").alias("_way"))
        joined = way.join(higher, "up", "left")
        longer = joined.select("conv", "size", "start", "hook", "position", F.col("_up").alias("up"), F.when(F.col("_way").isNull(), F.col("way")).otherwise(F.concat("_way", "way")).alias("way"))
        before, way = way, cut(longer, "chat-ways")
        release(before)
    return way


def layout(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, offset) of each block in the depth-first layout, and the blocks."""
    made = blocks(nodes)
    ranged = cut(made.repartitionByRange(_parts(made), "way").withColumn("part", F.spark_partition_id()), "chat-order")
    total = ranged.groupBy("part").agg(F.sum("size").alias("size")).withColumn("_one", F.lit(1))
    before = _ahead(total, "_one", {"before": F.sum("size")}).drop("_one")
    inside = Window.partitionBy("part").orderBy("way").rowsBetween(Window.unboundedPreceding, -1)
    offset = ranged.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(F.broadcast(before), "part")
    return cut(offset.select("conv", "position", (F.col("before") + F.col("inner")).alias("offset")), "chat-offsets"), made


def merged(spans: Column) -> Column:
    """Sorted intervals (from, to), adjacent ones as one."""
    kind = "array<struct<from:bigint,to:bigint>>"
    last = lambda acc: F.get(acc, F.size(acc) - 1)
    return F.aggregate(
        spans, F.array().cast(kind),
        lambda acc, s: F.when((F.size(acc) > 0) & (last(acc)["to"] == s["from"]),
                              F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["from"].alias("from"), s["to"].alias("to"))))).otherwise(F.concat(acc, F.array(s))),
    )


def format_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the forest, each emitted once, and the conversations as ways through it.

    Nodes: node, parent, depth, formatted, length, loss_from, loss_to, position,
    at (place in the layout) and ancestors (intervals of the layout).  Ways: one
    row a turn (conv_id, k, at).  A node attends to its own block before it, and
    to the parts of other blocks above the places where blocks hang.
    """
    nodes, steps = forest(conversations)
    offsets, made = layout(nodes)
    # within its block, a node lies as far from the start as positions say
    placed = nodes.join(offsets.select(F.col("conv").alias("lead"), "offset", F.col("position").alias("base")), "lead")
    placed = cut(placed.withColumn("at", F.col("offset") + F.col("position") - F.col("base")), "chat-layout")
    hooks = made.where("hook is not null").select("conv", F.col("hook").alias("node")).join(placed.select("node", F.col("offset").alias("from"), (F.col("at") + F.col("length")).alias("to")), "node").select("conv", "from", "to")
    ways = made.select(F.col("conv").alias("lead"), F.explode("way").alias("w")).select("lead", F.col("w.conv").alias("conv"))
    spans = ways.join(hooks, "conv").groupBy("lead").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("above"))
    none = F.array().cast("array<struct<from:bigint,to:bigint>>")
    out = placed.join(spans, "lead", "left").withColumn("above", F.coalesce("above", none))
    own = F.when(F.col("at") > F.col("offset"), F.array(F.struct(F.col("offset").alias("from"), F.col("at").alias("to")))).otherwise(none)
    out = out.withColumn("ancestors", merged(F.concat("above", own)))
    return out.select("node", "parent", "depth", "formatted", "length", "loss_from", "loss_to", "position", "at", "ancestors"), steps.join(placed.select("node", "at"), "node").select("conv_id", "k", "at")


def read_back(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Each conversation out of the emitted nodes: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    rows = ways.join(nodes.where("length > 0").select("at", "formatted", "loss_from", "loss_to"), "at")
    rows = rows.select("conv_id", "k", "formatted", "loss_from", "loss_to").repartition(_parts(ways), "conv_id").sortWithinPartitions("conv_id", "k")
    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Turns come in order; a conversation is done when another begins."""
        now, every, loss, n, size, count = None, sha256(), sha256(), 0, 0, 0
        for b in batches:
            out = []
            for conv, formatted, lo, hi in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to")), strict=True):
                if conv != now:
                    if count:
                        out.append((now, count, every.hexdigest(), n, loss.hexdigest(), size))
                    now, every, loss, n, size, count = conv, sha256(), sha256(), 0, 0, 0
                role, text = parse(formatted)
                every.update(f"{role}\n{text}\n".encode())
                size, count = size + len(formatted), count + 1
                if lo is not None:
                    learn = unescape(formatted[lo:hi])
                    loss.update(learn.encode())
                    n += len(learn)
            yield _table(out, kinds)
        if count:
            yield _table([(now, count, every.hexdigest(), n, loss.hexdigest(), size)], kinds)

    return rows.mapInArrow(each, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _table(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], names=list(kinds))
