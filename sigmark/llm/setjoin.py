"""An exact, distributed similarity self-join of hash sets, in regions.

Two sets link when their Jaccard similarity reaches t (a fraction, so the test
is on integers).  All members have one global order, rare ones first; any order
gives right results, so the order may come from a bounded table of counts.

* A set that loses more than n - ceil(t n) members can't link, so a set meets
  all its partners in the regions of its first n - ceil(t n) + 1 members.
* Entries (member, set) are packed by the tasks that make them, one row for
  each bucket of members, and shuffled once.  A bucket's task sorts its entries
  by member and size and compares small regions whole: sizes, the place of the
  shared member and 64 parity bits bound what can be shared, and whatever passes
  is verified on whole sets.  Entries of members that the counts know as hot are
  dealt to buckets by set, so no bucket holds a hot region.
* Larger regions go on as rows.  A region is split by rings of set size, the
  distance to the empty set; a set visits the ring above its own.
* In a large region's ring the sets with the least ids are pivots and are
  compared with the others, first one, then PIVOTS of them.  A pair is needed only while
  it may tell something new: for components, while the two sets are in different
  ones; to know whether a set has an earlier partner, while it has none yet.  So a
  large group of near copies is settled by its pivots, and what is left of it is
  compared with the rest, in pairs of blocks, by the triangle inequality of
  Jaccard distance: 1024 parity bits bound the distance from below.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .cut import cut, release, small
from .text import U, mix, slices, spread

#: Buckets of the table of counts: 2 MB whatever the input.
BUCKETS = 1 << 18
PART = 1 << 13
#: Regions of at most so many sets are compared whole.
FEW = 8
#: Candidate pairs that a set of a region may have on average; a region with more is compared with pivots.
DENSE = 4
#: Pivots of a larger region in a round after the first.
PIVOTS = 4
#: Sets of a block of a region that pivots don't settle.
BLOCK = 1024
#: Sets of a block that are compared with another block at a time.
SOME = 64
#: Entries of a bucket on average, count above which a member is hot, pairs that are looked at together.
ENTRIES, HOT, PAIRS = 1 << 18, 1 << 16, 1 << 20
#: Parity bits by which candidate pairs are told apart before their sets are sent.
WIDE = 1024
PACKED = "bucket int, ids binary, n binary, pos binary, sig binary, key binary"
COUNTS = "part int, counts binary"


class Counts:
    """How often members fall into each bucket of a bounded table, as far as one task has seen."""

    def __init__(self, buckets: int = BUCKETS) -> None:
        self.total = np.zeros(buckets, np.int64)

    def add(self, members: np.ndarray) -> None:
        self.total += np.bincount((members & U(len(self.total) - 1)).astype(np.int64), minlength=len(self.total))

    def rows(self) -> dict[str, list]:
        parts = self.total.reshape(-1, PART)
        seen = np.flatnonzero(parts.any(1))
        return {"part": seen.astype(np.int32), "counts": [parts[i].astype(np.uint32 if parts[i].max() < 1 << 32 else np.uint64).tobytes() for i in seen]}


def summed(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The tasks' counts (part, counts), added up by Spark; 8 bytes a bucket reach the driver."""

    def add(key: tuple, group: pa.Table) -> pa.Table:
        total = np.zeros(PART, np.int64)
        for x in group.column("counts"):
            raw = x.as_buffer()
            total += np.frombuffer(raw, np.uint32 if raw.size == 4 * PART else np.uint64).astype(np.int64)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("part").applyInArrow(add, COUNTS).collect():
        out[r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.counts, np.int64)
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """A small class of rarity for each bucket: the bit length of its count over the usual count."""
    usual = max(1, int(np.median(counts)))
    return np.minimum(63, np.ceil(2 * np.log2(np.maximum(1.0, counts / usual)))).astype(np.uint8)


def least_overlap(n: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    """ceil(t n)"""
    return -(-n * t[0] // t[1])


def prefix(members: np.ndarray, order: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    """The first n - ceil(t n) + 1 members, rare ones first."""
    n = len(members)
    k = n - int(least_overlap(np.int64(n), t)) + 1 if n else 0
    if not k:
        return members[:0]
    rare = order[(members & U(BUCKETS - 1)).astype(np.int64)]
    if rare.any():
        return members[np.lexsort((members, rare))[:k]]
    return members[:k] if n == k else members[np.argpartition(members, k)[:k]][np.argsort(members[np.argpartition(members, k)[:k]])]


def verified(pairs: DataFrame) -> DataFrame:
    """Pairs with the sorted members of both sets, as binaries a_set and b_set; gives their common count."""
    keep = [f for f in pairs.schema.fields if f.name not in ("a_set", "b_set")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("a_set"), b.column("b_set")
            common = np.zeros(b.num_rows, np.int64)
            for i in range(b.num_rows):
                p, q = np.frombuffer(x[i].as_buffer(), U), np.frombuffer(y[i].as_buffer(), U)
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), max(0, len(q) - 1))
                common[i] = int((q[at] == p).sum()) if len(q) else 0
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in keep], pa.array(common)], names=[*[f.name for f in keep], "common"])

    return pairs.mapInArrow(each, StructType([*keep]).add("common", LongType()))


def signature(members: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 parity bits of each set, whose bounds are at: a member that only one of two sets has can change one bit at most."""
    if len(at) < 2:
        return np.zeros(0, np.int64)
    bit = np.left_shift(U(1), mix(members) >> U(58))
    out = np.zeros(len(at) - 1, U)
    full = at[1:] > at[:-1]
    if full.any():
        out[full] = np.bitwise_xor.reduceat(bit, at[:-1][full])
    return out.view(np.int64)


def could(t: tuple[int, int]) -> Column:
    """May sets a and b link, as far as their sizes, the places of the shared member and the signatures tell?"""
    left = F.least(F.col("an") - F.col("apos"), F.col("bn") - F.col("bpos"))
    both = F.col("an") + F.col("bn")
    return (left * (t[0] + t[1]) >= both * t[0]) & (F.least("an", "bn") * t[1] >= F.greatest("an", "bn") * t[0]) & (F.bit_count(F.col("asig").bitwiseXOR(F.col("bsig"))) * (t[0] + t[1]) <= both * (t[1] - t[0]))


def _side(rows: DataFrame, x: str) -> DataFrame:
    return rows.select("key", "ring", *[F.col(c).alias(f"{x}{'' if c == 'id' else c}") for c in ("id", "n", "pos", "sig")])


def entries(ids: np.ndarray, n: np.ndarray, sig: np.ndarray, of: np.ndarray, key: np.ndarray, pos: np.ndarray, hot: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Entries of a chunk's sets, packed for each bucket: ids, n and sig are those of the sets, of the set of each entry."""
    to = (mix(key ^ U(0x27D4EB2F165667C5)) % U(buckets)).astype(np.int64)
    if hot.any():  # dealt by set; the sign of pos says so
        to[hot] = (mix(np.flatnonzero(hot).astype(U) + sig.view(U)[of[hot]]) % U(buckets)).astype(np.int64)
        pos = np.where(hot, -1 - pos, pos)
    by = np.argsort(to, kind="stable")
    at = np.searchsorted(to[by], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(at))
    cols = [x[by] for x in (ids[of], n[of].astype(np.int32), pos.astype(np.int32), sig[of], key)]
    made = [pa.array([x[at[k] : at[k + 1]].tobytes() for k in full], pa.binary()) for x in cols]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *made], names=["bucket", "ids", "n", "pos", "sig", "key"])


def _ids_arrow(ids: np.ndarray) -> pa.Array:
    if ids.dtype.names is None:
        return pa.array(ids)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(ids[f])) for f in ids.dtype.names], names=list(ids.dtype.names))


def _order(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of pairs of different ids, the lesser id first."""
    if ids.dtype.names is None:
        less, other = ids[x] < ids[y], ids[x] != ids[y]
    else:
        p, q = ids.dtype.names
        less = (ids[p][x] < ids[p][y]) | (ids[p][x] == ids[p][y]) & (ids[q][x] < ids[q][y])
        other = ids[x] != ids[y]
    return np.where(less, x, y)[other], np.where(less, y, x)[other]


def first_split(packed: DataFrame, id_type: np.dtype, kind: str, t: tuple[int, int], few: int) -> DataFrame:
    """Of packed entries: pairs (a, an, b, bn) that may link of regions of at most few sets, and the entries (key, id, n, pos, sig) of others."""
    schema = f"a {kind}, an int, b {kind}, bn int, key long, id {kind}, n int, pos int, sig long"
    names = ["a", "an", "b", "bn", "key", "id", "n", "pos", "sig"]

    def read(group: pa.Table, c: str, dtype: object) -> np.ndarray:
        return np.concatenate([np.zeros(0, dtype), *(np.frombuffer(x.as_buffer(), dtype) for x in group.column(c))])

    def compare(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        ids, n, pos, sig, key = (read(group, *c) for c in (("ids", id_type), ("n", np.int32), ("pos", np.int32), ("sig", U), ("key", U)))
        del group
        by = np.argsort(key, kind="stable")
        by = by[np.lexsort((n[by], key[by]))] if len(by) else by
        ids, n, pos, sig, key = (x[by] for x in (ids, n, pos, sig, key))
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(key)))
        big = size > few
        if len(head):
            big |= np.minimum.reduceat(pos, head) < 0
        code = np.repeat(np.arange(len(head), dtype=np.int64), size)
        pos = np.where(pos < 0, -1 - pos, pos)

        def rows(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(x), 1 << 16):
                y = x[a : a + (1 << 16)]
                none = [pa.nulls(len(y), k) for k in (_ids_arrow(ids[:0]).type, pa.int32()) * 2]
                yield pa.RecordBatch.from_arrays([*none, pa.array(key[y].view(np.int64)), _ids_arrow(ids[y]), pa.array(n[y]), pa.array(pos[y]), pa.array(sig[y].view(np.int64))], names=names)

        yield from rows(np.flatnonzero(big[code]))
        # partners of an entry follow it in its region, up to the size that may still link
        end = np.repeat(head + size, size)
        n64, left = n.astype(np.int64), (n - pos).astype(np.int64)
        far = np.minimum(end, np.searchsorted(code * (1 << 32) + n64, code * (1 << 32) + n64 * t[1] // t[0], "right"))
        own = np.arange(len(key))
        far = np.where(big[code], own + 1, far)
        work = np.add.reduceat(far - own - 1, head) if len(head) else head
        for part in slices(work, PAIRS):
            some = slice(head[part.start], head[part.stop - 1] + size[part.stop - 1])
            row, y = spread(own[some] + 1, far[some])
            x = own[some][row]
            both = n64[x] + n64[y]
            ok = np.minimum(left[x], left[y]) * (t[0] + t[1]) >= both * t[0]
            x, y, both = x[ok], y[ok], both[ok]
            ok = np.bitwise_count(sig[x] ^ sig[y]).astype(np.int64) * (t[0] + t[1]) <= both * (t[1] - t[0])
            x, y = _order(ids, x[ok], y[ok])
            # a region most of whose pairs may link is a group of near copies, and goes on to pivots
            dense = np.bincount(code[x], minlength=len(head)) > DENSE * size
            x, y = x[~dense[code[x]]], y[~dense[code[x]]]
            yield from rows(np.flatnonzero(dense[code[some]]) + some.start)
            none = [pa.nulls(len(x), k) for k in (pa.int64(), _ids_arrow(ids[:0]).type, pa.int32(), pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays([_ids_arrow(ids[x]), pa.array(n[x]), _ids_arrow(ids[y]), pa.array(n[y]), *none], names=names)

    return packed.groupBy("bucket").applyInArrow(compare, schema)


def region_links(first: DataFrame, sets_of: Callable[[DataFrame], DataFrame], t: tuple[int, int], name: str, few: int = FEW, wide: bool = False, earlier: bool = False, width: int = WIDE) -> DataFrame:
    """Links (a, b), a before b: enough to connect whatever the sets' full join would, or with earlier to give each set an earlier partner if it has any.

    first: what first_split gives, as a table.  sets_of(ids) gives (id, members) of
    the asked ids: their sorted 64-bit members in one binary.
    """
    # rings of sizes: partners differ by one ring at most, so a set visits the ring above its own
    ring = F.floor(F.log("n") / (math.log(t[1] / t[0]) * (1 + 1e-9))).cast("int")
    large = first.where("key is not null").select("key", F.explode(F.array(ring, ring + 1)).alias("ring"), "id", "n", "pos", "sig")
    live = cut(_sized(large), f"{name}-rings")
    near = first.where("key is null").select("a", "an", "b", "bn").unionByName(_near(live, few, t))
    many, links = live.where(F.col("m") > few).withColumn("label", F.col("id")), None
    # a set's component; or, with earlier, a partner if it is known to have one
    labels = lambda x: components(links, x) if not earlier else links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("least"))
    side = lambda x: many.select("key", "ring", *[F.col(c).alias(f"{x}{'' if c == 'id' else c}") for c in ("id", "n", "pos", "sig", "label")])
    new = F.col("alabel") != F.col("blabel") if not earlier else F.col("blabel") == F.col("b")
    for step in range(3):
        if step == 0:
            far = many.select("key", "ring", *[F.col(f"pivot.{c}").alias(f"a{'' if c == 'id' else c}") for c in ("id", "n", "pos", "sig")], *[F.col(c).alias(f"b{'' if c == 'id' else c}") for c in ("id", "n", "pos", "sig")]).where(could(t) & (F.col("a") < F.col("b")))
        elif step == 1:  # the least ids of a region; each task sends on that many at most
            lead = Window.partitionBy("key", "ring").orderBy("a")
            pivots = side("a").withColumn("r", F.row_number().over(lead)).where(F.col("r") <= PIVOTS).drop("r")
            far = side("b").join(pivots, ["key", "ring"]).where(could(t) & new & (F.col("a") < F.col("b")))
        else:
            far = _blocks(many, sets_of, t, f"{name}{step}", width if wide else 0, earlier)
        far = far.select("a", "an", "b", "bn")
        pairs = cut((near.unionByName(far) if near else far).distinct(), f"{name}-pairs{step}")
        likely, near = pairs, None
        if wide:
            likely = cut(_both(pairs, _wide(sets_of(_ids(pairs, f"{name}-wide-ids{step}")), width)).mapInArrow(_agree(t), pairs.schema), f"{name}-likely{step}")
        # each set's first candidate is verified first, and of the others only those that may still tell something new
        tried = likely.groupBy("b").agg(F.min(F.struct("a", "an")).alias("x"), F.first("bn").alias("bn")).select("x.a", "x.an", "b", "bn")
        for turn in range(2):
            done = cut(verified(_both(tried, sets_of(_ids(tried, f"{name}-ids{step}{turn}")))).where(F.col("common") * (t[0] + t[1]) >= (F.col("an") + F.col("bn")) * t[0]).select("a", "b"), f"{name}-done{step}{turn}")
            links = done if links is None else links.unionByName(done)
            if turn == 0:
                label = links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("least"))
                if not earlier:  # two steps towards the least of a component: enough to leave out most pairs
                    label = label.join(label.select(F.col("id").alias("least"), F.col("least").alias("further")), "least", "left").select("id", F.coalesce("further", "least").alias("least"))
                label = cut(label, f"{name}-near{step}")
                known = lambda x: label.select(F.col("id").alias(x), F.col("least").alias(f"{x}label"))  # noqa: B023, E731
                rest = likely.join(known("a"), "a", "left").join(known("b"), "b", "left").withColumns({"alabel": F.coalesce("alabel", "a"), "blabel": F.coalesce("blabel", "b")})
                tried = cut(rest.where(new).select("a", "an", "b", "bn"), f"{name}-rest{step}")
                if not tried.limit(1).count():
                    break
        release(pairs, likely, tried)
        if step == 2:
            break
        # regions whose sets are all settled are done
        release(label)
        label = labels(f"{name}{step}")
        own = many.drop("label").join(label, "id", "left").withColumn("label", F.coalesce("least", "id")).drop("least")
        open_ = own.groupBy("key", "ring").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max((F.col("label") == F.col("id")).cast("int")).alias("free")).where("lo <> hi" if not earlier else "free = 1").select("key", "ring")
        before, live = live, cut(own.join(open_, ["key", "ring"]), f"{name}-open{step}")
        release(before)
        many = live
        if not live.limit(1).count():
            break
    release(live)
    return links.distinct()


def with_earlier(first: DataFrame, sets_of: Callable[[DataFrame], DataFrame], t: tuple[int, int], name: str, few: int = FEW) -> DataFrame:
    """The ids that link with a lesser one.  A set's first candidate is verified first, and the others only where it fails."""
    first = cut(first, f"{name}-regions")
    pairs = cut(first.where("key is null").select("a", "an", "b", "bn").distinct(), f"{name}-pairs")
    sets = cut(sets_of(_ids(pairs, f"{name}-ids")), f"{name}-sets")
    near = cut(_both(pairs, _wide(sets, WIDE // 4)).mapInArrow(_agree(t), pairs.schema), f"{name}-likely")
    release(pairs)
    out, tried = None, near.groupBy("b").agg(F.min(F.struct("a", "an")).alias("x"), F.first("bn").alias("bn")).select("x.a", "x.an", "b", "bn")
    for k in range(2):
        done = cut(verified(_both(tried, sets)).where(F.col("common") * (t[0] + t[1]) >= (F.col("an") + F.col("bn")) * t[0]).select(F.col("b").alias("id")).distinct(), f"{name}-done{k}")
        out = done if out is None else out.unionByName(done)
        tried = near.join(done.withColumnRenamed("id", "b"), "b", "left_anti")
    release(near, sets)
    if first.where("key is not null").limit(1).count():
        # the sets of large regions are asked for again and again
        asked = cut(first.where("key is not null").select("id").distinct(), f"{name}-large-ids")
        own = cut(sets_of(asked), f"{name}-large-sets")
        large = region_links(first.where("key is not null"), lambda ids: own.join(small(ids), "id", "left_semi"), t, name, FEW, wide=True, earlier=True, width=WIDE // 4)
        out = cut(out.unionByName(large.select(F.col("b").alias("id"))), f"{name}-earlier")
        release(asked, own)
    return out.distinct()


def _blocks(rows: DataFrame, sets_of: Callable[[DataFrame], DataFrame], t: tuple[int, int], name: str, wide: int, earlier: bool) -> DataFrame:
    """Pairs that are needed and may link of whole regions: sets are dealt to blocks by hash, and each two blocks of a region are compared by one task."""
    if wide:
        rows = rows.join(_wide(sets_of(cut(rows.select("id").distinct(), f"{name}-block-ids")), wide).withColumnRenamed("members", "bits"), "id")
    count = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = rows.withColumn("settled", F.col("label") != F.col("id")).withColumn("own", F.pmod(F.xxhash64("id"), count).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    rows = rows.select("key", "ring", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") <= F.col("other")).alias("one"), "id", "n", "pos", "sig", "settled", F.xxhash64("label").alias("group"), *["bits"] * bool(wide))
    kind = rows.schema["id"].dataType
    schema = StructType().add("a", kind).add("an", "integer").add("b", kind).add("bn", "integer")
    flags = lambda table, c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(bool)

    def compare(table: pa.Table) -> pa.Table:
        one, settled = flags(table, "one"), flags(table, "settled")
        n, pos, sig, group = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "pos", "sig", "group"))
        sig, left = sig.view(U), n - pos
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), U).reshape(len(n), -1) if wide and len(n) else None
        same = table.column("p")[0] == table.column("q")[0]
        mine, others = np.flatnonzero(one), np.flatnonzero(one if same else ~one)
        xs, ys = [], []
        for k in range(0, len(mine), SOME):
            x = mine[k : k + SOME, None]
            # the 64 bits turn most pairs away, in one table of some sets and all others
            ok = np.bitwise_count(sig[x] ^ sig[others]).astype(np.int64) * (t[0] + t[1]) <= (n[x] + n[others]) * (t[1] - t[0])
            x, y = np.nonzero(ok)
            x, y = mine[x + k], others[y]
            # of two sets that both have an earlier partner, or are in one component, there is nothing to learn
            new = ~(settled[y] & settled[x]) if earlier else group[y] != group[x]
            new &= np.minimum(left[x], left[y]) * (t[0] + t[1]) >= (n[x] + n[y]) * t[0]
            new &= np.minimum(n[x], n[y]) * t[1] >= np.maximum(n[x], n[y]) * t[0]
            if same:
                new &= x < y
            x, y = x[new], y[new]
            if wide:
                ok = np.bitwise_count(bits[x] ^ bits[y]).sum(1).astype(np.int64) * (t[0] + t[1]) <= (n[x] + n[y]) * (t[1] - t[0])
                x, y = x[ok], y[ok]
            xs.append(x)
            ys.append(y)
        x, y = (pa.array(np.concatenate([np.zeros(0, np.int64), *v])) for v in (xs, ys))
        ids, sizes = table.column("id"), table.column("n")
        return pa.table([ids.take(x), sizes.take(x), ids.take(y), sizes.take(y)], names=schema.names)

    pairs = rows.groupBy("key", "ring", "p", "q").applyInArrow(compare, schema).where("a <> b")
    turn = F.col("a") > F.col("b")
    return pairs.select(*[F.when(turn, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("an", "bn"), ("b", "a"), ("bn", "an"))])


def _ids(pairs: DataFrame, name: str) -> DataFrame:
    return cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), name)


def _both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    return pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("a_set")), "a").join(sets.select(F.col("id").alias("b"), F.col("members").alias("b_set")), "b")


def _wide(sets: DataFrame, width: int = WIDE) -> DataFrame:
    """(id, members) with that many parity bits, a power of two, in place of the members."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(([0], np.cumsum([x.as_buffer().size // 8 for x in b.column("members")]))).astype(np.int64)
            members = np.concatenate([np.zeros(0, U), *(np.frombuffer(x.as_buffer(), U) for x in b.column("members"))])
            place = np.repeat(np.arange(b.num_rows), np.diff(at)) * width + (mix(members) >> U(65 - width.bit_length())).astype(np.int64)
            odd = np.packbits((np.bincount(place, minlength=b.num_rows * width) & 1).astype(bool)).reshape(b.num_rows, width // 8)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.tobytes() for x in odd], pa.binary())], names=["id", "members"])

    return sets.mapInArrow(each, sets.schema)


def _agree(t: tuple[int, int]):
    """Pairs whose parity bits differ in no more places than linked sets of their sizes may have members apart."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("a_set", "b_set"))
            apart = np.bitwise_count(x ^ y).sum(1).astype(np.int64)
            both = np.asarray(b.column("an")).astype(np.int64) + np.asarray(b.column("bn"))
            keep = pa.array(np.flatnonzero(apart * (t[0] + t[1]) <= both * (t[1] - t[0])))
            yield pa.RecordBatch.from_arrays([b.column(c).take(keep) for c in ("a", "an", "b", "bn")], names=["a", "an", "b", "bn"])

    return each


def _sized(rows: DataFrame) -> DataFrame:
    """Regions of two sets or more, with their size m and their first set as pivot: counted before the shuffle, and joined back."""
    regions = rows.groupBy("key", "ring").agg(F.count("*").alias("m"), F.min(F.struct("id", "n", "pos", "sig")).alias("pivot")).where("m > 1")
    return rows.join(regions, ["key", "ring"])


def _near(rows: DataFrame, few: int, t: tuple[int, int]) -> DataFrame:
    """Pairs of the small regions that may link."""
    rows = rows.where(F.col("m") <= few)
    return _side(rows, "a").join(_side(rows, "b"), ["key", "ring"]).where((F.col("a") < F.col("b")) & could(t)).select("a", "an", "b", "bn")


def components(links: DataFrame, name: str) -> DataFrame:
    """(id, least): every linked id with the least id that it reaches; each round halves the paths."""
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least")).withColumnRenamed("a", "id"), f"{name}-labels")
    edges = cut(edges.distinct(), f"{name}-edges")
    for r in itertools.count():
        pull = edges.join(label.select(F.col("id").alias("b"), "least"), "b").groupBy("a").agg(F.min("least").alias("pulled"))
        step = label.join(pull.withColumnRenamed("a", "id"), "id").select("id", F.col("least").alias("old"), F.least("least", "pulled").alias("least"))
        jump = step.join(label.select(F.col("id").alias("least"), F.col("least").alias("further")), "least", "left")
        after = cut(jump.select("id", "old", F.least("least", F.coalesce("further", "least")).alias("least")), f"{name}-label{r}")
        release(label)
        label = after.select("id", "least")
        label.sigmark_path = after.sigmark_path
        if not after.where("old <> least").limit(1).count():
            return label


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(small(ids), "id", "left_anti")
