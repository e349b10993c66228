"""Packing of token pieces into sequences by hierarchical best fit.

Each task tokenizes its documents and packs their pieces best-fit decreasing.
Bins that are nearly full are done.  The others go up a tree: in each round some
neighbouring tasks' bins meet as items of one best-fit round.  After a best-fit
round at most one bin is half empty, and two bins that are more than half full
never fit together, so all that a node can save is to put the half-empty bins of
its children, FAN at most, into others.  For each of those the emptiest of the
other bins does whenever any does, so handing on the emptiest ones, CARRY of them
and far more than FAN, loses no sequence; the others are done as they are.

Null or empty text is one token, the end mark.  Repeated rows are packed one by
one, since each is data.  Extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import cut

END = 0
#: Free places up to which a bin counts as full; bins a tree node hands on; tasks that meet in one node; pieces packed at a time.
SLACK, CARRY, FAN, BLOCK = 16, 4096, 8, 200_000


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> uint32 ids, as tokenizers gives them for the byte-level BPE of path, with special strings as ordinary text."""
    import tiktoken
    from tokenizers import Tokenizer

    import public_tokenizers

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    special = {t.content for t in slow.get_added_tokens_decoder().values()}
    ranks = {bytes(byte[c] for c in w): i for w, i in vocab.items() if w not in special}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        try:
            return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
        except ValueError:  # its pattern engine gives up on some very long runs
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones but for the first."""
    first = n % size or size
    return [(0, first), *((a, size) for a in range(first, n, size))]


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest first into the tightest bin that takes it; and the bins' fill."""
    bins, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_at: list[list[int]] = [[] for _ in range(size + 1)]
    mask, fill = 0, []
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = open_at[free].pop()
            if not open_at[free]:
                mask ^= 1 << free
        else:
            b, free = len(fill), size
            fill.append(0)
        bins[i], offset[i] = b, fill[b]
        fill[b] += n
        if free > n:
            open_at[free - n].append(b)
            mask |= 1 << (free - n)
    return bins, offset, np.array(fill, np.int64)


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with_ids: and ids, its tokens as little-endian uint32."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long" + ", ids binary" * with_ids

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, made = encoder(tokenizer), TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal made
            bins, offset, fill = best_fit(np.array([r[3] for r in rows], np.int64), size)
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            out = {"doc_id": pa.array(cols[0], pa.int64()), "piece": pa.array(cols[1], pa.int32()), "start": pa.array(cols[2], pa.int64()), "length": pa.array(cols[3], pa.int64()), "ids_crc32": pa.array(cols[4], pa.int64()), "bin": pa.array(bins + made), "offset": pa.array(offset), "fill": pa.array(fill[bins] if rows else bins)}
            if with_ids:
                out["ids"] = pa.array(cols[5], pa.binary())
            made += len(fill)
            rows.clear()
            return pa.RecordBatch.from_pydict(out)

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.append(encode(t or ""), np.uint32(END)).astype("<u4")
                for k, (a, n) in enumerate(cuts(len(ids), size)):
                    raw = ids[a : a + n].tobytes()
                    rows.append((i, k, a, n, zlib.crc32(raw), raw if with_ids else None))
            if len(rows) >= BLOCK:
                yield flush()
        yield flush()

    pieces = cut(docs.select("doc_id", "text").mapInArrow(local, schema), "pieces")
    items = pieces.where(F.col("fill") < size - SLACK).select("bin", "fill").distinct()
    items = cut(items.select("bin", "fill", F.col("bin").alias("root"), F.lit(0).cast("long").alias("base")), "pack-items")
    width = (items.agg(F.max(F.shiftright("bin", 32))).first()[0] or 0) + 1

    def join(key: tuple, group: pa.Table) -> pa.Table:
        """One node: pack the bins that came up; open: the node above may use the bin."""
        group = group.sort_by("bin")
        n, ids = np.asarray(group.column("fill")), np.asarray(group.column("bin"))
        bins, offset, fill = best_fit(n, size)
        leader = np.zeros(len(fill), np.int64)
        leader[bins[::-1]] = ids[::-1]
        may = np.flatnonzero(fill < size - SLACK)
        go = np.zeros(len(fill), bool)
        go[may[np.argsort(fill[may], kind="stable")[:CARRY]]] = True
        return pa.table({"bin": ids, "to": leader[bins], "by": offset, "total": fill[bins], "open": go[bins]})

    live, share = items.select("bin", "fill"), FAN
    while True:
        # a bin's number holds its first task's, and so its node on every level
        step = cut(live.groupBy((F.shiftright("bin", 32) / share).cast("long").alias("node")).applyInArrow(join, "bin long, to long, by long, total long, open boolean"), "pack-step")
        moved = step.select(F.col("bin").alias("root"), "to", "by")
        items = cut(items.join(moved, "root", "left").select("bin", F.coalesce("to", "root").alias("root"), (F.col("base") + F.coalesce("by", F.lit(0))).alias("base")), "pack-items")
        if share >= width:
            break
        live, share = step.where("open").select(F.col("to").alias("bin"), F.col("total").alias("fill")).distinct(), share * FAN
    out = pieces.join(items, "bin", "left")
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("root", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")]
    return out.select(*cols, *(["ids"] if with_ids else []))
