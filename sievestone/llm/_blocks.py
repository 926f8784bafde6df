"""Blocks of rows, and sorted hash arrays cut into ranges, by which blocks ask and are
answered about what they share with all others.

A block is a few megabytes of rows, packed. It sends what it asks about as one array
for each range of the hash; the range sees the arrays of all blocks, and answers each
in the order it asked. So a key that is frequent everywhere is one entry of each block.

A sender has FAN cells at most. Where more ranges are needed, the cells of a range
from FAN senders or so are merged, and the merged ones are the senders of the next
level, which cuts the range further; answers come back the same way. So the number of
cells grows with that of blocks, times the levels, and not with its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import _U64, drop_staged, pack, stage, text_buffer, unpack

#: Most cells of a sender for each kind of key.
FAN = 256


def make_blocks(block_bytes: int):
    """For mapInArrow: rows whose first column is the text -> block (id), rows (packed), of
    block_bytes of text or one row more. No row leaves its partition for this."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                piece = batch.slice(k, 64)
                held.append(piece)
                size += len(text_buffer(piece.column(0))[0])
                if size >= block_bytes:
                    yield _block(part, seq, held)
                    seq, held, size = seq + 1, [], 0
        if held:
            yield _block(part, seq, held)

    return run


def _block(part: int, seq: int, pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.Table.from_batches(pieces).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, whole.schema) as out:
        out.write_table(whole)
    return pa.RecordBatch.from_arrays([pa.array([part * 2**31 + seq], pa.int64()), pa.array([pack(sink.getvalue().to_pybytes())], pa.binary())], ["block", "rows"])


def range_of(hashes: np.ndarray, parts: int, within: int = 0, whole: int = 1) -> np.ndarray:
    """Where each of the parts' ranges of the hash begins in the sorted hashes, which lie
    in range `within` of `whole` ranges."""
    bounds = np.array([((within * parts + p) << 64) // (parts * whole) for p in range(parts)], dtype=object).astype(np.uint64)
    return np.append(np.searchsorted(hashes, bounds), len(hashes))


def exchange(cells: DataFrame, senders: int, parts: int, fan: int, merge, give, final, whole: int = 1, dropped: list | None = None) -> DataFrame:
    """Answers (sender, part, answer, ...) of final to the cells (sender, part, ...).

    Cells are cut into min(parts, fan) ranges; part is the range's number plus that of
    ranges times the number of the kind of key. final(table) answers the cells of one part.
    If parts are more than fan, merge(cells, sub, ranges) makes of the cells of a range its
    own cells of `sub` ranges, and give(cells, answers, sub, ranges) hands these cells'
    answers to their senders. Rows of sender null, from final, are handed through.
    dropped: tables that may be removed when the answers were written are added to it."""
    here = min(parts, fan)
    ranges = here * whole
    kinds = "sender long, part int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema.fields[2:])
    if parts <= fan:
        return cells.groupBy("part").applyInArrow(final[0], final[1])
    below, groups = -(-parts // fan), max(1, -(-senders // fan))
    sub = min(below, fan)
    cells = stage(cells.withColumn("node", F.col("part") * F.lit(groups).cast("long") + F.pmod(F.xxhash64("sender"), F.lit(groups))), "cells")
    if dropped is not None:
        dropped.append(cells)
    up = cells.groupBy("node").applyInArrow(lambda t: merge(t, sub, ranges), kinds)
    answers = stage(exchange(up, groups, below, fan, merge, give, final, ranges, dropped), "answers")
    if dropped is not None:
        dropped.append(answers)
    other = answers.filter("sender is null")
    told = answers.filter("sender is not null").withColumnRenamed("sender", "node").select("node", "part", "answer")
    back = cells.groupBy("node").cogroup(told.groupBy("node")).applyInArrow(lambda t, a: give(t, a, sub, ranges), "sender long, part int, answer binary")
    return back.unionByName(other, allowMissingColumns=True).select(*answers.columns)


def merge_keys(cells: pa.Table, sub: int, ranges: int) -> pa.Table:
    """Of cells (keys, n) of one range: its distinct keys with their sums, in sub ranges."""
    part = cells.column("part")[0].as_py()
    found, total, _ = add_up(cells)
    cut = range_of(found, sub, part % ranges, ranges)
    return pa.table({
        "sender": pa.array([cells.column("node")[0].as_py()] * sub, pa.int64()), "part": pa.array([part * sub + j for j in range(sub)], pa.int32()),
        "keys": pa.array([pack_hashes(found[cut[j] : cut[j + 1]]) for j in range(sub)], pa.binary()), "n": pa.array([pack_counts(total[cut[j] : cut[j + 1]]) for j in range(sub)], pa.binary()),
    })


def give_keys(unpack_answer):
    """Hands answers for the distinct keys of a range, of which unpack_answer(bytes, keys) makes
    an array, to the cells that asked; pack_answer is the other way."""
    unpack_one, pack_one = unpack_answer

    def give(cells: pa.Table, answers: pa.Table, sub: int, ranges: int) -> pa.Table:
        found, _, at = add_up(cells)
        part = cells.column("part")[0].as_py()
        cut = range_of(found, sub, part % ranges, ranges)
        by = dict(zip(answers.column("part").to_pylist(), answers.column("answer").to_pylist(), strict=True))
        told = np.concatenate([unpack_one(by[part * sub + j], int(cut[j + 1] - cut[j])) for j in range(sub)])
        return pa.table({"sender": cells.column("sender"), "part": cells.column("part"), "answer": pa.array([pack_one(told[x]) for x in at], pa.binary())})

    return give


def add_up(cells: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of cells (keys, n), their sums, and where each cell's keys are among them."""
    hashes = [unpack_hashes(x) for x in cells.column("keys").to_pylist()]
    counts = [unpack_counts(x) for x in cells.column("n").to_pylist()]
    found, at = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return found, total, np.split(at, np.cumsum([len(h) for h in hashes])[:-1])


def pack_counts(n: np.ndarray) -> bytes:
    """Counts as 32-bit values, byte planes apart, or as 64-bit ones."""
    return pack(n.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()) if len(n) == 0 or n.max() < 2**32 else b"L" + pack(n.astype(np.uint64).tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    if data[:1] == b"L":
        return np.frombuffer(unpack(data[1:]), np.uint64).astype(np.int64)
    raw = np.frombuffer(unpack(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view(np.uint32).ravel().astype(np.int64)


def pack_hashes(h: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte planes apart: the high planes are mostly zero."""
    gaps = np.diff(h, prepend=_U64(0))
    return pack(gaps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_hashes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(unpack(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(np.uint64).ravel(), dtype=np.uint64)


def open_block(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(unpack(rows)).read_all().combine_chunks()
