"""Best-fit packing planned on a histogram of lengths.

Documents become ids (with an end id) and pieces of at most ``capacity`` ids.
Only the number of pieces of each length, at most ``capacity`` counts, goes to
the driver.  There best-fit decreasing runs over counts: all pieces of a
length are placed at once, into groups of sequences with equal room, the
tightest group first.  The plan is a list of runs: ranks r0, r0+1, ... of a
length take so many places a sequence, in sequences from s0 on, at one
offset.  Each piece then takes the slot of its rank within its length.

The plan's size depends on ``capacity`` alone, not on the number of pieces.
Ranks within a length are found on two levels (a salt from the piece's hash,
then offsets over the salts' counts), so that a length shared by a third of
all pieces isn't ranked in one task.

Defined results: a null text is empty and becomes the end id alone; repeated
rows are pieces like others; a null id is kept; an empty table gives an empty
result.  ``start``, ``piece``, ``offset`` count from 0.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, materialize, text_slices
from .tokens import encoder, word_tokenizer_path

CAPACITY = 4096
END_ID = 1
#: Cached words and bytes of text at once, where other stages' workers are
#: alive beside a task's own.
LEAN_WORDS, LEAN_BYTES = 200_000, 2_000_000
#: Salts that share out the pieces of a length, for each shuffle partition.
SALTS_PER_PARTITION = 4


def pieces_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
              capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, lean: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document.  ``lean``
    takes less memory for more time: a small cache of words, short slices, and
    nothing kept between tasks."""
    file = path or word_tokenizer_path()
    fields = [docs.schema[id_col], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids

    def run(batches):
        own = encoder(file, LEAN_WORDS) if lean else encoder(file)
        end = np.array([end_id], dtype="<u4")
        for batch in text_slices(batches, "_text", LEAN_BYTES if lean else SLICE_BYTES):
            flat, ends = own.encode_column(batch.column("_text"))
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            begin = 0
            for i, stop in enumerate(ends.tolist()):
                # the end id follows the text's; it may open a piece of its own
                for k, at in enumerate(range(begin, stop + 1, capacity)):
                    part = flat[at:min(at + capacity, stop)]
                    if len(part) < capacity and at + capacity > stop:
                        part = np.concatenate((part, end))
                    row.append(i)
                    piece.append(k)
                    start.append(at - begin)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        kept.append(part.astype(np.int32))
                begin = stop
            cols = [batch.column(id_col).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if keep_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])
        if lean:
            own.trim()

    return (docs.select(id_col, F.col(text_col).alias("_text"))
            .mapInArrow(run, T.StructType(fields)))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts.  Runs (length, r0, s0, each, offset):
    rank r of the length, from r0 up to the next run, stands in sequence
    s0 + (r - r0) // each at offset + (r - r0) % each * length.  Second: the
    number of sequences."""
    groups: dict[int, list[tuple[int, int]]] = {}      # room -> (first sequence, sequences)
    rooms: list[int] = []                              # rooms with a group, ascending
    runs, sequences = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
                each = room // length
            else:
                room, each = capacity, capacity // length
                first, n = sequences, -(-left // each)
                sequences += n
            used = min(n, -(-left // each))
            put(room, first + used, n - used)                      # untouched ones keep their room
            runs.append((length, rank, first, each, capacity - room))
            placed = min(left, used * each)
            full, rest = divmod(placed, each)
            put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            left, rank = left - placed, rank + placed
    return runs, sequences


def ranked(pieces: DataFrame, ties: list[str], salts: int) -> DataFrame:
    """``pieces`` with _rank, 0 up to n-1 within each length."""
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*ties), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_salt").orderBy(*ties)
    return (salted.withColumn("_in", F.row_number().over(inside) - 1)
            .join(offsets, ["length", "_salt"])
            .withColumn("_rank", F.col("_before") + F.col("_in")).drop("_salt", "_in", "_before"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
         capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, lean: bool = False) -> DataFrame:
    """The pieces with their sequence_id and offset; ``lean`` as in ``pieces_of``."""
    spark = docs.sparkSession
    pieces = materialize(pieces_of(docs, id_col, text_col, path, capacity, end_id, keep_ids, lean), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*")).collect()}      # capacity rows at most
    runs, _ = plan(counts, capacity)
    runs = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(runs)        # bounded by the plan, not by the pieces
    salts = SALTS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ties = [c for c in (id_col, "piece", "start", "ids_crc32")]
    placed = ranked(pieces, ties, max(64, salts))
    out = [c for c in pieces.columns]
    schema = T.StructType([pieces.schema[c] for c in out] + [
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        plan_runs = shared.value
        # ranks stay below 2**45, lengths below 2**17
        starts = (plan_runs[:, 0] << 45) + plan_runs[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            _, r0, s0, each, offset = plan_runs[np.searchsorted(starts, (length << 45) + rank, side="right") - 1].T
            k = rank - r0
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in out] + [pa.array(s0 + k // each), pa.array(offset + k % each * length)],
                names=out + ["sequence_id", "offset"])

    return placed.select(*out, "_rank").mapInArrow(run, schema)
