"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are split into ``blocks`` runs of bits.  Two that differ in at
most ``max_bits`` bits agree on at least ``blocks - max_bits`` whole blocks,
so each fingerprint is dealt out once for every choice of that many blocks,
and fingerprints are joined where all chosen blocks agree; then the Hamming
distance is verified.  With 7 blocks and 4 bits there are 35 keys of 27 bits,
so that 10 billion different fingerprints meet about 75 others by chance in a
key, and the comparisons stay in proportion to the rows.

Only different fingerprints take part (copies are one row before any join).
Rows of a key are sorted together and compared as they stream by; the result
is a spanning forest of the links of each key, never all pairs.  A key with
more than ``run_rows`` fingerprints is compared in chunks of that size, chunk
against chunk in tasks of their own, so that memory is bounded and no link
is lost.  Components of the links give one class a document.

Defined results: a null or empty text, or one without words, has fingerprint
zero; repeated rows share a class; a row without an id keeps its fingerprint
and gets the class of its equals and all they link to, or null if no row with
an id is among them; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, grown, materialize, slices, texts_of
from .components import connected_components

SHINGLE_WORDS = 4
MAX_BITS = 4
BLOCKS = 7
SEED = 42
#: Fingerprints of one key that are compared with each other in one go.
RUN_ROWS = 8192


def fingerprint(text: str, size: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(flat, seed)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[a:b], seed)
                       for a, b in zip(starts[:len(words) - size + 1].tolist(), (ends[size - 1:] - 1).tolist())],
                      dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):     # bounded scratch for long texts
        counts += np.unpackbits(hashes[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1,
                                bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 size: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit integer."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            fp = np.array([fingerprint(t, size, seed) for t in texts_of(batch, "_text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
            .mapInArrow(run, f"id {kind}, fp bigint"))


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """For every choice of ``blocks - max_bits`` blocks, the mask of its bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, blocks - max_bits)]


def _forest(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges (by index) of a spanning forest of the links among ``fp``: a
    breadth-first walk that compares each reached row with the rows not yet
    reached."""
    edges, left = [], np.arange(len(fp))
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            near = np.bitwise_count(fp[left] ^ fp[i]) <= max_bits
            if near.any():
                got = left[near].tolist()
                edges += [(i, j) for j in got]
                todo += got
                left = left[~near]
    return edges


def _links(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs linking rows of equal key (rows sorted by key): small runs
    by comparing each row with the next, the one after that and so on; large
    ones by the walk."""
    n = len(key)
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, n))
    run_end = np.repeat(starts + sizes, sizes)
    small = np.repeat(sizes <= 64, sizes)
    a_out, b_out = [], []
    at = np.flatnonzero(small)
    for step in range(1, 64):
        at = at[at + step < run_end[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= max_bits]
        a_out.append(near)
        b_out.append(near + step)
    for s, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
        edges = _forest(fp[s:s + size], max_bits)
        if edges:
            e = np.array(edges) + s
            a_out.append(e[:, 0])
            b_out.append(e[:, 1])
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(a_out) if a_out else empty), (np.concatenate(b_out) if b_out else empty)


def links(distinct: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS,
          run_rows: int = RUN_ROWS) -> DataFrame:
    """(src, dst) node pairs at ``max_bits`` or fewer differing bits, enough of
    them to connect every such pair; ``distinct``: (node bigint, fp bigint),
    one row a fingerprint."""
    masks = block_masks(blocks, max_bits)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).cast("short").alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits"))
                     for i, m in enumerate(signed)])
    dealt = (distinct.select("node", "fp", F.explode(keys).alias("k"))
             .select("node", "fp", F.xxhash64("k.choice", "k.bits").alias("key")))
    # A hash of (choice, bits) stands for it: if two meet, rows of both are
    # compared, and the distance alone decides.
    dealt = dealt.repartition("key").sortWithinPartitions("key", "fp")

    def run(batches):
        """Links inside chunks of a key; and, of a key with several chunks, all
        its rows with their chunk number, for the tasks between chunks."""
        held, chunk, open_key = [], 0, None

        def out(node, fp, key, a, b):
            rows = {"src": pa.array(node[a]), "dst": pa.array(node[b]),
                    "key": pa.nulls(len(a), pa.int64()), "chunk": pa.nulls(len(a), pa.int32()),
                    "fp": pa.nulls(len(a), pa.int64())}
            return pa.RecordBatch.from_pydict(rows)

        def parts(node, fp, key, number):
            rows = {"src": pa.array(node), "dst": pa.nulls(len(node), pa.int64()), "key": pa.array(key),
                    "chunk": pa.array(np.full(len(node), number, dtype=np.int32)), "fp": pa.array(fp)}
            return pa.RecordBatch.from_pydict(rows)

        for batch in list_last(batches):
            if batch is not None:
                new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "fp", "key")]
                held = [np.concatenate(x) for x in zip(held, new)] if held else new
            while held and len(held[0]):
                node, fp, key = held
                if batch is not None:
                    done = int(np.searchsorted(key, key[-1]))    # the last run may go on in the next batch
                    full = len(key) - done >= run_rows
                    if not done and not full:
                        break
                else:
                    done, full = len(key), False
                if done:
                    sizes_end = int(np.searchsorted(key, key[0], side="right"))
                    if open_key is not None and key[0] == open_key:
                        # the rest of a key that was cut before
                        done = min(sizes_end, run_rows)
                        chunk += 1
                        yield parts(node[:done], fp[:done], key[:done], chunk)
                        a, b = _links(key[:done], fp[:done].view(np.uint64), max_bits)
                        yield out(node, fp, key, a, b)
                    elif sizes_end > run_rows:
                        open_key, chunk, done = key[0], 0, run_rows
                        yield parts(node[:done], fp[:done], key[:done], chunk)
                        a, b = _links(key[:done], fp[:done].view(np.uint64), max_bits)
                        yield out(node, fp, key, a, b)
                    else:
                        # whole runs up to the first that is too long
                        starts = np.flatnonzero(np.append(True, key[1:done] != key[:done - 1]))
                        sizes = np.diff(np.append(starts, done))
                        long = np.flatnonzero(sizes > run_rows)
                        if len(long):
                            done = int(starts[long[0]])
                        a, b = _links(key[:done], fp[:done].view(np.uint64), max_bits)
                        yield out(node, fp, key, a, b)
                    held = [x[done:] for x in held]
                else:
                    # one run fills all that is held: cut a chunk off
                    if open_key is None or key[0] != open_key:
                        open_key, chunk = key[0], -1
                    chunk += 1
                    yield parts(node[:run_rows], fp[:run_rows], key[:run_rows], chunk)
                    a, b = _links(key[:run_rows], fp[:run_rows].view(np.uint64), max_bits)
                    yield out(node, fp, key, a, b)
                    held = [x[run_rows:] for x in held]

    found = materialize(dealt.mapInArrow(run, "src bigint, dst bigint, key bigint, chunk int, fp bigint"), "links")
    inside = found.filter("dst is not null").select("src", "dst")
    cut = found.filter("chunk is not null").select(F.col("src").alias("node"), "fp", "key", "chunk")
    if cut.isEmpty():
        return inside
    # Every chunk of a cut key against every later one: a row goes to each pair
    # of chunks that its own is in.
    last = cut.groupBy("key").agg(F.max("chunk").alias("last"))
    pairs = (cut.join(last, "key")
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
             .filter("other <> chunk")
             .select("node", "fp", F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other"))
                     .alias("key"))
             .repartition("key").sortWithinPartitions("key", "fp"))

    def between(batches):
        held = []
        for batch in list_last(batches):
            if batch is not None:
                new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "fp", "key")]
                held = [np.concatenate(x) for x in zip(held, new)] if held else new
            if not held:
                continue
            node, fp, key = held
            done = int(np.searchsorted(key, key[-1])) if batch is not None else len(key)
            if done:
                a, b = _links(key[:done], fp[:done].view(np.uint64), max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["src", "dst"])
                held = [x[done:] for x in held]

    return inside.unionByName(pairs.mapInArrow(between, "src bigint, dst bigint"))


def list_last(batches):
    """The batches, then None."""
    yield from batches
    yield None


def classes(nodes: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS,
            run_rows: int = RUN_ROWS) -> tuple[DataFrame, DataFrame]:
    """((fp, root), (root, first)) of a written table (fp, first), one row a
    fingerprint: root is the smallest fingerprint reachable over links, and
    ``first`` the smallest of its class, nulls aside."""
    edges = materialize(links(nodes.select(F.col("fp").alias("node"), "fp"), max_bits, blocks, run_rows), "edges")
    comps = connected_components(edges).withColumnRenamed("node", "fp")
    rooted = materialize(nodes.join(grown(comps), "fp", "left")
                         .select("fp", F.coalesce("component", "fp").alias("root"), "first"), "roots")
    heads = materialize(rooted.groupBy("root").agg(F.min("first").alias("first")), "heads")
    return rooted.select("fp", "root"), heads


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, blocks: int = BLOCKS,
                    seed: int = SEED, run_rows: int = RUN_ROWS) -> DataFrame:
    """(id, fingerprint, component_id) of every row: the class of documents
    reachable over links of ``max_bits`` or fewer differing bits, named by its
    smallest id.  Ids are integers."""
    fps = materialize(fingerprints(docs, id_col, text_col, size, seed), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min(F.col("id").cast("bigint")).alias("first")), "nodes")
    members, heads = classes(nodes, max_bits, blocks, run_rows)
    named = materialize(members.join(grown(heads), "root").select("fp", F.col("first").alias("component_id")), "classes")
    return (fps.join(grown(named), "fp", "left")
            .select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    "component_id"))


def one_a_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS,
                max_bits: int = MAX_BITS, blocks: int = BLOCKS, seed: int = SEED,
                run_rows: int = RUN_ROWS) -> DataFrame:
    """``docs`` with one row of each class: of the smallest id (rows without
    one come last), then the smallest fingerprint, then the smallest hash of
    the text.  Only rows of one class replace each other, whatever their ids."""
    row = free_name(docs, "row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")     # fixes the numbers
    fps = fingerprints(rows.select(row, text_col), row, text_col, size, seed)
    fps = materialize(fps.withColumnRenamed("id", "row"), "fingerprints")
    keys = rows.select(F.col(row).alias("row"), F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("hash"))
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "fp", "hash", "row")
    nodes = materialize(fps.join(grown(keys), "row").groupBy("fp").agg(F.min(first).alias("first")), "nodes")
    _, heads = classes(nodes, max_bits, blocks, run_rows)
    return rows.join(grown(heads.select(F.col("first.row").alias(row))), row, "left_semi").select(*docs.columns)
