"""Token ids in grammar-compressed binary shards (Re-Pair).

Documents become ids (with an end id) in ascending order of their key and are
written in shards of about ``SHARD_IDS`` ids.  Within a shard, frequent
neighbouring pairs of ids are replaced again and again by new symbols: each
round counts all pairs exactly, takes the most frequent ones that don't
interfere, and replaces every occurrence at once, until no pair occurs
``MIN_COUNT`` times.  A shard row holds the rules, the length of each rule's expansion and
the final symbol sequence, so that any range of ids is decoded by a search in
the summed lengths and an expansion of only the symbols it meets.

File format: Parquet, one row a shard, written by Spark, so that it goes to
any store that Spark reaches and survives lost executors (a task that is run
again writes its own file again):

  first_key, first_hash   where the partition begins (orders the partitions)
  seq                     number of the shard in its partition
  part_offset             ids before the shard in its partition
  n_ids                   ids in the shard
  keys, lengths           of its documents, in order
  base                    symbols below are ids; base + i is rule i
  rules                   little-endian u4 pairs (left, right)
  expansions              little-endian u4 ids in rule i's expansion
  symbols, width          the sequence, little-endian u2 or u4

Work runs in two shuffles: texts go to key ranges once, and reading back joins
one small row a partition.  A row larger than a shard is a shard of its own;
no other unit has to fit in memory.

Defined results: a null text is empty and becomes the end id alone; repeated
keys and rows follow each other (by a hash of the text); null keys come first;
an empty table gives empty files and an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_path, slices, text_slices
from .tokens import encoder, word_tokenizer_path

END_ID = 1
SHARD_IDS = 1 << 20
#: Rounds at most (None: until no pair occurs MIN_COUNT times); new rules a round.
ROUNDS = None
RULES_A_ROUND = 2048
MIN_COUNT = 8

SHARD = T.StructType([
    T.StructField("first_key", T.LongType()), T.StructField("first_hash", T.LongType()),
    T.StructField("seq", T.IntegerType()), T.StructField("part_offset", T.LongType()),
    T.StructField("n_ids", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())),
    T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("base", T.IntegerType()),
    T.StructField("rules", T.BinaryType()), T.StructField("expansions", T.BinaryType()),
    T.StructField("symbols", T.BinaryType()), T.StructField("width", T.IntegerType())])


def _pairs(seq: np.ndarray, n_symbols: int, live: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(codes of the pairs at the live places (None: all), occurrences of each that don't
    overlap, their places by code, places left out as they overlap)."""
    if live is None:
        at, left, right = np.arange(len(seq) - 1), seq[:-1], seq[1:]
    else:
        at = np.flatnonzero(live[:-1])
        left, right = seq[at], seq[at + 1]
    # In a run of one symbol every second occurrence overlaps.
    same = np.flatnonzero(left == right)
    fresh = np.append(True, at[same[1:]] != at[same[:-1]] + 1)[:len(same)]
    place_in_run = np.arange(len(same)) - np.maximum.accumulate(np.where(fresh, np.arange(len(same)), 0))
    over = same[place_in_run % 2 == 1]
    left_out = at[over]
    if len(over):
        at, left, right = np.delete(at, over), np.delete(left, over), np.delete(right, over)
    bits = n_symbols.bit_length()
    code = left.astype(np.int64)
    code <<= bits
    code |= right
    low = len(seq).bit_length()
    if 2 * bits + low <= 63:
        # code and place in one number: a plain sort brings both in order
        code <<= low
        code |= at
        code.sort()
        np.bitwise_and(code, (1 << low) - 1, out=at)
        code >>= low
    else:
        order = np.argsort(code, kind="stable")
        code, at = code[order], at[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])[:len(code)])
    return code[first], np.diff(np.append(first, len(code))), at, left_out


def compress(ids: np.ndarray, base: int, rounds: int | None = ROUNDS, rules_a_round: int = RULES_A_ROUND,
             min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules (n, 2), expansions) of an id sequence; ids < base."""
    seq = ids.astype(np.int32)
    lefts, rights = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    sizes = np.ones(base, dtype=np.int64)
    # A pair below min_count gains no occurrence but next to a new symbol, so
    # its places rest until one stands there; the end is found on all places.
    live, done = None, 0
    while len(seq) > 1 and (rounds is None or done < rounds):
        n_symbols = base + len(lefts)
        bits = n_symbols.bit_length()
        codes, counts, at, left_out = _pairs(seq, n_symbols, live)
        # what is left of a pair that has a rule takes its symbol
        ruled = (lefts << bits) | rights
        spot = np.searchsorted(codes, ruled)
        met = np.flatnonzero(spot < len(codes))
        met = met[codes[spot[met]] == ruled[met]]
        symbol = np.full(len(codes), -1, dtype=np.int32)
        symbol[spot[met]] = base + met
        known = symbol >= 0
        wanted = (counts >= min_count) | known
        best = np.flatnonzero(wanted)
        if not len(best):
            if live is None:
                break
            live = None
            continue
        at = at[np.repeat(wanted, counts)]
        live = np.zeros(len(seq), dtype=bool)
        live[at], live[left_out] = True, True
        best = best[np.argsort(-counts[best], kind="stable")][:rules_a_round]
        # the place of a pair among the best ones, most frequent first
        place = np.full(len(codes), len(best), dtype=np.int64)
        place[best] = np.arange(len(best))
        got = np.repeat(place[wanted], counts[wanted])
        taken = got < len(best)
        low = len(best).bit_length()
        by_place = np.sort((at[taken] << low) | got[taken])
        at, got = by_place >> low, by_place & ((1 << low) - 1)
        # Where different pairs overlap the more frequent one wins; the other
        # waits for the next round.
        rank = got * len(seq) + at
        keep = np.ones(len(at), dtype=bool)
        touch = np.flatnonzero(at[1:] == at[:-1] + 1)
        left_wins = rank[touch] < rank[touch + 1]
        keep[touch[left_wins] + 1] = False
        keep[touch[~left_wins]] = False
        at, got = at[keep], got[keep]
        # A rule must pay for itself; the most frequent pair loses no place.
        used = np.bincount(got, minlength=len(best))
        real = np.flatnonzero((used >= min_count) & ~known[best])
        number = symbol[best]
        number[real] = n_symbols + np.arange(len(real), dtype=np.int32)
        new = number[got]
        at, new = at[new >= 0], new[new >= 0]
        left, right = codes[best[real]] >> bits, codes[best[real]] & ((1 << bits) - 1)
        lefts, rights = np.concatenate((lefts, left)), np.concatenate((rights, right))
        sizes = np.concatenate((sizes, sizes[left] + sizes[right]))
        seq[at] = new
        live[at] = True
        live[at[at > 0] - 1] = True
        stay = np.ones(len(seq), dtype=bool)
        stay[at + 1] = False
        seq, live = seq[stay], live[stay]
        done += 1
    return seq, np.column_stack((lefts, rights)).astype("<u4"), sizes[base:].astype("<u4")


def _sizes(symbols: np.ndarray, base: int, expansions: np.ndarray) -> np.ndarray:
    out = np.ones(len(symbols), dtype=np.int64)
    rule = symbols >= base
    out[rule] = expansions[symbols[rule] - base]
    return out


def _rule_texts(base: int, rules: np.ndarray, expansions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rules' expansions one after another, where each begins).
    Rules only use earlier symbols, so their sides are copied from before."""
    ends = np.cumsum(expansions, dtype=np.int64)
    starts = ends - expansions
    flat = np.empty(int(ends[-1]) if len(ends) else 0, dtype="<u4")
    two = np.flatnonzero(expansions == 2)
    flat[starts[two]], flat[starts[two] + 1] = rules[two, 0], rules[two, 1]
    rest = np.flatnonzero(expansions > 2)
    for (left, right), at, stop in zip(rules[rest].tolist(), starts[rest].tolist(), ends[rest].tolist()):
        if left < base:
            flat[at] = left
            mid = at + 1
        else:
            mid = at + int(expansions[left - base])
            flat[at:mid] = flat[starts[left - base]:ends[left - base]]
        if right < base:
            flat[mid] = right
        else:
            flat[mid:stop] = flat[starts[right - base]:ends[right - base]]
    return flat, starts


def _expand(symbols: np.ndarray, base: int, rules: np.ndarray, expansions: np.ndarray) -> np.ndarray:
    """All ids of a symbol sequence: each symbol's ids are a stretch of one
    table, the ids themselves first and the rules' expansions after them."""
    flat, starts = _rule_texts(base, rules, expansions)
    source = np.concatenate((np.arange(base, dtype="<u4"), flat))
    begin = np.concatenate((np.arange(base, dtype=np.int32), (starts + base).astype(np.int32)))
    size = np.concatenate((np.ones(base, dtype=np.int32), expansions.astype(np.int32)))[symbols]
    ends = np.cumsum(size, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total + len(source) < 2 ** 31 else np.int64
    place = np.repeat((begin[symbols] - (ends - size)).astype(kind), size)
    place += np.arange(total, dtype=kind)
    return source[place]


def read_symbols(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    symbols = np.frombuffer(row["symbols"], dtype=f"<u{row['width']}").astype(np.int32)
    rules = np.frombuffer(row["rules"], dtype="<u4").reshape(-1, 2)
    return symbols, rules, np.frombuffer(row["expansions"], dtype="<u4")


def decode(row: dict) -> np.ndarray:
    """All ids of a shard."""
    symbols, rules, expansions = read_symbols(row)
    return _expand(symbols, row["base"], rules, expansions)


def decode_range(row: dict, start: int, stop: int) -> np.ndarray:
    """Ids [start, stop) of a shard, expanding only the symbols in reach."""
    symbols, rules, expansions = read_symbols(row)
    ends = np.cumsum(_sizes(symbols, row["base"], expansions))
    a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
    if stop <= start or a >= len(symbols):
        return np.zeros(0, dtype="<u4")
    first = int(ends[a - 1]) if a else 0
    return _expand(symbols[a:b], row["base"], rules, expansions)[start - first:stop - first]


def write_shards(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text",
                 path: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS,
                 rounds: int | None = ROUNDS) -> None:
    """Encode ``docs`` and write the shard files to ``out``."""
    file = path or word_tokenizer_path()

    def run(batches):
        own = encoder(file)
        base = own.tokenizer.get_vocab_size(with_added_tokens=True)
        end = np.array([end_id], dtype="<u4")
        first, seq, offset = None, 0, 0
        keys, lengths, parts, held = [], [], [], 0

        def shard():
            ids = np.concatenate(parts)
            symbols, rules, expansions = compress(ids, base, rounds)
            width = 2 if base + len(rules) <= 1 << 16 else 4
            return pa.RecordBatch.from_pylist([{
                "first_key": first[0], "first_hash": first[1], "seq": seq, "part_offset": offset,
                "n_ids": len(ids), "keys": keys, "lengths": lengths, "base": base, "rules": rules.tobytes(),
                "expansions": expansions.tobytes(), "symbols": symbols.astype(f"<u{width}").tobytes(),
                "width": width}], schema=arrow)

        arrow = pa.schema([
            ("first_key", pa.int64()), ("first_hash", pa.int64()), ("seq", pa.int32()), ("part_offset", pa.int64()),
            ("n_ids", pa.int64()), ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())),
            ("base", pa.int32()), ("rules", pa.binary()), ("expansions", pa.binary()), ("symbols", pa.binary()),
            ("width", pa.int32())])
        for batch in text_slices(batches, "text"):
            new_keys = batch.column("key").to_pylist()
            if first is None:
                first = (new_keys[0], batch.column("hash")[0].as_py())
            flat, ends = own.encode_column(batch.column("text"))
            begin = 0
            for key, stop in zip(new_keys, ends.tolist()):
                keys.append(key)
                lengths.append(stop - begin + 1)
                parts += [flat[begin:stop], end]
                held += stop - begin + 1
                begin = stop
                if held >= shard_ids:
                    yield shard()
                    seq, offset = seq + 1, offset + held
                    keys, lengths, parts, held = [], [], [], 0
        if held:
            yield shard()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.select(F.col(id_col).cast("bigint").alias("key"), F.xxhash64(text).alias("hash"), text.alias("text"))
    (named.repartitionByRange("key", "hash").sortWithinPartitions("key", "hash")
     .mapInArrow(run, SHARD).write.parquet(out))


def read_documents(spark: SparkSession, out: str, keep_ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of every document in the shard
    files; start counts the ids of all documents before it."""
    files = spark.read.schema(SHARD).parquet(out)
    # one row a partition; partitions are ordered by where they begin
    parts = files.groupBy("first_key", "first_hash").agg(F.sum("n_ids").alias("n"))
    order = Window.orderBy(F.col("first_key").asc_nulls_first(), "first_hash").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = parts.select("first_key", "first_hash", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base_ids"))
    schema = "first_key bigint, first_hash bigint, key bigint, in_part bigint, n_tokens bigint, ids_crc32 bigint"
    names = ["first_key", "first_hash", "key", "in_part", "n_tokens", "ids_crc32"]
    if keep_ids:
        schema, names = schema + ", ids array<int>", names + ["ids"]

    def run(batches):
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            ids, lengths = decode(row), np.array(row["lengths"], dtype=np.int64)
            ends = np.cumsum(lengths)
            cuts = list(zip((ends - lengths).tolist(), ends.tolist()))
            n = len(cuts)
            cols = [pa.array([row["first_key"]] * n, pa.int64()), pa.array([row["first_hash"]] * n, pa.int64()),
                    pa.array(row["keys"], pa.int64()), pa.array(row["part_offset"] + ends - lengths),
                    pa.array(lengths), pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in cuts], pa.int64())]
            if keep_ids:
                cols.append(pa.array([ids[a:b].astype(np.int32) for a, b in cuts], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    found = files.mapInArrow(run, schema)
    return (found.join(bases, found["first_key"].eqNullSafe(bases["first_key"])
                       & (found["first_hash"] == bases["first_hash"]))
            .select("key", (F.col("base_ids") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32",
                    *(["ids"] if keep_ids else [])))


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str | None = None,
                **options) -> DataFrame:
    """Write the shards and read all documents back from them."""
    out = out or shared_path(docs.sparkSession, "token-shards")
    write_shards(docs, out, id_col, text_col, **options)
    return read_documents(docs.sparkSession, out).withColumnRenamed("key", id_col)
