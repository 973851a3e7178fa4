"""Spelling variants by asymmetric q-chunks.

Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), lower-cased in
A-Z only.  Two words are near if one edit (a code point inserted, deleted or
replaced) makes one the other.

The join is asymmetric.  The shorter word of a pair (of equal length, the
smaller one) gives two disjoint chunks, its halves; the other gives positional
grams of the chunks' lengths at all places within one of a chunk's.  One edit
leaves one of the two chunks as it is, at a place shifted by one at most, so
every near pair shares a key.  A half alone is shared by too many words: what
it leaves open is cut in two again, one edit leaves one of these parts too,
and a key is the chunk with that part.  A key whose chunks and grams would
make more than ``KEY_PAIRS`` pairs is cut further in the same way, down to one
open code point, where all words of a key are near each other: the work
follows the number of links, not the square of a group.  Pairs are verified by
edit distance, and each is found under one key.

A word's form is its near word of largest count (ties: smallest word) if that
is at least ``ratio`` times the word's own; its root is found by following
forms to the last, in a number of joins that grows with the logarithm of the
chain's length.

Defined results: a null or empty text has no words; a null id reads as an
empty one; repeated rows count as often as they stand; an empty table gives an
empty result; very long runs are words like others; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import grown, materialize, slices

MIN_LENGTH = 7
MIN_COUNT = 2
#: A form is at least so many times as frequent.
RATIO = 10
#: Every run whose hash this divides loses one code point; 0 for none.
DROP_EVERY = 31
#: Pairs of one key that are verified one by one; a key with more is cut further.
KEY_PAIRS = 4_000_000
#: Different words that one task counts before it passes its sums on.
COUNTER_WORDS = 400_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def changed(run: str, start: int, drop_every: int) -> str:
    """``run`` as it is counted; ``start`` is the checksum of what stands
    before the run in its hash."""
    h = zlib.crc32(run.encode(), start)
    if drop_every and h % drop_every == 0:
        at = h % len(run)
        return run[:at] + run[at + 1:]
    return run


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_length: int = MIN_LENGTH, drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, n) of all words of at least ``min_length`` code points."""
    found = regex.compile(f"[a-zÀ-ÿ]{{{max(1, min_length)},}}").findall

    def run(batches):
        counts = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()),
                                               pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in slices(batches):
            for own, text in zip(batch.column("own").to_pylist(), batch.column("body").to_pylist()):
                if not text:
                    continue
                start = zlib.crc32(f"{own or ''}:".encode())
                runs = Counter(found(text.translate(LOWER).decode("utf-8", "replace")))
                for word, n in runs.items():
                    word = changed(word, start, drop_every)
                    if len(word) >= min_length:
                        counts[word] += n
            if len(counts) > COUNTER_WORDS:
                yield out()
                counts.clear()
        if counts:
            yield out()

    read = docs.select(F.col(id_col).cast("string").alias("own"), F.col(text_col).cast("binary").alias("body"))
    return read.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _cut(rows: DataFrame) -> DataFrame:
    """Each row's open part [lo, hi) as its two halves, one row each: the
    other half then belongs to the key."""
    mid = F.expr("lo + cast((hi - lo + 1) div 2 as int)")
    return rows.withColumn("part", F.explode(F.array(F.struct(mid.alias("lo"), F.col("hi")),
                                                     F.struct(F.col("lo"), mid.alias("hi"))))
                           ).withColumn("lo", F.col("part.lo")).withColumn("hi", F.col("part.hi")).drop("part")


def _key(word: str, length: str) -> Column:
    """All of the chunk side's word but its open part; on the gram side, what
    stands at the same places from the front and from the end."""
    return F.concat_ws("|", F.col(length).cast("string"), F.expr(f"substring({word}, 1, lo)"),
                       F.expr(f"substring({word}, hi + 1 + char_length({word}) - {length})"))


def _chunks(words: DataFrame) -> DataFrame:
    size = F.char_length("word")
    return words.select("word", "n", size.alias("size"), F.lit(0).alias("lo"), size.alias("hi"))


def _grams(words: DataFrame, min_length: int) -> DataFrame:
    """A word once for each length of words that it may be a partner of."""
    size = F.explode(F.array(F.char_length("word"), F.char_length("word") - 1))
    return (words.select("word", "n", size.alias("size")).filter(F.col("size") >= min_length)
            .select("word", "n", "size", F.lit(0).alias("lo"), F.col("size").alias("hi")))


def _verified(chunks: DataFrame, grams: DataFrame) -> DataFrame:
    a = chunks.select("key", "hi", "size", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = grams.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    longer = F.char_length("b") > F.col("size")
    # Where the open part may begin later, the key of a later part has the pair.
    own = ~longer | (F.col("hi") == F.col("size")) | F.expr("substring(a, 1, hi) <> substring(b, 1, hi)")
    return (a.join(grown(b), "key")
            .filter((longer | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1) & own)
            .select("a", "a_n", "b", "b_n"))


def near_pairs(words: DataFrame, min_length: int = MIN_LENGTH, key_pairs: int = KEY_PAIRS) -> DataFrame:
    """(a, a_n, b, b_n) of all near pairs of a written table (word, n) of
    different words, each pair once.

    ``min_length`` is the shortest word's length, 2 at least."""
    def keyed(rows):
        return rows.withColumn("key", _key("word", "size"))

    chunks, grams = (keyed(_cut(_cut(rows))) for rows in (_chunks(words), _grams(words, min_length)))
    found = None
    while True:
        # A key's hash is enough to count: a collision cuts a key further than needed.
        sides = (chunks.filter("hi - lo > 1").select(F.xxhash64("key").alias("hash"), F.lit(1).alias("c"), F.lit(0).alias("g"))
                 .unionAll(grams.filter("hi - lo > 1").select(F.xxhash64("key").alias("hash"), F.lit(0), F.lit(1))))
        large = materialize(sides.groupBy("hash").agg(F.sum("c").alias("c"), F.sum("g").alias("g"))
                            .filter(F.col("c").cast("double") * F.col("g") > key_pairs).select("hash"), "large-keys")
        if large.isEmpty():
            rest = _verified(chunks, grams)
            return rest if found is None else found.unionAll(rest)

        def with_hash(rows, kind):
            return rows.withColumn("hash", F.xxhash64("key")).join(large, "hash", kind).drop("hash")

        small = materialize(_verified(with_hash(chunks, "left_anti"), with_hash(grams, "left_anti")), "near-pairs")
        found = small if found is None else found.unionAll(small)
        chunks, grams = (materialize(keyed(_cut(with_hash(rows, "left_semi").filter("hi - lo > 1").drop("key"))), "cut-keys")
                         for rows in (chunks, grams))


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n) of all words."""
    links = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionAll(
        pairs.select("b", "a", "a_n"))
    best = links.groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    is_form = -F.col("best.less") >= ratio * F.col("n")
    return words.join(grown(best), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))


def with_roots(found: DataFrame) -> DataFrame:
    """The written table of ``forms`` with ``root``.  Counts grow along a
    chain, so it ends; each round doubles the steps taken."""
    up = materialize(found.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = materialize(up.join(grown(further), "root", "left")
                         .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                         "roots")
        if up.filter("moved").isEmpty():
            break
        up = up.drop("moved")
    return found.join(grown(up.drop("moved")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO,
                      drop_every: int = DROP_EVERY, key_pairs: int = KEY_PAIRS) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row a word."""
    words = materialize(count_words(docs, id_col, text_col, min_length, drop_every)
                        .filter(F.col("n") >= min_count), "words")
    found = materialize(forms(words, near_pairs(words, min_length, key_pairs), ratio), "forms")
    return with_roots(found).select("word", "form", "root", "n", "n_near", "form_n")
