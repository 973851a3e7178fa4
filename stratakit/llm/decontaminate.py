"""Benchmark decontamination with a generalised suffix automaton.

The normalised items are put into one suffix automaton over words.  Training
words stream through it; at each word the automaton gives the longest run of
words ending there that occurs in some item.  Where that run reaches ``window``
words (or covers a whole shorter item), those words are hit, and the state
reached names the items that hold them.

The automaton grows with the benchmark only, never with the documents.  It is
built of at most ``max_words`` item words; a larger benchmark is split into
several automata of that size by item, each sent out and matched in turn, and
a document's hits are united afterwards.  Documents are read once an
automaton and never shuffled when one is enough.

Before the automaton runs, array operations leave only stretches of words
whose neighbouring pairs all occur in items and that are long enough to hold a
window; this changes no result.

Defined results: null and empty texts (of documents and items) have no words
and no hits; a document without words is not contaminated; an empty benchmark
hits nothing; repeated rows each get their result, repeated rows of the
benchmark add nothing; null item ids count for hits but are not listed; very
long texts are streamed whole, in time in proportion to their length; columns of other names pass through if
asked for, and one named like a result is replaced.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialize, slices, texts_of

WINDOW = 13
MIN_COVERAGE_PARTS = 20          # contaminated from 1/20 of the words on
#: Item words of one automaton (about 300 MB in a worker at most).
MAX_WORDS = 250_000
PAIR_SLOTS = 1 << 22

#: A-Z lower-cased; digits, a-z and everything beyond ASCII stay; the rest parts words.
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])


def normal_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_KEEP).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences: ``next`` transitions,
    suffix ``link`` and ``length`` of each state."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A copy of ``target`` for the shorter strings that ``state`` leads to."""
        copy = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state != -1 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def add(self, words: list[int]) -> list[int]:
        """Add one sequence; the states of its prefixes."""
        last, out = 0, []
        for word in words:
            target = self.next[last].get(word)
            if target is not None:
                last = target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
            else:
                new = self._new(self.length[last] + 1, 0, {})
                state = last
                while state != -1 and word not in self.next[state]:
                    self.next[state][word] = new
                    state = self.link[state]
                if state != -1:
                    target = self.next[state][word]
                    self.link[new] = (target if self.length[target] == self.length[state] + 1
                                      else self._split(state, word, target))
                last = new
            out.append(last)
        return out


class Matcher:
    """Finds windows of items in texts."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        auto = self.auto = SuffixAutomaton()
        coded = []
        for item_id, text in items:
            seq = [self.ids.setdefault(w, len(self.ids) + 1) for w in normal_words(text or "")]
            if seq:
                coded.append((item_id, seq))
        self.shortest = min([window, *(len(seq) for _, seq in coded)]) if coded else 0
        pairs = np.zeros(PAIR_SLOTS, dtype=bool)
        for _, seq in coded:
            auto.add(seq)
            s = np.array(seq, dtype=np.int64)
            pairs[self._slot(s[:-1], s[1:])] = True
        self.pairs = pairs
        # Which items hold a state's window, and which short items end in a
        # state: known once all items are in (copies of states come late).
        self.holders: dict[int, set] = {}
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        for item_id, seq in coded:
            state = 0
            for i, word in enumerate(seq):
                state = auto.next[state][word]
                if i + 1 >= window:
                    self.holders.setdefault(self._window_state(state), set()).add(item_id)
            if len(seq) < window:
                self.short.setdefault(state, []).append((len(seq), item_id))
        self.short_at: dict[int, list[tuple[int, str | None]]] = {}

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 0x9E3779B1 + b * 0x85EBCA77 >> 7) & (PAIR_SLOTS - 1)

    def _window_state(self, state: int) -> int:
        """The state that holds the last ``window`` words of ``state``'s strings."""
        link, length = self.auto.link, self.auto.length
        while length[link[state]] >= self.window:
            state = link[state]
        return state

    def _short(self, state: int) -> list[tuple[int, str | None]]:
        """Short items that are the end of a state's longest string."""
        got = self.short_at.get(state)
        if got is None:
            got, at = [], state
            while at > 0:
                got += self.short.get(at, [])
                at = self.auto.link[at]
            self.short_at[state] = got
        return got

    def _walk(self, words: list[int], spans: list, found: set) -> None:
        """Stream ``words`` through the automaton; merged hit spans go to
        ``spans``, the items' ids to ``found``."""
        move, link, length, window = self.auto.next, self.auto.link, self.auto.length, self.window
        any_short, state, run = bool(self.short), 0, 0
        for i, word in enumerate(words):
            target = move[state].get(word)
            while target is None and state:
                state = link[state]
                run = length[state]
                target = move[state].get(word)
            if target is None:
                run = 0
                continue
            state, run = target, run + 1
            start = -1
            if run >= window:
                # the window's state: strings no longer than the run
                found |= self.holders.get(self._window_state(state), set())
                start = i + 1 - window
            if any_short:
                for size, item_id in self._short(state):
                    if size <= run:
                        found.add(item_id)
                        if start < 0 or i + 1 - size < start:
                            start = i + 1 - size
            if start >= 0:
                while spans and spans[-1][0] >= start:
                    spans.pop()
                if spans and spans[-1][1] >= start:
                    spans[-1][1] = i + 1
                else:
                    spans.append([start, i + 1])

    def match(self, texts: list[str]) -> list[tuple[int, list[list[int]], set]]:
        """(words, hit spans in words, items) of each text."""
        get, split = self.ids.get, [normal_words(t) for t in texts]
        out = [(len(words), [], set()) for words in split]
        if not self.ids:
            return out
        sizes = np.array([len(words) + 1 for words in split], dtype=np.int64)
        ends = np.cumsum(sizes)
        flat: list[int] = []
        for words in split:                          # a zero parts texts
            flat += [get(w, 0) for w in words]
            flat.append(0)
        ids = np.array(flat, dtype=np.int64)
        known = ids > 0
        if self.shortest > 1:
            tied = known[:-1] & known[1:] & self.pairs[self._slot(ids[:-1], ids[1:])]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], tied.view(np.int8), [0]))))
            starts, stops = edge[::2], edge[1::2] + 1          # stretches of tied words
        else:
            edge = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
            starts, stops = edge[::2], edge[1::2]
        long = stops - starts >= self.shortest
        starts, stops = starts[long], stops[long]
        docs = np.searchsorted(ends, starts, side="right")
        for start, stop, d in zip(starts.tolist(), stops.tolist(), docs.tolist()):
            spans: list[list[int]] = []
            self._walk(flat[start:stop], spans, out[d][2])
            shift = start - int(ends[d] - sizes[d])
            out[d][1].extend([a + shift, b + shift] for a, b in spans)
        return out


_MATCHERS: dict[str, Matcher] = {}


def _matcher(key: str, items: list, window: int) -> Matcher:
    """One matcher a Python worker at a time."""
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items, window)
    return _MATCHERS[key]


def _one_pass(docs: DataFrame, carried: list[str], text_col: str, shared, window: int) -> DataFrame:
    schema = T.StructType([docs.schema[c] for c in carried] + list(RESULT.fields))
    key = uuid.uuid4().hex

    def run(batches):
        matcher = _matcher(key, shared.value, window)
        for batch in slices(batches):
            got = matcher.match(texts_of(batch, "_text"))
            cols = [batch.column(f"_own{i}") for i in range(len(carried))] + [
                pa.array([n for n, _, _ in got], pa.int64()),
                pa.array([sum(b - a for a, b in spans) for _, spans, _ in got], pa.int64()),
                pa.array([sorted(i for i in items if i is not None) for _, _, items in got], pa.list_(pa.string())),
                pa.array([spans for _, spans, _ in got], pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(cols, names=carried + RESULT.names)

    return docs.select(*[F.col(c).alias(f"_own{i}") for i, c in enumerate(carried)],
                       F.col(text_col).alias("_text")).mapInArrow(run, schema)


def shards_of(items: DataFrame, max_words: int) -> list[DataFrame]:
    """``items`` (item, words) in parts of at most ``max_words`` words each;
    only an item that is longer by itself, which is never cut, has a part
    beyond that.

    Rows are dealt to buckets by hash, and neighbouring buckets are joined
    while the bound holds; the driver sees one number a bucket."""
    size = F.size(F.split(F.coalesce("words", F.lit("")), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
    total = items.agg(F.sum(size)).first()[0] or 0
    if total <= max_words:
        return [items]
    buckets = 4 * (total // max_words + 1)
    while True:
        rows = (items.groupBy(F.pmod(F.xxhash64("item", "words"), F.lit(buckets)).alias("bucket"))
                .agg(F.sum(size).alias("n"), F.count("*").alias("rows")).orderBy("bucket").collect())
        # rows of different items part sooner or later
        if all(r["n"] <= max_words or r["rows"] == 1 for r in rows) or buckets > 1 << 24:
            break
        buckets *= 2
    cuts, held = [], 0
    for r in rows:
        if not cuts or held + r["n"] > max_words:
            cuts.append([])
            held = 0
        cuts[-1].append(r["bucket"])
        held += r["n"]
    bucket = F.pmod(F.xxhash64("item", "words"), F.lit(buckets))
    return [items.filter(bucket.between(c[0], c[-1])) for c in cuts]


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
            item_text_col: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS,
            keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_words, n_hit, items (ids as
    sorted strings) and spans ([from, to) in words) of each document."""
    carried = [c for c in (docs.columns if keep is None else keep) if c.lower() not in RESULT.names]
    spark = docs.sparkSession
    # A row that repeats another adds nothing.
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("words")).distinct()
    parts = shards_of(items, max_words)
    if len(parts) == 1:
        shared = spark.sparkContext.broadcast([tuple(r) for r in items.collect()])     # at most max_words words
        return _one_pass(docs, carried, text_col, shared, window)
    # Rows need a key to be united by; a written copy fixes it.
    row = free_name(docs, "row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    found = None
    for part in parts:
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])      # at most max_words words
        part_found = _one_pass(rows, [row], text_col, shared, window)
        found = part_found if found is None else found.unionByName(part_found)
    found = materialize(found, "hits")
    # union of spans: a new one begins where all earlier ones have ended
    by_start = Window.partitionBy(row).orderBy("a", "b")
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    spans = (found.select(row, F.explode("spans").alias("s")).select(row, F.col("s")[0].alias("a"), F.col("s")[1].alias("b"))
             .withColumn("begins", F.coalesce(F.col("a") > F.max("b").over(before), F.lit(True)).cast("int"))
             .withColumn("run", F.sum("begins").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy(row, "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
             .groupBy(row).agg(F.sum(F.col("b") - F.col("a")).alias("n_hit"),
                               F.sort_array(F.collect_list(F.array("a", "b"))).alias("spans")))
    united = (found.groupBy(row).agg(F.max("n_words").alias("n_words"),
                                     F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
              .join(spans, row, "left")
              .select(row, "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), "items",
                      F.coalesce("spans", F.array().cast("array<array<bigint>>")).alias("spans")))
    return rows.select(row, *carried).join(united, row).select(*carried, *RESULT.names)


def contaminated(parts: int = MIN_COVERAGE_PARTS):
    """The coverage rule as a column: hit words are one in ``parts`` or more."""
    return (F.col("n_hit") > 0) & (F.lit(parts) * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW,
                  parts: int = MIN_COVERAGE_PARTS, cut_spans: bool = False) -> DataFrame:
    """``docs`` without the documents over the coverage limit.  With
    ``cut_spans`` those documents stay, and their hit spans are cut out of
    the text instead (from the first hit word to the last, with the marks
    between)."""
    columns = docs.columns
    own = {c: f"own{i}" for i, c in enumerate(columns)}
    found = matches(docs.select(*[F.col(c).alias(n) for c, n in own.items()]), benchmark, text_col=own[text_col], window=window)
    back = [F.col(n).alias(c) for c, n in own.items()]
    if not cut_spans:
        return found.filter(~contaminated(parts)).select(*back)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut_words(t, s) if t is not None and s is not None and len(s) else t for t, s in zip(texts, spans)],
                         dtype=object)

    hit = F.when(contaminated(parts), F.col("spans"))
    return found.withColumn(own[text_col], cut(own[text_col], hit)).select(*back)


def cut_words(text: str, spans: list[list[int]]) -> str:
    """``text`` without the words of ``spans``."""
    raw = text.encode("utf-8", "replace")
    flat = np.frombuffer(raw.translate(_KEEP), dtype=np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flat.view(np.int8), [0]))))
    starts, stops = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:starts[a]])
        at = int(stops[b - 1])
    return (b"".join(out) + raw[at:]).decode("utf-8", "replace")


def items_digest(column: str = "items"):
    return F.sha2(F.concat_ws(",", column), 256)


def digest_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
