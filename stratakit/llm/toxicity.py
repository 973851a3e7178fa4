"""Toxicity scores by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models of the characters of words, one of toxic
and one of ordinary labelled texts, give each text two log-likelihoods.  Their
difference, divided by the text's length, decides: a logistic curve fitted on
labelled texts that the models have not counted turns it into a score.

A model's longest sequences (and those that begin at a word's start) have the
class's own counts, shorter ones its continuation counts: in how many
surroundings they stand.  Below ``SHARED`` characters both classes back off to
the same continuation counts of all texts together.  An expression that one
class has never shown thus gets what its parts are worth in all texts, and
only what one class has shown tells the classes apart.

Texts of both classes are mostly ordinary words.  A class's likelihood of a
word is therefore a mixture: toxic texts take ``TOXIC_SHARE`` of their words
from the toxic model, ordinary ones ``ORDINARY_SHARE``, and the rest of both
comes from the ordinary model.  What a rare ordinary word happens to be worth
thus stays near zero, and no single word decides alone.

The models are fitted on a bounded sample of labelled rows (``FIT_TOXIC`` and
``FIT_ORDINARY`` documents, the first by a hash of their id, whole texts); a
fifth of them is kept for the curve.  Their size is bounded with the sample:
sequences of up to ``ORDER`` characters that occur there.  Scoring is one pass
over all texts without a shuffle: the words of a slice are cut by array
operations, each different one is scored once.

Defined results: a null or empty text, or one without letters, has a
difference of zero; an id that is null counts as an empty one and has no
label; of several texts of one labelled id the smallest is fitted on, of
several labels the largest; repeated rows get equal results; without labelled
rows of both classes the score is the labelled share of toxic rows (zero
without any); an empty table gives an empty result; very long texts are scored
whole; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_slices, texts_of

ORDER = 5
#: Sequences shorter than this have one count for both classes.
SHARED = 3
DISCOUNT = 0.75
THRESHOLD = 0.3
#: Shares of words that the classes' texts take from the toxic model.
TOXIC_SHARE = 0.01
ORDINARY_SHARE = 0.004
#: Bounds of the fitting sample.
FIT_TOXIC = 6000
FIT_ORDINARY = 12000
#: Characters that get a class of their own; the others share one.
CLASSES = 1000
BITS = 10
START, END, OTHER, FIRST = 1, 2, 3, 4
#: All ASCII characters but letters part words.
FOLD = bytes(32 if b < 128 and not chr(b).isalpha() else b for b in range(256))


def words_of(texts: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(codes of all words on end, the different words, the text of each
    word)."""
    blob = b" \n ".join(t.lower().encode("utf-8", "replace").translate(FOLD) for t in texts)
    kind = pa.large_binary() if len(blob) > 2_000_000_000 else pa.binary()
    parts = pc.split_pattern(pa.array([blob], kind), pattern=" ").flatten()
    parts = parts.filter(pc.greater(pc.binary_length(parts), 0))
    stop = pc.equal(parts, pa.scalar(b"\n", kind)).to_numpy(zero_copy_only=False)
    text = np.cumsum(stop)[~stop]
    words = parts.filter(pa.array(~stop)).dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary, text


def _sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(different keys, the sums of each of ``values`` by key)."""
    found, back = np.unique(key, return_inverse=True)
    return found, [np.bincount(back, weights=v, minlength=len(found)) for v in values]


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of ``wanted`` in sorted ``keys``, whether it is there)."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Models:
    """Both classes' models as tables by sequence length.

    A sequence is a number with the last character in its lowest bits, so what
    stands before that is ``code >> BITS`` and a shorter sequence of the same
    end is ``code & mask``.  ``ratio``: log of the toxic over the ordinary
    probability of a sequence's last character; ``back``: of the weights with
    which a history passes to a shorter one."""

    def __init__(self, chars: list[str], order: int = ORDER):
        self.order = order
        self.chars = chars
        self.cls = np.full(0x110000, OTHER, dtype=np.int64)
        self.cls[[ord(c) for c in chars]] = np.arange(FIRST, FIRST + len(chars))
        self.cls[[1, 2]] = START, END
        self.mask = [(1 << BITS * o) - 1 for o in range(order + 1)]
        self.keys = [np.zeros(0, dtype=np.int64)] * (order + 1)
        self.ratio = [np.zeros(0)] * (order + 1)
        self.histories = [np.zeros(0, dtype=np.int64)] * (order + 1)
        self.back = [np.zeros(0)] * (order + 1)

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, length, word) of the longest sequence that ends at each
        character of the words and at each word's end."""
        text = "\x01" + "\x02\x01".join(words) + "\x02"
        c = self.cls[np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)]
        begin = c == START
        word = np.cumsum(begin) - 1
        since = np.arange(len(c)) - np.flatnonzero(begin)[word]
        code = np.zeros(len(c), dtype=np.int64)
        for j in range(self.order):
            on = since >= j
            code[on] |= c[np.flatnonzero(on) - j] << BITS * j
        length = np.minimum(since + 1, self.order)
        return code[~begin], length[~begin], word[~begin]

    def fit(self, code: np.ndarray, length: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> "Models":
        """``toxic``, ``ordinary``: how often each of the different sequences
        that ``codes`` gives stands in the words of the class."""
        uses = [ordinary.astype(float), toxic.astype(float)]
        top = self.order
        # counts by length: of the longest sequences and of those from a word's start, the uses; of others, the
        # different sequences one longer that end in them
        sizes, tables = range(1, top + 1), {}
        for o in sizes:
            has = length >= o
            tables[o] = _sums(code[has] & self.mask[o], *[u[has] for u in uses])
        low = np.full(len(tables[1][0]), 1.0 / (len(self.chars) + FIRST))
        prob, below = [low, low], tables[1][0]
        for o in sizes:
            keys, own = tables[o]
            if o < top:
                wide, many = tables[o + 1]
                short, more = _sums(wide & self.mask[o], *[(m > 0).astype(float) for m in many], np.ones(len(wide)))
                anchored = keys >> BITS * (o - 1) == START
                at, there = _at(short, keys)
                both = np.where(anchored, own[0] + own[1], np.where(there, more[2][at], 0.0))
                own = [np.where(anchored, n, np.where(there, m[at], 0.0)) for n, m in zip(own, more)]
            else:
                both = own[0] + own[1]
            if o < SHARED:
                own = [both, both]
            history, sums = _sums(keys >> BITS, *own, *[(n > 0).astype(float) for n in own])
            at, _ = _at(history, keys >> BITS)
            shorter, known = (_at(below, keys & self.mask[o - 1]) if o > 1 else (np.arange(len(keys)), np.ones(len(keys), bool)))
            new, weights = [], []
            for y in (0, 1):
                total, kinds = sums[y], sums[2 + y]
                weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1e-300), 1.0)
                base = np.where(known, prob[y][shorter], low[0])
                share = np.where(total[at] > 0, np.maximum(own[y] - DISCOUNT, 0) / np.maximum(total[at], 1e-300), 0.0)
                new.append(share + weight[at] * base)
                weights.append(weight)
            prob, below = new, keys
            if o >= SHARED:
                self.keys[o], self.ratio[o] = keys, np.log(prob[1] / prob[0])
                self.histories[o], self.back[o] = history, np.log(weights[1] / weights[0])
        return self

    def ratios(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log ratio, characters with the end) of each word."""
        if not words:
            return np.zeros(0), np.zeros(0)
        code, length, word = self.codes(words)
        out = np.zeros(len(code))
        for o in range(self.order, SHARED - 1, -1):
            left = np.flatnonzero(length == o)
            if not len(left) or not len(self.keys[o]):
                length[left] = o - 1
                code[left] &= self.mask[o - 1]
                continue
            at, there = _at(self.keys[o], code[left])
            out[left[there]] += self.ratio[o][at[there]]
            length[left[there]] = 0
            left = left[~there]
            at, there = _at(self.histories[o], code[left] >> BITS)
            out[left[there]] += self.back[o][at[there]]
            length[left] = o - 1
            code[left] &= self.mask[o - 1]
        return (np.bincount(word, weights=out, minlength=len(words)),
                np.bincount(word, minlength=len(words)).astype(float))

    def differences(self, texts: list[str]) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of each text, a character."""
        codes, words, text = words_of(texts)
        ratio, size = self.ratios([w.decode("utf-8", "replace") for w in words.to_pylist()])
        more = np.expm1(np.minimum(ratio, 500.0))
        ratio = np.log1p(TOXIC_SHARE * more) - np.log1p(ORDINARY_SHARE * more)
        total = np.bincount(text, weights=ratio[codes], minlength=len(texts))
        return total / np.maximum(np.bincount(text, weights=size[codes], minlength=len(texts)), 1.0)


class Scorer:
    """Models with a curve; without models, the labelled share of toxic rows."""

    def __init__(self, models: Models | None, slope: float = 0.0, shift: float = 0.0, share: float = 0.0):
        self.models, self.slope, self.shift, self.share = models, slope, shift, share

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.models is None:
            return np.full(len(texts), self.share)
        z = np.concatenate([self.models.differences(texts[i:i + 4096]) for i in range(0, len(texts), 4096)] or [np.zeros(0)])
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * z + self.shift, -500, 500)))


def fit_curve(z: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """(slope, shift) of the logistic curve of ``y`` on ``z``, rows weighted
    so that ``share`` of them are toxic; Newton steps with a weak prior."""
    n = max(len(y), 1)
    weight = np.where(y == 1, share * n / max((y == 1).sum(), 1), (1 - share) * n / max((y == 0).sum(), 1))
    scale = z.std() or 1.0
    x, w = np.stack([z / scale, np.ones(len(z))], axis=1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        g = x.T @ (weight * (y - p)) - 1e-2 * w
        h = (x.T * (weight * p * (1 - p))) @ x + 1e-2 * np.eye(2)
        move = np.linalg.solve(h, g)
        w = w + move * min(1.0, 4.0 / max(np.abs(move).max(), 1e-12))
    return float(w[0] / scale), float(w[1])


def is_held(id_col: str) -> Column:
    """Rows whose labels are not learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        fit_toxic: int = FIT_TOXIC, fit_ordinary: int = FIT_ORDINARY) -> Scorer:
    """The scorer, from labelled rows that are not held out: at most
    ``fit_toxic`` and ``fit_ordinary`` documents of the classes."""
    known = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~is_held(id_col))
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y")))
    order = F.xxhash64("id")
    chosen = (known.filter("y = 1").orderBy(order, "id").limit(fit_toxic)
              .unionAll(known.filter("y <> 1").orderBy(order, "id").limit(fit_ordinary)))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    sample = materialize(
        texts.join(F.broadcast(chosen), "id")             # at most fit_toxic + fit_ordinary rows
        .groupBy("id", "y").agg(F.min("body").alias("body"))
        .withColumn("curve", F.pmod(F.xxhash64(F.lit("curve"), "id"), F.lit(5)) == 0), "toxicity-sample")
    counted = {bool(r["y"]): r["n"] for r in known.groupBy((F.col("y") == 1).alias("y")).agg(F.count("*").alias("n")).collect()}
    share = counted.get(True, 0) / max(sum(counted.values()), 1)

    def count(batches):
        for batch in text_slices(batches, "body"):
            codes, words, text = words_of(texts_of(batch, "body"))
            toxic = np.array(batch.column("y").to_pylist(), dtype=np.int64) == 1
            is_toxic = toxic[text]
            n = len(words)
            yield pa.RecordBatch.from_arrays(
                [words.cast(pa.string()), pa.array(np.bincount(codes[is_toxic], minlength=n)),
                 pa.array(np.bincount(codes[~is_toxic], minlength=n))], names=["word", "toxic", "ordinary"])

    words = materialize(sample.filter("not curve").select("body", "y").mapInArrow(count, "word string, toxic bigint, ordinary bigint")
                        .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "toxicity-words")
    chars = [r["char"] for r in words.select(F.explode(F.split("word", "")).alias("char"), (F.col("toxic") + F.col("ordinary")).alias("n"))
             .filter("char not in ('', '\\u0001', '\\u0002')").groupBy("char").agg(F.sum("n").alias("n"))
             .orderBy(F.desc("n"), "char").limit(CLASSES).collect()]

    def sequences(batches):
        empty = Models(chars)
        for batch in batches:
            code, length, word = empty.codes(batch.column("word").to_pylist())
            uses = [batch.column(c).to_numpy(zero_copy_only=False)[word] for c in ("toxic", "ordinary")]
            code, first, back = np.unique(code, return_index=True, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(code), pa.array(length[first].astype(np.int32))]
                + [pa.array(np.bincount(back, weights=u).astype(np.int64)) for u in uses],
                names=["code", "length", "toxic", "ordinary"])

    # the sample's different sequences: bounded as it is
    rows = (words.mapInArrow(sequences, "code bigint, length int, toxic bigint, ordinary bigint").groupBy("code", "length")
            .agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).orderBy("code").toPandas())
    code, length, toxic, ordinary = (rows[c].to_numpy(dtype=np.int64) for c in ("code", "length", "toxic", "ordinary"))
    if not toxic.sum() or not ordinary.sum():
        return Scorer(None, share=share)
    models = Models(chars).fit(code, length, toxic, ordinary)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def differ(batches):
        for batch in text_slices(batches, "body"):
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(shared.value.differences(texts_of(batch, "body")))],
                                             names=["y", "z"])

    rows = sample.filter("curve").select("y", "body").mapInArrow(differ, "y int, z double").orderBy("z", "y").toPandas()
    y = (rows["y"].to_numpy() == 1).astype(float)
    if not 0 < y.sum() < len(y):
        return Scorer(None, share=share)
    slope, shift = fit_curve(rows["z"].to_numpy(dtype=float), y, share)
    return Scorer(models, slope, shift, share)


def score_documents(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    named = docs.select(F.col(id_col).alias("id"), is_held(id_col).alias("held_out"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    kind, shared = named.schema["id"].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        for batch in text_slices(batches, "body"):
            score = shared.value.scores(texts_of(batch, "body"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(score, pa.float64()),
                 pa.array((score >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    return (named.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int")
            .withColumnRenamed("id", id_col))
