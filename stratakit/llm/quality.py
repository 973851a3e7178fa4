"""Quality rules by line sequence labelling.

A linear-chain conditional random field marks every line of a text as content
or boilerplate: each line has a feature vector, neighbouring lines are tied by
transition scores, and Viterbi decoding finds the best sequence.  The share of
a text's words that stand in content lines decides whether it is kept, after
the fixed rules on length and repetition.

Texts are independent of each other, so judging is one pass without a shuffle.
The field is fitted on a bounded sample of labelled rows (``SAMPLE_DOCS``
documents, ``SAMPLE_LINES`` lines of each); everything else sees all rows.

Defined results: a null text has no words (and fails the length rule); an
empty table gives an empty result; rows are judged one by one, so repeated
rows get equal results; columns of other names pass through untouched, and a
column named like one of the results is replaced.  Without any labelled row
the field has zero weights and marks all lines as content.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, texts_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_CONTENT_SHARE = 0.5
#: Bounds of the fitting sample.
SAMPLE_DOCS = 1500
SAMPLE_LINES = 60

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: Words of notices and page furniture (English, French, German, Spanish).
FURNITURE = frozenset((
    "licensed", "license", "copyright", "cookie", "cookies", "subscribe", "login", "newsletter", "reserved",
    "licence", "abonnez-vous", "connexion", "impressum", "datenschutz", "anmelden", "suscríbete", "derechos"))
FEATURES = ("symbols", "capitals", "exclamations", "adjacent_repeats", "bars", "repeated_line",
            "few_words", "furniture", "few_distinct")

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("content_words", T.LongType()), T.StructField("boilerplate_lines", T.LongType()),
    T.StructField("kept", T.BooleanType())])


def words_of(text: str) -> list[bytes]:
    """Runs of anything but the six ASCII white-space characters."""
    return text.encode("utf-8", "replace").split()


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words standing in a window of ``size`` words found twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    key = code[:n]
    for step in range(1, size):
        if key.max() > 2 ** 62 // (len(ids) + 1):
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(ids) + code[step:step + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(n + 1, dtype=bool)
    again[1:] = np.append(same, False)
    again[:-1] |= np.append(same, False)
    found = np.zeros(n, dtype=bool)
    found[order] = (np.append(same, False) | np.append(False, same))
    hit = np.zeros(len(words), dtype=bool)
    for step in range(size):
        hit[step:step + n] |= found
    return int(hit.sum())


def line_features(lines: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(features, words) of the lines that hold a word, and how many of them
    equal an earlier one.  Every feature is of the whole line."""
    rows, counts, seen, dups = [], [], set(), 0
    low = "\n".join(lines).lower()
    furnished = any(w in low for w in FURNITURE)
    for line in lines:
        words = line.split()
        if not words and not words_of(line):
            continue
        n = len(words) or 1
        dup = line in seen
        dups += dup
        seen.add(line)
        rows.append((
            min(1.0, 4 * sum(map(line.count, SYMBOLS)) / len(line)),
            sum(map(str.isupper, words)) / n,
            sum([w[-1] == "!" for w in words]) / n,
            sum(map(eq, words, words[1:])) / n,
            min(1.0, 3 * words.count("|") / n),
            dup,
            n < 3,
            min(1.0, 8 * sum([w.lower().strip(".,:") in FURNITURE for w in words]) / n) if furnished else 0.0,
            1 - len(set(words)) / n))
        counts.append(len(words_of(line)))
    return (np.array(rows, dtype=np.float64).reshape(-1, len(FEATURES)),
            np.array(counts, dtype=np.int64), dups)


class LineField:
    """Linear-chain conditional random field with two labels, 0 boilerplate
    and 1 content.  ``weights``: one score a feature and a bias for label 1
    against label 0; ``change``: the score of a label change between
    neighbouring lines against none."""

    def __init__(self, weights: list[float] | None = None, change: float = 0.0):
        self.weights = np.asarray(weights if weights is not None else [0.0] * (len(FEATURES) + 1))
        self.change = change

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best label sequence (Viterbi); content wins ties."""
        emit, back0, back1, t = self.scores(x).tolist(), [], [], self.change
        if not emit:
            return np.zeros(0, dtype=bool)
        s0, s1 = 0.0, emit[0]
        for e in emit[1:]:
            stay0, stay1 = s0 > s1 + t, s1 >= s0 + t
            back0.append(0 if stay0 else 1)
            back1.append(1 if stay1 else 0)
            s0, s1 = (s0 if stay0 else s1 + t), (s1 if stay1 else s0 + t) + e
        label = int(s1 >= s0)
        out = [label]
        for b0, b1 in zip(reversed(back0), reversed(back1)):
            label = b1 if label else b0
            out.append(label)
        return np.array(out[::-1], dtype=bool)

    def _marginals(self, x: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, float]:
        """P(label 1) of each line and the expected number of changes, for
        many texts at once; ``real`` marks the lines that texts have (others
        are padding at the end, and tie nothing)."""
        t, d, n = self.change, *real.shape
        emit = np.where(real, self.scores(x), 0.0)
        a, b = np.zeros((n, 2, d)), np.zeros((n, 2, d))
        a[0, 1] = emit[:, 0]
        for i in range(1, n):
            p, q = a[i - 1]
            a[i] = np.where(real[:, i], (np.logaddexp(p, q + t), np.logaddexp(q, p + t) + emit[:, i]), a[i - 1])
        for i in range(n - 2, -1, -1):
            p, q = b[i + 1, 0], b[i + 1, 1] + emit[:, i + 1]
            b[i] = np.where(real[:, i + 1], (np.logaddexp(p, q + t), np.logaddexp(q, p + t)), b[i + 1])
        z = np.logaddexp(*a[-1])
        change = np.logaddexp(a[:-1, 0] + emit.T[1:] + b[1:, 1], a[:-1, 1] + b[1:, 0]) + t - z
        return np.exp(a[:, 1] + b[:, 1] - z).T, float(np.exp(change)[real.T[1:]].sum())

    def fit(self, texts: list[np.ndarray], labels: list[int], rounds: int = 150,
            rate: float = 0.1, penalty: float = 1e-4) -> "LineField":
        """Ascent on the mean log likelihood a line (Adam steps).  All lines of
        a text carry its label, so within a text the true sequence has no
        change; a prior around -1 keeps the change score from running away."""
        both = [(x, y) for x, y in zip(texts, labels) if len(x)]
        if not both:
            return self
        longest = max(len(x) for x, _ in both)
        x = np.zeros((len(both), longest, len(FEATURES)))
        real = np.zeros((len(both), longest), dtype=bool)
        for i, (rows, _) in enumerate(both):
            x[i, :len(rows)], real[i, :len(rows)] = rows, True
        y, lines = np.array([y for _, y in both], dtype=float)[:, None], real.sum()
        m, v = np.zeros(len(FEATURES) + 2), np.zeros(len(FEATURES) + 2)
        for step in range(1, rounds + 1):
            p, changes = self._marginals(x, real)
            d = np.where(real, y - p, 0.0)
            g = np.append(np.tensordot(d, x, 2), (d.sum(), -changes)) / lines
            g[:-1] -= penalty * self.weights
            g[-1] -= 0.05 * (self.change + 1)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
            self.weights, self.change = self.weights + move[:-1], self.change + move[-1]
        return self


def fit_field(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", sample_docs: int = SAMPLE_DOCS,
              sample_lines: int = SAMPLE_LINES) -> LineField:
    """Fit on at most ``sample_docs`` labelled documents, chosen by a hash of
    their id (all of them where there are no more), ``sample_lines`` evenly
    spread lines of each."""
    chosen = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
              .groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
              .orderBy(F.xxhash64(id_col), id_col).limit(sample_docs))

    def lines(batches):
        for batch in slices(batches):
            xs, ys, ids = [], batch.column("_y").to_pylist(), batch.column("_id").to_pylist()
            for text in texts_of(batch, "_text"):
                x = line_features(text.split("\n"))[0]
                if len(x) > sample_lines:
                    x = x[np.linspace(0, len(x) - 1, sample_lines).astype(int)]
                xs.append(x.ravel().tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(ys, pa.int32()), pa.array(xs, pa.list_(pa.float64()))],
                names=["id", "y", "x"])

    rows = (docs.select(id_col, F.col(text_col).alias("_text"))
            .join(F.broadcast(chosen), id_col)          # at most sample_docs rows
            .dropDuplicates([id_col])
            .select(F.col(id_col).cast("string").alias("_id"), "_text", "_y")
            .mapInArrow(lines, "id string, y int, x array<double>").collect())
    rows = sorted(rows, key=lambda r: r["id"])
    xs = [np.array(r["x"]).reshape(-1, len(FEATURES)) for r in rows]
    return LineField().fit(xs, [r["y"] for r in rows])


def judge(text: str, field: LineField, min_share: float = MIN_CONTENT_SHARE) -> tuple:
    words = words_of(text)
    n = len(words)
    x, counts, dups = line_features(text.split("\n"))
    repeat = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    content = field.decode(x)
    content_words = int(counts[content].sum())
    return (n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dups, repeat, failed,
            content_words, int((~content).sum()), not failed and content_words >= min_share * n)


def quality_rules(docs: DataFrame, field: LineField, text_col: str = "text",
                  min_share: float = MIN_CONTENT_SHARE, keep_text: bool = True) -> DataFrame:
    """``docs`` with the measures, the field's line counts and ``kept``."""
    weights, change = field.weights.tolist(), field.change
    carried = [c for c in docs.columns if c.lower() not in RESULT.names and (keep_text or c != text_col)]
    schema = T.StructType([docs.schema[c] for c in carried] + list(RESULT.fields))

    def run(batches):
        own = LineField(weights, change)
        for batch in slices(batches):
            got = [judge(t, own, min_share) for t in texts_of(batch, "_text")]
            cols = [batch.column(f"_own{i}") for i in range(len(carried))]
            cols += [pa.array(v, pa.bool_() if f.dataType == T.BooleanType() else pa.int64())
                     for v, f in zip(zip(*got), RESULT.fields)]
            yield pa.RecordBatch.from_arrays(cols, names=carried + RESULT.names)

    return docs.select(*[F.col(c).alias(f"_own{i}") for i, c in enumerate(carried)],
                       F.col(text_col).alias("_text")).mapInArrow(run, schema)
