"""Language-model scores from subword lattices.

A text's words are spelled by pieces of an existing subword vocabulary; all
segmentations of a word count, weighted by the pieces' probabilities, and a
forward recursion in log space over the word's lattice of pieces sums them to
the word's marginal probability.  A text's probability is the product over its
words and one end symbol, so it is a proper distribution over texts: a model
of pieces and the end as independent draws.

The vocabulary file's scores rank the pieces; ``1 / (rank + 2.7)`` gives the
first weights.  Expectation maximisation then fits the weights to the training
documents: each step runs the forward and backward recursions over the table of
their different words and adds up expected piece counts, one row a piece.
Characters that no piece has are spelled by byte pieces.

Counts and lattices are over different words, each handled once: words are
counted with partial sums in the tasks, and scores come back to documents in
two ways that together cover every word.  Words that make up at least one in
``FREQUENT_BOUND`` of all occurrences (so at most that many words) are sent to
all tasks; the others join by word, where no word can then be a hot key.

Defined results: a null text is empty and has the end alone; rows without an id
count as training; repeated rows count as often as they stand, and each gets
its score; without training documents no token is known and the first weights
stand; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, texts_of

SPACE = "▁"
EM_STEPS = 4
#: At most so many words go to all tasks.
FREQUENT_BOUND = 1 << 20
#: Different words that one task counts before it passes its sums on.
COUNTER_WORDS = 400_000


def piece_model_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The usable pieces of a vocabulary file as a trie with dense rows.

    ``texts``: pieces without capitals (texts are lower-cased) and with the
    word mark at the start only; then the 256 byte pieces; then the end.
    ``first``: first weights, from the file's ranks."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = [(model.id_to_piece(i), -model.get_score(i)) for i in range(model.get_piece_size())
                 if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        found = [(p, r) for p, r in found
                 if SPACE not in p[1:] and not any("A" <= c <= "Z" for c in p)]
        last = max((r for _, r in found), default=0.0)
        self.texts = [p for p, _ in found]
        self.n = len(found) + 257
        self.byte0, self.end = len(found), self.n - 1
        rank = np.array([r for _, r in found] + [last] * 256 + [0.0])
        weights = 1.0 / (rank + 2.7)
        self.first = weights / weights.sum()
        self._build()

    def _build(self) -> None:
        long = [(p, i) for i, p in enumerate(self.texts) if len(p) > 1]
        chars = sorted({c for p, _ in long for c in p})
        self.longest = max((len(p) for p, _ in long), default=1)
        self.cls = np.zeros(0x110000, dtype=np.uint16)
        for k, c in enumerate(chars, 1):
            self.cls[ord(c)] = k
        self.width = len(chars) + 1
        nodes: dict[str, int] = {"": 0}
        for p, _ in long:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        self.move = np.zeros(len(nodes) * self.width, dtype=np.int32)
        for p, node in nodes.items():
            if p:
                self.move[nodes[p[:-1]] * self.width + int(self.cls[ord(p[-1])])] = node
        self.piece = np.full(len(nodes), -1, dtype=np.int32)
        for p, i in long:
            self.piece[nodes[p]] = i
        self.single = np.full(0x110000, -1, dtype=np.int32)
        for i, p in enumerate(self.texts):
            if len(p) == 1:
                self.single[ord(p)] = i


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One trie a Python process and file."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


class Lattice:
    """The lattices of a group of words under log weights ``logp``."""

    def __init__(self, own: Pieces, logp: np.ndarray, words: list[str]):
        self.own, self.logp, self.n = own, logp, len(words)
        self.size = np.array([len(w) + 1 for w in words])
        self.height = int(self.size.max())
        codes = np.zeros((self.n, self.height), dtype=np.int32)
        codes[:, 0] = ord(SPACE)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        inside = np.arange(self.height)[None, :] < self.size[:, None]
        inside[:, 0] = False
        codes[inside] = flat
        self.codes = np.ascontiguousarray(codes.T)
        self.cls = own.cls[self.codes].astype(np.int32)
        self.single = own.single[self.codes]
        self.unit = np.where(self.single >= 0, logp[self.single], 0.0)
        self.spelled = {}
        bare = np.unique(self.codes[self.single < 0])
        for c in bare.tolist():
            spell = [own.byte0 + b for b in chr(c).encode("utf-8", "replace")]
            self.spelled[c] = spell
            self.unit[self.codes == c] = logp[spell].sum()

    def arcs(self, i: int):
        """(length, rows, pieces) of the pieces of two and more characters
        that begin at position ``i``."""
        own, rows = self.own, np.arange(self.n)
        state = own.move[self.cls[i]]
        for d in range(1, min(own.longest, self.height - i)):
            alive = state > 0
            if not alive.any():
                return
            rows, state = rows[alive], state[alive]
            state = own.move[state * own.width + self.cls[i + d][rows]]
            # a padded end has class 0, and so no move
            piece = own.piece[state]
            has = (piece >= 0) & (state > 0)
            if has.any():
                yield d + 1, rows[has], piece[has]

    def forward(self, keep: bool = False):
        """Log marginals of the words; with ``keep`` also the table and arcs."""
        a = np.full((self.height + 1, self.n), -np.inf)
        a[0] = 0.0
        kept = []
        for i in range(self.height):
            a[i + 1] = np.logaddexp(a[i + 1], a[i] + self.unit[i])
            for d, rows, piece in self.arcs(i):
                a[i + d, rows] = np.logaddexp(a[i + d, rows], a[i, rows] + self.logp[piece])
                if keep:
                    kept.append((i, d, rows, piece))
        z = a[self.size, np.arange(self.n)]
        return (z, a, kept) if keep else z

    def expected(self, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over the words, taken ``counts`` times."""
        z, a, kept = self.forward(keep=True)
        own, uses = self.own, np.zeros(self.own.n)
        b = np.full((self.height + 1, self.n), -np.inf)
        b[self.size, np.arange(self.n)] = 0.0
        by_start: dict[int, list] = {}
        for arc in kept:
            by_start.setdefault(arc[0], []).append(arc)
        with np.errstate(invalid="ignore", over="ignore"):
            for i in range(self.height - 1, -1, -1):
                b[i] = np.logaddexp(b[i], self.unit[i] + b[i + 1])
                for _, d, rows, piece in by_start.get(i, ()):
                    b[i, rows] = np.logaddexp(b[i, rows], self.logp[piece] + b[i + d, rows])
            for i, d, rows, piece in kept:
                p = np.exp(a[i, rows] + self.logp[piece] + b[i + d, rows] - z[rows])
                uses += np.bincount(piece, weights=p * counts[rows], minlength=own.n)
            for i in range(self.height):
                p = np.where(i < self.size, np.exp(a[i] + self.unit[i] + b[i + 1] - z), 0.0) * counts
                single = self.single[i]
                known = single >= 0
                uses += np.bincount(single[known], weights=p[known], minlength=own.n)
                for j in np.flatnonzero(~known & (p > 0)).tolist():
                    for k in self.spelled[int(self.codes[i, j])]:
                        uses[k] += p[j]
        return uses


def _grouped(words: list[str], chars: int = 200_000):
    """Index groups of words of similar length, of bounded size."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        stop = at + 1
        while (stop < len(order) and (stop + 1 - at) * (len(words[order[stop]]) + 1) <= chars):
            stop += 1
        yield order[at:stop]
        at = stop


def word_scores(own: Pieces, logp: np.ndarray, words: list[str]) -> np.ndarray:
    """Natural-log marginal probability of each word."""
    out = np.zeros(len(words))
    for group in _grouped(words):
        out[group] = Lattice(own, logp, [words[i] for i in group]).forward()
    return out


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def count_words(named: DataFrame) -> DataFrame:
    """(word, c, n_all): uses in training and in all documents, of a table
    (_text, held_out)."""

    def run(batches):
        train, held = Counter(), Counter()

        def out():
            words = list(train.keys() | held.keys())
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode("utf-8", "replace") for w in words], pa.string()),
                 pa.array([train[w] for w in words], pa.int64()),
                 pa.array([train[w] + held[w] for w in words], pa.int64())], names=["word", "c", "n_all"])

        for batch in slices(batches):
            for text, is_held in zip(texts_of(batch, "_text"), batch.column("held_out").to_pylist()):
                (held if is_held else train).update(split_words(text))
            if len(train) + len(held) > COUNTER_WORDS:
                yield out()
                train.clear()
                held.clear()
        if train or held:
            yield out()

    partial = named.select("_text", "held_out").mapInArrow(run, "word string, c bigint, n_all bigint")
    return partial.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n_all").alias("n_all"))


def fit_pieces(counts: DataFrame, train_docs: int, path: str, steps: int = EM_STEPS) -> np.ndarray:
    """Piece weights after ``steps`` of expectation maximisation over the
    training words; every piece keeps a share of its first weight."""
    own = pieces(path)
    weights = own.first
    for _ in range(steps):
        shared = counts.sparkSession.sparkContext.broadcast(np.log(weights))     # one number a piece

        def run(batches):
            mine, logp, uses = pieces(path), shared.value, None
            for batch in batches:
                words, c = batch.column("word").to_pylist(), batch.column("c").to_numpy(zero_copy_only=False)
                for group in _grouped(words):
                    got = Lattice(mine, logp, [words[i] for i in group]).expected(c[group].astype(float))
                    uses = got if uses is None else uses + got
            if uses is not None:
                at = np.flatnonzero(uses)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(uses[at])], names=["piece", "uses"])

        rows = (counts.filter("c > 0").select("word", "c").mapInArrow(run, "piece bigint, uses double")
                .groupBy("piece").agg(F.sum("uses").alias("uses")).collect())     # at most one row a piece
        uses = own.first * own.n
        for r in rows:
            uses[r["piece"]] += r["uses"]
        uses[own.end] += train_docs
        weights = uses / uses.sum()
    return weights


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                    steps: int = EM_STEPS, frequent_bound: int = FREQUENT_BOUND) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of
    every document.  Training documents are those whose crc32 of the id as text
    is not 2 modulo 7."""
    spark, file = docs.sparkSession, path or piece_model_path()
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    named = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("_text"))
    counts = materialize(count_words(named), "word-counts")
    train_docs = named.filter(~F.col("held_out")).count()
    total = counts.agg(F.sum("c").alias("c"), F.sum("n_all").alias("n"),
                       F.sum((F.col("c") > 0).cast("bigint")).alias("v")).first()
    n_train, n_all = (total["c"] or 0) + train_docs, total["n"] or 0
    n_types = (total["v"] or 0) + (train_docs > 0)
    weights = fit_pieces(counts, train_docs, file, steps)
    shared = spark.sparkContext.broadcast(np.log(weights))

    def score(batches):
        own, logp = pieces(file), shared.value
        for batch in batches:
            words = batch.column("word").to_pylist()
            c = batch.column("c").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n_all"), pa.array((c > 0).astype(np.int64)),
                 pa.array(np.log10(c + 1.0)), pa.array(word_scores(own, logp, words) / math.log(10))],
                names=["word", "n_all", "known", "base", "score"])

    scored = materialize(counts.mapInArrow(score, "word string, n_all bigint, known bigint, base double, score double"),
                         "word-scores")
    least = n_all / frequent_bound
    # At most frequent_bound words can each have that share of all uses.
    top = scored.filter(F.col("n_all") >= F.lit(least)).select("word", "known", "base", "score").toPandas()
    frequent = spark.sparkContext.broadcast(
        (dict(zip([w.encode() for w in top["word"]], range(len(top)))),
         np.ascontiguousarray(top[["known", "base", "score"]].to_numpy(dtype=float).reshape(-1, 3))))
    kind = named.schema["id"].dataType.simpleString()

    def gather(batches):
        index, values = frequent.value
        get = index.get
        for batch in slices(batches):
            n, sums, rare = [], [], []
            for text in texts_of(batch, "_text"):
                words = split_words(text)
                at = [get(w, -1) for w in words]
                sums.append(values[[i for i in at if i >= 0]].sum(axis=0))
                rest = Counter(w for w, i in zip(words, at) if i < 0)
                rare.append([{"word": w.decode("utf-8", "replace"), "n": k} for w, k in rest.items()])
                n.append(len(words))
            sums = np.array(sums).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(n, pa.int64()),
                 pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1]), pa.array(sums[:, 2]),
                 pa.array(rare, pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))],
                names=["id", "held_out", "n_words", "known", "base", "score", "rare"])

    # Row numbers are made once, in the written copy.
    rows = materialize(named.mapInArrow(
        gather, f"id {kind}, held_out boolean, n_words bigint, known bigint, base double, score double, "
                "rare array<struct<word:string,n:bigint>>").withColumn("row", F.monotonically_increasing_id()),
        "document-words")
    tail = (rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
            .join(scored.filter(F.col("n_all") < F.lit(least)).select("word", "known", "base", "score"), "word")
            .groupBy("row").agg(F.sum(F.col("n") * F.col("known")).alias("t_known"),
                                F.sum(F.col("n") * F.col("base")).alias("t_base"),
                                F.sum(F.col("n") * F.col("score")).alias("t_score")))
    zero = F.lit(0.0)
    end_known, end_base = int(train_docs > 0), math.log10(train_docs + 1.0)
    unit = math.log10(n_train + 1.0 * (n_types + 1))
    end_score = float(np.log10(weights[pieces(file).end]))
    tokens = F.col("n_words") + 1
    return rows.drop("rare").join(tail, "row", "left").select(
        F.col("id").alias(id_col), "held_out", tokens.alias("n_tokens"),
        (F.col("known") + F.coalesce("t_known", F.lit(0)) + F.lit(end_known)).cast("bigint").alias("n_known"),
        F.lit(n_train).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("t_base", zero) + F.lit(end_base) - tokens * F.lit(unit)).alias("base_score"),
        (F.col("score") + F.coalesce("t_score", zero) + F.lit(end_score)).alias("score"))
