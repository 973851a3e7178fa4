"""Catalogue, rating and text features.

Vectors are ``array<double>`` columns kept beside their key; means of vectors
use ``Summarizer`` (a JVM aggregate with partial aggregation) and never a
Python loop.  Per-key statistics that have to be joined back (peer years,
vocabularies) are computed by ``groupBy`` and joined, not by window
partitions, so a hot key is combined map-side instead of landing in one task.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakit.functions.arrays import places
from stratakit.functions.text import clean_text, genre_list, tokens
from stratakit.operators.index import dense_codes, numbered_blocks
from stratakit.session import checkpointed, written

# Rows of a block, and the bytes of vectors a row may cost it (``block_count``).
BLOCK_ROWS, BLOCK_ROWS_MOST, BLOCK_KEYS, VECTOR_BYTES_A_ROW = 2_000_000, 16_000_000, 400_000, 10


def genre_vocabulary(df: DataFrame, genres_col: str) -> Column:
    """Sorted distinct genres (without the sentinel) as a scalar subquery."""
    words = df.select(F.explode(genre_list(F.col(genres_col))).alias("g")).where(F.col("g") != "")
    return words.select(F.array_sort(F.collect_set("g"))).scalar()


def genre_multi_hot(df: DataFrame, genres_col: str, out_col: str = "genre_hot") -> DataFrame:
    """H5: 0/1 per vocabulary entry (alphabetical) as ``array<int>``."""
    vocab = genre_vocabulary(df, genres_col)
    # the vocabulary is a scalar subquery, which may not sit inside a lambda:
    # bind it to a column first
    g = genre_list(F.col(genres_col))
    return (df.withColumn("_vocab", vocab)
            .withColumn(out_col, F.transform("_vocab", lambda v: F.array_contains(g, v).cast("int")))
            .drop("_vocab"))


def genre_index(df: DataFrame, genres_col: str) -> DataFrame:
    """The vocabulary as a table (genre, index), alphabetical, for
    vocabularies of any size."""
    words = df.select(F.explode(genre_list(F.col(genres_col))).alias("genre")).where(F.col("genre") != "")
    return dense_codes(words, "genre", "index")


def sparse_genres(df: DataFrame, key: str, genres_col: str, vocabulary: DataFrame, out_col: str = "genres_at") -> DataFrame:
    """H5, sparse: the ascending vocabulary indexes of a row's genres (none:
    an empty array).  ``key`` is unique; a null one keeps an empty array.
    Shuffles the genres that rows have, never the vocabulary with each row."""
    met = (df.select(key, F.explode(F.array_distinct(genre_list(F.col(genres_col)))).alias("genre"))
           .join(vocabulary.select("genre", "index"), "genre"))
    at = met.groupBy(key).agg(F.array_sort(F.collect_list("index")).alias(out_col))
    return df.join(at, key, "left").withColumn(out_col, F.coalesce(F.col(out_col), F.array().cast("array<bigint>")))


def mean_sparse(rows: DataFrame, key: str, at_col: str, out_col: str = "share") -> DataFrame:
    """D4, sparse: (key, index, share), the mean of the rows' 0/1 vectors at
    each index that a row of the key has; others are 0 and left out."""
    return sparse_shares(sparse_counts(rows, key, at_col), key, out_col)


def sparse_counts(rows: DataFrame, key: str, at_col: str) -> DataFrame:
    """(key, index, _c): rows of the key that have the index; index -1 counts
    all its rows.  One pass over ``rows``, written once."""
    at = F.concat(F.array(F.lit(-1).cast("long")), F.coalesce(F.col(at_col), F.array().cast("array<bigint>")))
    return checkpointed(rows.select(key, F.explode(at).alias("index")).groupBy(key, "index").agg(F.count(F.lit(1)).alias("_c")))


def sparse_shares(counts: DataFrame, key: str, out_col: str = "share") -> DataFrame:
    n = counts.where("index = -1").select(key, F.col("_c").alias("_n"))
    return counts.where("index >= 0").join(n, key).select(key, "index", (F.col("_c") / F.col("_n")).alias(out_col))


def fill_year_by_peers(df: DataFrame, year_col: str, genres_col: str) -> DataFrame:
    """A null year becomes the half-even rounded mean year of the rows with
    the identical genre set; with no dated peer it stays null (Q12)."""
    key = F.array_join(F.array_sort(F.array_distinct(genre_list(F.col(genres_col)))), "|")
    keyed = df.withColumn("_gkey", key)
    peers = keyed.groupBy("_gkey").agg(F.avg(year_col).alias("_peer"))
    return (keyed.join(peers, "_gkey", "left")
            .withColumn(year_col, F.coalesce(F.col(year_col), F.bround("_peer", 0).cast("int")))
            .drop("_gkey", "_peer"))


def process_tokens(texts: DataFrame, key: str, text_col: str, stop_words: list[str],
                   lemmas: DataFrame | None, dictionary: DataFrame | None,
                   out_col: str = "clean") -> DataFrame:
    """B5 + H3 + H4: clean, tokenise, drop stop words, lemmatise through a
    ``(token, lemma)`` table, keep dictionary words; repeats and order kept.
    Rows left empty are dropped."""
    t = term_places(texts, key, text_col, stop_words)
    if lemmas is not None:
        lm = lemmas.select("token", "lemma")
        t = t.join(lm, "token", "left").select(key, "at", F.coalesce("lemma", "token").alias("token"))
    if dictionary is not None:
        t = t.join(dictionary.select("token"), "token", "left_semi")
    agg = t.groupBy(key).agg(F.collect_list(F.struct("at", "token")).alias("_parts"), F.sum(F.size("at")).alias("n_parts"))
    placed = F.flatten(F.transform("_parts", lambda p: F.transform(p["at"], lambda i: F.struct(i.alias("i"), p["token"].alias("w")))))
    return agg.select(key, F.array_join(F.transform(F.array_sort(placed), lambda p: p["w"]), " ").alias(out_col), "n_parts")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer partitions than there
    are (a small table in one row group); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def term_places(texts: DataFrame, key: str, text_col: str, stop_words: list[str] | None = None) -> DataFrame:
    """H3: the sparse (text, term) matrix (key, token, at): one row for each
    different token of a text, with its places.  A text's words stay in its
    row until they are different ones, so what joins and shuffles is the
    matrix and not the words."""
    words = tokens(clean_text(F.col(text_col)))
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(*stop_words))
    found = spread(texts.select(key, text_col)).select(key, F.explode(places(words)).alias("_p"))
    return found.select(key, F.col("_p.value").alias("token"), F.col("_p.at").alias("at"))


def ordered_concat(df: DataFrame, key: str, order_col: str, text_col: str, out_col: str,
                   sep: str = " ") -> DataFrame:
    """D6 + F5: texts of a key joined in ``order_col`` order."""
    agg = df.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(order_col, text_col))).alias("_parts"),
        F.count(F.lit(1)).cast("long").alias("n_parts"))
    return agg.select(key, F.array_join(F.transform("_parts", lambda p: p[text_col]), sep).alias(out_col),
                      "n_parts")


def mean_vectors(rows: DataFrame, key: str, vec_col: str, weight_col: str | None = None,
                 out_col: str = "vec", dim: int | None = None) -> DataFrame:
    """Weighted mean of ``array`` vectors per key.

    With a known ``dim`` it is one hash aggregate of ``dim`` plain sums
    (codegen, partial aggregation); otherwise MLlib's ``Summarizer``."""
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    if dim is not None:
        v = F.col(vec_col)
        sums = [F.sum(v[i].cast("double") * w).alias(f"_s{i}") for i in range(dim)]
        agg = rows.groupBy(key).agg(F.sum(w).alias("_w"), *sums)
        return agg.select(key, F.array(*[F.col(f"_s{i}") / F.col("_w") for i in range(dim)]).alias(out_col))
    v = rows.withColumn("_v", array_to_vector(F.col(vec_col).cast("array<double>")))
    agg = v.groupBy(key).agg(Summarizer.mean(F.col("_v"), w).alias("_m"))
    return agg.select(key, vector_to_array("_m").alias(out_col))


def hash_blocks(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    """``rows`` with ``_block``, a hash of the key."""
    return rows.withColumn("_block", F.pmod(F.hash(key), F.lit(blocks)))


def block_count(rows: int, keys: int, vectors: int, dim: int, cores: int) -> int:
    """Blocks that ``rows`` of ``keys`` different keys are cut into: small
    enough to be sorted in memory, few enough that a copy of all vectors for
    each takes less room than the rows."""
    wanted = max(rows / BLOCK_ROWS, min(cores, rows / 50_000))
    paid = rows * VECTOR_BYTES_A_ROW / (8 * dim * max(vectors, 1))
    return max(1, round(max(min(wanted, paid), rows / BLOCK_ROWS_MOST, keys / BLOCK_KEYS)))


def blocks_for(rows: DataFrame, key: str, vectors: int, dim: int) -> int:
    """``block_count`` of a written table."""
    n, keys = rows.agg(F.count(F.lit(1)), F.approx_count_distinct(key)).first()
    return block_count(n, keys, vectors, dim, rows.sparkSession.sparkContext.defaultParallelism)


def range_blocks(rows: DataFrame, key: str, blocks: int) -> tuple[DataFrame, int]:
    """``rows`` with ``_block``, ascending ranges of a numeric key without
    nulls, and how many there are (at most ``blocks``).  The cuts are
    approximate quantiles: they decide how even the blocks are, never what they
    give.  One pass over the key, so ``rows`` is a written table."""
    at = F.col(key).cast("double")
    cuts = rows.agg(F.percentile_approx(at, [i / blocks for i in range(1, blocks)], 10_000)).first()[0] if blocks > 1 else None
    if not cuts:
        return rows.withColumn("_block", F.lit(0)), 1
    cuts = sorted(set(cuts))
    to = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_at", outputCol="_bucket")
    return to.transform(rows.withColumn("_at", at)).withColumn("_block", F.col("_bucket").cast("int")).drop("_at", "_bucket"), len(cuts) + 1


def in_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """Each block in one partition."""
    if hasattr(rows, "repartitionById"):          # Spark 4.1: a partition each, where a hash may put several into one
        return rows.repartitionById(blocks, F.col("_block"))
    return rows.repartition(blocks, "_block")


def block_means(rows: DataFrame, blocks: int, key: str, group_key: str, vectors: DataFrame, dim: int, weight_col: str | None = None,
                once: list[str] | None = None, zeros: bool = False, out_col: str = "vec", also: list[Column] | None = None) -> DataFrame:
    """(_block, key, ``out_col``): weighted mean of the vectors of a key's
    groups, in one shuffle of the rows.

    All rows of a key have one ``_block`` (0 to ``blocks - 1``), and every block
    gets a copy of the group vectors.  Within a block the rows are sorted behind
    their group's vector and take it from there: no row is shuffled with a
    vector, and no partial sums are.  Several vectors of a group all count.

    ``once``: of a group's rows that agree in these columns one counts.
    ``zeros``: rows without a vector count as zeros; else they are left out.
    ``also``: aggregates over all rows of a key, repeated ones included."""
    v = F.col("vec")
    sent = (vectors.where(F.col(group_key).isNotNull()).groupBy(F.col(group_key).alias("_group"))
            .agg(F.count(F.lit(1)).alias("_times"), *[F.sum(v[i].cast("double")).alias(f"_s{i}") for i in range(dim)])
            .select("_group", "_times", F.array(*[F.col(f"_s{i}") for i in range(dim)]).alias("_sum"),
                    F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")))
    own = rows.withColumnsRenamed({group_key: "_group"}).withColumn("_weight", F.col(weight_col).cast("double") if weight_col else F.lit(1.0))
    both = in_blocks(own.unionByName(sent, allowMissingColumns=True), blocks)
    row, same = F.col("_times").isNull(), F.struct(F.col("_times").isNull().alias("row"), *(once or []))
    order = Window.partitionBy("_block", "_group").orderBy(row, *(once or []))
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    again = F.lag(same).over(order).eqNullSafe(same) if once else F.lit(False)
    met = both.select("*", F.first("_times").over(before).alias("_t"), F.first("_sum").over(before).alias("_v"), again.alias("_again")).where(row)
    if zeros:
        met = met.withColumn("_v", F.coalesce("_v", F.array_repeat(F.lit(0.0), dim))).withColumn("_t", F.coalesce("_t", F.lit(1)))
    elif not also:
        met = met.where(F.col("_t").isNotNull())
    w = F.when(~F.col("_again"), F.col("_weight"))
    agg = met.groupBy("_block", key).agg(F.sum(w * F.col("_t")).alias("_w"), *[F.sum(F.col("_v")[i] * w).alias(f"_s{i}") for i in range(dim)],
                                         *(also or []))
    left = [c for c in agg.columns if c not in {"_w", *(f"_s{i}" for i in range(dim))}]
    return agg.select(*left, F.array(*[F.col(f"_s{i}") / F.col("_w") for i in range(dim)]).alias(out_col))


def block_counts(rows: DataFrame, blocks: int, key: str, at_col: str, weight_col: str) -> DataFrame:
    """(_block, key, _n, _counts): a key's weight in all, and a map from each
    index in its rows' arrays to the weight of its rows there.  Arrays are
    spread to indexes only behind the one shuffle."""
    at = F.concat(F.array(F.lit(-1).cast("long")), F.coalesce(F.col(at_col), F.array().cast("array<bigint>")))
    placed = in_blocks(rows.select("_block", key, F.col(at_col), F.col(weight_col).alias("_c")), blocks)
    counts = placed.select("_block", key, F.explode(at).alias("index"), "_c").groupBy("_block", key, "index").agg(F.sum("_c").alias("_c"))
    met = F.col("index") >= 0
    return counts.groupBy("_block", key).agg(F.max(F.when(~met, F.col("_c"))).alias("_n"),
                                             F.map_from_entries(F.collect_list(F.when(met, F.struct("index", "_c")))).alias("_counts"))


def text_embedding(texts: DataFrame, key: str, tokens_col: str, word_vectors: DataFrame,
                   dim: int, out_col: str = "vec", blocks: int | None = None) -> DataFrame:
    """C9 + H6 + B6: mean word vector of each text (repeats count, unknown
    tokens skipped); texts with no known token get zeros.  ``blocks``: texts
    meet the word vectors in so many blocks (``block_means``), not by word."""
    found = (spread(texts.select(key, tokens_col)).select(key, F.explode(places(tokens(F.col(tokens_col)))).alias("_p"))
             .select(key, F.col("_p.value").alias("token"), F.size("_p.at").alias("_n")))
    words = word_vectors.select("token", "vec")
    if blocks is None:
        means = mean_vectors(found.join(words, "token"), key, "vec", "_n", out_col, dim=dim)
    else:
        means = block_means(hash_blocks(found, key, blocks), blocks, key, "token", words, dim, "_n", out_col=out_col).drop("_block")
    zeros = F.array_repeat(F.lit(0.0), dim)
    return (texts.select(key).join(means, key, "left")
            .withColumn(out_col, F.coalesce(F.col(out_col), zeros)))


def user_vectors(log: DataFrame, item_vectors: DataFrame, user_key: str, item_key: str,
                 dim: int, out_col: str = "vec") -> DataFrame:
    """D5 + I15: mean item vector per user over *distinct* items; items with no
    vector count as zeros (C6 left join + fill)."""
    pairs = log.select(user_key, item_key).distinct()
    zeros = F.array_repeat(F.lit(0.0), dim)
    j = (pairs.join(item_vectors.select(item_key, F.col("vec").alias("_iv")), item_key, "left")
         .withColumn("_iv", F.coalesce(F.col("_iv").cast("array<double>"), zeros)))
    return mean_vectors(j, user_key, "_iv", None, out_col, dim=dim)


def user_vectors_shared(log: DataFrame, item_groups: DataFrame, group_vectors: DataFrame, user_key: str, item_key: str,
                        group_key: str, dim: int, out_col: str = "vec") -> DataFrame:
    """``user_vectors`` where items share vectors: ``item_groups`` has each
    item's group, ``group_vectors`` one vector a group (none: zeros).  Pairs are
    shuffled without vectors and meet them in blocks of users."""
    rows = written(log_with_items(log.select(user_key, item_key), item_copies(item_groups, item_key, group_key), item_key), "log")
    vectors = group_vectors.select(group_key, "vec")
    blocks = blocks_for(rows, user_key, vectors.count(), dim)
    return block_means(hash_blocks(rows, user_key, blocks), blocks, user_key, group_key, vectors, dim, "_copies",
                       [item_key, user_key], True, out_col).drop("_block")


def item_copies(item_groups: DataFrame, item_key: str, group_key: str) -> DataFrame:
    """(item, group, _copies): how many rows of ``item_groups`` say so."""
    return item_groups.groupBy(item_key, group_key).agg(F.count(F.lit(1)).alias("_copies"))


def log_with_items(log: DataFrame, items: DataFrame, item_key: str) -> DataFrame:
    """Rows of the log with what ``items`` has of their item; ``_copies`` is 1
    for an item that it has not."""
    return log.join(items, item_key, "left").withColumn("_copies", F.coalesce("_copies", F.lit(1)))


def user_means(log: DataFrame, group_vectors: DataFrame, user_key: str, item_key: str, group_key: str, value_col: str, dim: int) -> DataFrame:
    """D3 + D5, numbered: (code, user, mean of ``value_col`` over the rows, mean
    vector over the different items) of each user of a written log
    (``log_with_items``, one row a rating, users not null).  Codes are dense and
    ascending, as ``dense_codes`` gives them."""
    vectors = group_vectors.select(group_key, "vec")
    rows, blocks = range_blocks(log, user_key, blocks_for(log, user_key, vectors.count(), dim))
    means = block_means(rows, blocks, user_key, group_key, vectors, dim, "_copies", [item_key, user_key], True,
                        also=[F.avg(value_col).alias("rating_avg")])
    return numbered_blocks(means, user_key)


def user_counts(log: DataFrame, user_key: str, at_col: str, weight_col: str) -> DataFrame:
    """D4, numbered: (code, user, _n, _counts) of each user of a written log, as
    ``block_counts`` has them, under the codes of ``user_means``."""
    rows, blocks = range_blocks(log, user_key, blocks_for(log, user_key, 0, 1))
    return numbered_blocks(block_counts(rows, blocks, user_key, at_col, weight_col), user_key)


def spread_vector(df: DataFrame, key: str, vec_col: str, digits: int = 6) -> DataFrame:
    """Output edge only: ``(key, dim, value)`` rows of a vector column."""
    return df.select(key, F.posexplode(vec_col).alias("dim", "value")).select(
        key, F.col("dim").cast("int").alias("dim"), F.round("value", digits).alias("value"))


def mean_by_key(log: DataFrame, key: str, value_col: str, out_col: str) -> DataFrame:
    """D3: mean value per key."""
    return log.groupBy(key).agg(F.avg(value_col).alias(out_col))
