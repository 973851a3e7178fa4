"""Toxicity models, phrase collocations and spelling variants against
brute-force versions, on given tables, odd rows and hot groups."""

import collections
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratakit.llm import collocations, toxicity, variants
from stratakit.llm.common import materialize
from stratakit.llm.queries import QUERIES
from tests.conftest import SF001, SF01
from tests.llm import brute

DOC = "doc_id bigint, text string, lang string, word string, n string, body string, phrase string"


def rows_of(spark, texts, langs=None):
    rows = [(i, t, langs[i] if langs else "en", "x", "y", "z", "p") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).repartition(5)


# --- toxicity

def test_models_follow_the_definition():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdé") for _ in range(rng.randint(1, 8))) for _ in range(80)})
    toxic, ordinary = (np.array([rng.choice([0, 0, 1, 2, 9]) for _ in words]) for _ in range(2))
    want = brute.char_models(words, toxic, ordinary)
    models = toxicity.Models(sorted({c for w in words for c in w}))
    code, length, word = models.codes(words)
    code, first, back = np.unique(code, return_index=True, return_inverse=True)
    models.fit(code, length[first], np.bincount(back, weights=toxic[word]), np.bincount(back, weights=ordinary[word]))
    asked = words + ["", "a", "abcabc", "eeee", "édcba" * 3]
    got, size = models.ratios(asked)
    assert np.allclose(got, [want(w) for w in asked], atol=1e-9)
    assert size.tolist() == [len(w) + 1 for w in asked]
    texts = ["", "ABC, dé-a!\n", "b1c", None, "a " * 40_000]
    diff = models.differences([t or "" for t in texts])
    assert diff[0] == diff[3] == 0

    def mixed(word):
        share = [(1 - s) + s * np.exp(want(word)) for s in (toxicity.TOXIC_SHARE, toxicity.ORDINARY_SHARE)]
        return np.log(share[0] / share[1])
    assert np.isclose(diff[1], (mixed("abc") + mixed("dé") + mixed("a")) / 9) and np.isclose(diff[4], mixed("a") / 2)


def test_toxicity_query(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    got = {r["doc_id"]: r for r in QUERIES["op11_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    assert len(got) == docs.count()
    held = {True: [], False: []}
    for r in labels.collect():
        own = got[r["doc_id"]]
        assert own["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= own["score"] <= 1 and own["predicted"] == int(own["score"] >= 0.3)
        if own["held_out"]:
            held[r["toxic"] == 1].append(own)
    assert sum(r["predicted"] for r in held[True]) >= 0.75 * len(held[True]) > 20
    assert sum(r["predicted"] for r in held[False]) <= 0.02 * len(held[False])


def test_toxicity_odd_rows(spark):
    docs = rows_of(spark, [None, "", "123 !!", "plain words here", "vile words here", "plain text"] * 20 + ["vile " * 50_000])
    labels = docs.select("doc_id", F.col("text").contains("vile").cast("int").alias("toxic"))
    scorer = toxicity.fit(docs, labels)
    rows = {r["doc_id"]: r for r in toxicity.score_documents(docs, scorer).collect()}
    assert len(rows) == 121 and rows[0]["score"] == rows[1]["score"] == rows[2]["score"]
    assert rows[120]["predicted"] == 1 and rows[4]["score"] > rows[3]["score"] == rows[9]["score"]
    twice = docs.unionAll(docs).withColumn("doc_id", F.when(F.col("doc_id") > 5, F.col("doc_id")))
    assert toxicity.score_documents(twice, scorer).count() == 242
    for few in (labels.filter("false"), labels.withColumn("toxic", F.lit(0)), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert {r["score"] for r in toxicity.score_documents(docs, toxicity.fit(docs, few)).collect()} == {0.0}
    none = docs.filter("false")
    assert toxicity.score_documents(none, toxicity.fit(none, labels.filter("false"))).collect() == []


def test_held_labels_are_not_learned(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{n}.parquet") for n in ("documents", "labels"))
    changed = labels.withColumn("toxic", F.when(toxicity.is_held("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.score_documents(docs, toxicity.fit(docs, x)).orderBy("doc_id").collect() for x in (labels, changed))
    assert a == b


# --- collocations

def phrases(spark, texts, langs, least, **kw):
    counts = materialize(collocations.count_phrases(rows_of(spark, texts, langs), min_count=least, **kw), "test")
    return counts


@pytest.mark.parametrize("shards, slots", [(1, 1 << 16), (3, 64), (4, 1 << 16)])
def test_counts_are_exact(spark, shards, slots):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b", "C", "dé", "e.", "f\tg", "h\n", "x\x1cy"]) for _ in range(rng.randint(0, 40)))
             for _ in range(120)] + [None, "", "  . ", "a b C " * 3000]
    langs = [rng.choice(["en", "de", None]) for _ in texts]
    want, n = brute.phrase_counts(list(zip(langs, texts)))
    want = {(lang, " ".join(w), len(w), c) for (lang, w), c in want.items() if c >= 12}
    got = [tuple(r) for r in phrases(spark, texts, langs, 12, shards=shards, slots=slots).collect()]
    assert sorted(got) == sorted(want | {(lang, "", 0, c) for lang, c in n.items()})


@pytest.mark.parametrize("few", [None, 5])
def test_phrases_below_the_threshold_have_no_texts(monkeypatch, few):
    """Rows of a phrase's text begin at the scan after its hash reached the
    threshold; counts of texts stay exact where words share hashes."""
    if few:
        plain = collocations.hashes
        monkeypatch.setattr(collocations, "hashes", lambda words: plain(words) % np.uint64(few))
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefghijklmnop") if rng.random() < .5 else "x y z" for _ in range(60)) for _ in range(40)]
    shards, least, reached = 4, 20, np.full(1 << 22, collocations.NEVER, dtype=np.uint8)
    counts, exact, step, last = collections.Counter(), collections.Counter(), 0, 3
    while step <= last:
        seen = reached.copy()
        for batch in collocations.scan_texts("en", [t.encode() for t in texts[step % shards::shards]], seen, step, shards, 5):
            for r in batch.to_pylist():
                if r["phrase"] is None:
                    counts[r["h"], r["kind"]] += r["c"]
                elif r["kind"]:
                    exact[r["phrase"]] += r["c"]
        slot = collocations.slots_of(np.array([h for (h, _), c in counts.items() if c >= least], np.int64).view(np.uint64), len(reached))
        free = slot[reached[slot] == collocations.NEVER]
        reached[free] = step
        last, step = max(last, step + shards if len(free) else 0), step + 1
    want, _ = brute.phrase_counts([("en", t) for t in texts])
    want = {" ".join(w): c for (_, w), c in want.items()}
    assert {p: c for p, c in exact.items() if c >= least} == {p: c for p, c in want.items() if c >= least}
    assert all(c == want[p] for p, c in exact.items())
    assert few or sum(c < least for c in exact.values()) <= 2 and len(exact) < len(counts) / 3     # hardly a slot is shared


def test_collocations(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["big data", "data", "big", "the one and only", "only", "one", "z"]) for _ in range(30)) + ";"
             for _ in range(150)]
    langs = [rng.choice(["en", "fr", None]) for _ in texts]
    for least, top in ((30, 2000), (5, 7)):
        got = collocations.mine(rows_of(spark, texts, langs), min_count=least, top=top, slots=1 << 12).collect()
        assert sorted(map(tuple, got)) == sorted(brute.collocations(list(zip(langs, texts)), least, top))
    assert collocations.mine(rows_of(spark, texts).filter("false")).collect() == []


def test_products_beyond_64_bits(spark):
    big = 10 ** 15
    rows = [("en", "", 0, 9 * big), ("en", "a", 1, 7 * big + 1), ("en", "b", 1, 5 * big + 3), ("en", "a b", 2, 3 * big + 7)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, words int, c bigint")
    assert collocations.collocations(counts).first()["score"] == 1000 * (3 * big + 7) * 9 * big // ((7 * big + 1) * (5 * big + 3))


def test_arguments(spark):
    docs = rows_of(spark, ["a"])
    for kw in ({"shards": 100}, {"slots": 100}, {"slots": 32}, {"min_count": 0}):
        with pytest.raises(ValueError):
            collocations.count_phrases(docs, **kw)


# --- spelling variants

def near(spark, words, **kw):
    df = materialize(spark.createDataFrame([(w, n) for w, n in words.items()], "word string, n bigint"), "test")
    return df, variants.near_pairs(df, **kw)


@pytest.mark.parametrize("key_pairs", [0, 3, variants.KEY_PAIRS])
@pytest.mark.parametrize("letters", ["ab", "aé×cd"])
def test_near_pairs(spark, key_pairs, letters):
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(7, 10))): rng.randint(2, 9) for _ in range(400)}
    words |= {w[:i] + w[i + 1:]: 3 for w, i in zip(list(words), itertools.cycle(range(7))) if len(w) > 7}
    words |= {"q" * k: 2 for k in range(7, 12)} | {"x" * 3000: 2, "x" * 2999 + "y": 2, "x" * 3001: 5}
    got = [tuple(sorted((r["a"], r["b"]))) for r in near(spark, words, key_pairs=key_pairs)[1].collect()]
    want = {(a, b) for a, b in itertools.combinations(sorted(words), 2) if brute.is_near(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_hot_key(spark):
    """A third of all words share all but their last letters."""
    rng = random.Random(8)
    tails = ["".join(p) for p in itertools.product("abcdefgh", repeat=3)]
    words = {"commonstem" + t: 2 for t in tails} | {"".join(rng.choice("klmnop") for _ in range(9)): 3 for _ in range(900)}
    got = near(spark, words, key_pairs=50)[1]
    assert got.count() == sum(brute.is_near(a, b) for a, b in itertools.combinations(words, 2))


def test_forms_and_roots(spark):
    words = {"grundlagen": 1_000_000, "grundlager": 30_000, "grundlabera": 5, "grundlaber": 2000, "grundlaverx": 1,
             "grundlaver": 100, "einzelwort": 9, "einzelwert": 9, "einzelwortx": 90, "einzelwirt": 900}
    df, pairs = near(spark, words)
    got = variants.with_roots(materialize(variants.forms(df, pairs), "test"))
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == brute.variants(words)
    assert len({r["root"] for r in got.collect()}) < len(words) - 3


def test_variants_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    want = brute.variants(brute.variant_words(texts))
    assert {tuple(r) for r in QUERIES["op13_variants"](spark, SF001).collect()} == want and len(want) > 1000


def test_variants_odd_rows(spark):
    texts = [None, "", "short", "WORDSÉ and Wordsé×, wordsé÷x", "repeated word repeated", "Repeated", "x" * 50_000, "x" * 50_000]
    docs = rows_of(spark, texts)
    got = {tuple(r) for r in variants.spelling_variants(docs).collect()}
    assert got == brute.variants(brute.variant_words(dict(enumerate(texts)))) and len(got) >= 2
    assert variants.spelling_variants(docs.filter("false")).collect() == []
    no_id = docs.withColumn("doc_id", F.lit(None).cast("bigint"))
    counts = {r["word"]: r["n"] for r in variants.count_words(no_id, min_length=1, drop_every=0).collect()}
    assert counts["repeated"] == 3 and counts["wordsÉ"] == 1 and counts["wordsé×"] == 1
