"""Training-data pipeline: quality rules, near-duplicates, decontamination,
secrets, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.

Documents with a null or empty text fail the quality rules and leave there; an
empty table goes through all stages as one; columns of other names pass through up to packing, whatever their names;
very long texts go through whole; near-duplicates leave one document,
with ids or without, and rows of one id with other texts are documents of
their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakit.llm import decontaminate, packing, quality, secrets, simhash
from stratakit.llm.common import materialize, table

#: Session settings: a lasting folder for the ledger of scanned blobs (none: every blob is scanned), and whether
#: contaminated documents stay without their spans.
LEDGER = "spark.stratakit.secrets.ledger"
CUT = "spark.stratakit.decontamination.cut"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the line field keep."""
    field = quality.fit_field(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    judged = quality.quality_rules(_prefixed(docs), field, text_col="own_text")
    return judged.filter("kept").select(*_original(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class, of its smallest id; rows without an id come last."""
    return simhash.one_a_class(docs).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the contamination limit, as they are; with ``CUT`` set
    to true the others stay too, without their contaminated spans."""
    cut = spark.conf.get(CUT, "false") == "true"
    return _with_length(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), cut_spans=cut), docs, cut)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text.
    With a folder in ``LEDGER`` only blobs that its ledger does not have are
    scanned, and theirs are added to it."""
    path = spark.conf.get(LEDGER, "")
    clean, new = secrets.redact_versions(docs, ledger=secrets.read_ledger(spark, path) if path else None)
    if path:
        new.write.mode("append").parquet(path)
    return _with_length(clean, docs)


def _with_length(changed: DataFrame, docs: DataFrame, is_changed: bool = True) -> DataFrame:
    """n_chars, where ``docs`` has it, follows the changed texts."""
    if not is_changed or "n_chars" not in docs.columns:
        return changed
    kind = docs.schema["n_chars"].dataType
    return changed.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences."""
    return packing.pack(docs, lean=True)


def _prefixed(docs: DataFrame) -> DataFrame:
    """Own column names are kept apart from those of measures."""
    return docs.select(*[F.col(c).alias(f"own_{c}") for c in docs.columns])


def _original(docs: DataFrame) -> list:
    return [F.col(f"own_{c}").alias(c) for c in docs.columns]


STAGES = [
    ("quality rules", quality_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: SQL has no line field, fingerprint or tokenizer; tests hold run() against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
