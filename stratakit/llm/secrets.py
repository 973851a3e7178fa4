"""Secret scans over an incremental ledger of blobs.

Every version of a text is a *path* (its id) that points to a *blob* named by
the SHA-256 of its bytes.  The ledger holds one row for each blob and rule
version that has been scanned, with the spans found.  A scan takes the blobs
that the ledger does not have under the current rule version, one copy of
each, scans only these, adds their rows to the ledger, and joins findings back
to all paths.  A rule change is a new rule version, under which all blobs are
unseen.

All work is DataFrame functions.  A rule is a pattern and a test of its
match; matches are leftmost and non-overlapping within a rule.  Their places
come from splitting the text at the same pattern: the pieces between matches
and the matches themselves give running offsets in code points.

A blob that a third of all paths share is one row before the scan (partial
aggregation), and the join back is a plain join of two written tables, whose
large partitions Spark splits.

Defined results: a null text is the empty blob; an empty table gives an empty
result; repeated paths each get their row; a null id is a path like others;
all columns of the table pass through in ``redact``, whatever their names; a
very long text or one of very many matches is scanned in time nearly in
proportion to them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, free_name, grown, materialize

#: One version for all rules below; to be raised with any change to them.
RULE_VERSION = "1"


@dataclass(frozen=True)
class Rule:
    """``pattern``: Java regular expression.  A match counts if group
    ``group`` has ``least`` characters or more."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True


# The three base rules, then those that the method adds.
RULES = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    # a run of 20 or more holds a match exactly where the longest run from AKIA does
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1, False),
    Rule("bearer", r"(?i)bearer\x20+([A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 0, 1, False),
)

SPAN = "struct<start:int,rank:int,stop:int,kind:string>"
SPANS = f"array<{SPAN}>"


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans as an array, in order; ``text`` is not null."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    # (match, gap before it, length of the tested group)
    parts = F.arrays_zip(whole.alias("m"), F.split(text, rule.pattern, -1).alias("gap"), tested.alias("t"))
    # split gives one piece more than there are matches; that one has no match
    parts = F.slice(parts, F.lit(1), F.size(whole))

    def step(acc, p):
        begin = acc["at"] + F.length(p["gap"])
        stop = begin + F.length(p["m"])
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"),
                        F.lit(rule.kind).alias("kind"))
        return F.struct(stop.alias("at"), F.when(F.length(p["t"]) >= rule.least, F.concat(acc["found"], F.array(span)))
                        .otherwise(acc["found"]).alias("found"))

    walked = in_groups(parts, lambda p: F.length(p["gap"]) + F.length(p["m"]), lambda a, b: a + b, step, SPANS)
    return F.when(text.rlike(rule.pattern), walked).otherwise(F.array().cast(SPANS))


def in_groups(rows: Column, move, join, step, kind: str) -> Column:
    """A fold over an array that appends to a list, in groups of about the
    square root of its length: appending copies the list, so one list for all
    would take time with the square of their number.

    ``move`` gives what an element adds to the place, ``join`` adds two such;
    ``step`` takes (place so far ``at``, list ``found``) and an element.  The
    result is the list of the whole fold."""
    def split(r):
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(r))).cast("int"))
        return F.when(F.size(r) > 0, F.transform(F.sequence(F.lit(1), F.size(r), size), lambda i: F.slice(r, i, size)))

    def folded(groups):
        sums = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda a, r: join(a, move(r))))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(join(F.element_at(a, -1), s))))
        each = F.zip_with(groups, starts, lambda g, at: F.when(g.isNotNull(), F.aggregate(
            g, F.struct(at.alias("at"), F.array().cast(kind).alias("found")), step)["found"]))
        return F.flatten(F.filter(each, lambda e: e.isNotNull()))

    return F.coalesce(bound(rows, lambda r: bound(split(r), folded)), F.array().cast(kind))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows (blob, rule_version, spans) of a table (blob, text); spans
    are ordered by start, then by the rules' order."""
    found = F.array_sort(F.concat(*[rule_spans(F.col("text"), r, i) for i, r in enumerate(rules)]))
    return blobs.select("blob", F.lit(version).alias("rule_version"), found.alias("spans"))


def _scanned(named: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...],
             version: str) -> tuple[DataFrame, DataFrame]:
    """(ledger rows under ``version``, those of them that are new) of the
    blobs of ``named`` (blob, text); only unseen blobs are scanned."""
    unseen = named
    if ledger is not None:
        unseen = named.join(ledger.filter(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    blobs = unseen.select("blob", "text").dropDuplicates(["blob"])
    new = materialize(scan_blobs(blobs, rules, version), "ledger")
    known = new if ledger is None else new.unionByName(
        ledger.filter(F.col("rule_version") == version).select("blob", "rule_version", "spans"))
    return known, new


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger kept in the folder ``path``; None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan_versions(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
                  version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings, new ledger rows).

    ``findings``: (id, blob, spans), one row a path.  ``ledger``: rows of
    earlier scans, or None; only blobs not in it under ``version`` are read
    and scanned.  To keep the ledger, append the new rows to it."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = versions.select(F.col(id_col).alias("id"), text.alias("text"), F.sha2(text, 256).alias("blob"))
    known, new = _scanned(named, ledger, rules, version)
    paths = named.select("id", "blob")
    # Most blobs have no span; only those with one need to be joined back.
    hits = known.filter(F.size("spans") > 0).select("blob", "spans")
    findings = (paths.join(grown(hits), "blob", "left")
                .select("id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")))
    return findings, new


def redact_versions(versions: DataFrame, text_col: str = "text", mark: str = "[SECRET]",
                    ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
                    version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(``versions`` with every span found replaced by ``mark``, overlapping
    or touching spans by one; new ledger rows).

    ``ledger`` is as in ``scan_versions``: only blobs not in it under
    ``version`` are scanned, and only those with a span are joined back."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blob, spans = free_name(versions, "blob"), free_name(versions, "spans")
    named = versions.withColumn(blob, F.sha2(text, 256))
    known, new = _scanned(named.select(F.col(blob).alias("blob"), text.alias("text")), ledger, rules, version)
    hits = known.filter(F.size("spans") > 0).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    clean = F.when(F.col(spans).isNotNull(), clean_text(text, F.col(spans), mark)).otherwise(F.col(text_col))
    return (named.join(grown(hits), blob, "left").withColumn(text_col, clean).select(*versions.columns)), new


def redact(versions: DataFrame, text_col: str = "text", mark: str = "[SECRET]",
           rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION,
           ledger: DataFrame | None = None) -> DataFrame:
    """The clean table of ``redact_versions`` alone."""
    return redact_versions(versions, text_col, mark, ledger, rules, version)[0]


#: Code points of a block in which a place of a text is looked up.
BLOCK = 1024


def clean_text(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with ordered ``spans`` replaced by ``mark``."""
    return bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)),
                 lambda blocks: _cleaned(text, blocks, spans, mark))


def _cleaned(text: Column, blocks: Column, spans: Column, mark: str) -> Column:
    def between(begin, end):
        """Code points [begin, end), looked up in the blocks that have them."""
        first = F.floor(begin / BLOCK).cast("int")
        count = F.floor((end - 1) / BLOCK).cast("int") - first + 1
        near = F.array_join(F.slice(blocks, first + 1, F.greatest(count, F.lit(0))), "")
        return F.when(end > begin, F.substring(near, begin - first * BLOCK + 1, end - begin)).otherwise(F.lit(""))

    def step(acc, s):
        # a span inside what is already covered adds nothing; one that begins
        # there only moves the end
        fresh = (s["start"] > acc["at"]) | (s["start"] == 0)
        piece = F.struct(between(acc["at"], s["start"]).alias("gap"), F.lit(mark).alias("mark"))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"),
                        F.when(fresh & (s["stop"] > acc["at"]), F.concat(acc["found"], F.array(piece)))
                        .otherwise(acc["found"]).alias("found"))

    pieces = in_groups(spans, lambda s: s["stop"], lambda a, b: F.greatest(a, b), step, "array<struct<gap:string,mark:string>>")
    end = F.coalesce(F.array_max(F.transform(spans, lambda s: s["stop"])), F.lit(0))
    return F.concat(F.array_join(F.transform(pieces, lambda p: F.concat(p["gap"], p["mark"])), ""),
                    between(end, F.length(text)))


def spans_text(spans: Column, base_only: bool = False) -> Column:
    """kind:start:end of each span, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin([r.kind for r in RULES if r.base])) if base_only else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                  s["stop"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
