"""Quotation linking of messages.

Lines that begin with ``>`` quote an earlier message, each further ``>`` one
level deeper.  A message is parsed into passages, runs of lines of one level.
Normalised passages and their lines are hashed; quoted ones are joined to the
latest earlier message of the same conversation that has the same hash in its
own (unquoted) text.  A message replies to the message that most of its
outermost matched quotes come from, or else to the one before it.  The result
has messages in reply order, each after the one it replies to, without quotes.

All DataFrame functions.  Own passages go into the join only where a quote has
their hash; the as-of join runs in bounded buckets of turns, so a line or a
conversation that holds a third of all rows is spread over tasks.

``position`` counts the different earlier turns of the conversation.

Defined results: a null text is empty; a message without conversation or turn
gets no link and no position; messages of one conversation and turn share
their position and don't see each other, and each row gets its result;
passages and lines without a letter or digit are not linked by; an empty table
gives an empty result; other columns are not carried, whatever their names; a
very long text of very many levels is parsed in time in proportion to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, grown, latest_earlier, materialize, rank_in_key

_QUOTE = r"^(?:[ \t]*>)+"
PASSAGES = "array<struct<level:int,text:string>>"


def passages(text: Column) -> Column:
    """The text's runs of lines of one quote level, in order."""
    prefix = lambda line: F.regexp_extract(line, _QUOTE, 0)
    lines = F.transform(F.split(text, "\r?\n", -1), lambda line: F.struct(
        F.length(F.regexp_replace(prefix(line), "[^>]", "")).alias("level"),
        F.regexp_replace(line, _QUOTE + "[ \t]?", "").alias("body")))
    # a run begins where the level changes; a line is looked up by its place
    def begins(own):
        changes = F.transform(own, lambda line, i: F.when((i == 0) | (line["level"] != F.get(own, i - 1)["level"]), i))
        return F.filter(changes, lambda i: i.isNotNull())

    def runs(own, first):
        return F.transform(first, lambda i, k: F.struct(
            F.get(own, i)["level"].alias("level"),
            F.array_join(F.transform(F.slice(own, i + 1, F.coalesce(F.get(first, k + 1), F.size(own)) - i),
                                     lambda line: line["body"]), "\n").alias("text")))

    parsed = bound(lines, lambda own: bound(begins(own), lambda first: runs(own, first)))
    whole = F.array(F.struct(F.lit(0).alias("level"), F.regexp_replace(text, "\r\n", "\n").alias("text"))).cast(PASSAGES)
    return F.when(text.rlike("(?m)^[ \t]*>"), parsed.cast(PASSAGES)).otherwise(whole)


def normal(text: Column) -> Column:
    """Lower case, white space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def units(text: Column) -> Column:
    """Hashes of a passage as a whole and of its lines, normalised."""
    parts = F.concat(F.array(normal(text)), F.transform(F.split(text, "\r?\n", -1), normal))
    return F.transform(F.array_distinct(F.filter(parts, lambda t: t.rlike(r"[\p{L}\p{N}]"))),
                       lambda t: F.sha2(t, 256))


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> DataFrame:
    """(conv, turn, role, position, reply_to, link, n_quotes, max_level,
    n_linked, text): ``reply_to`` is a turn, ``link`` quote, previous or none;
    ``n_quotes`` counts quoted passages, ``n_linked`` hashes found again."""
    parsed = messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).alias("role"),
        passages(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("parts"))
    parsed = parsed.select(
        "conv", "turn", "role", "parts",
        F.trim(F.array_join(F.transform(F.filter("parts", lambda p: p["level"] == 0), lambda p: p["text"]), "\n"))
        .alias("text"),
        F.size(F.filter("parts", lambda p: p["level"] > 0)).cast("bigint").alias("n_quotes"),
        F.array_max(F.transform("parts", lambda p: p["level"])).alias("max_level"))
    placed = parsed.filter("conv is not null and turn is not null")

    def hashes(quoted: bool) -> DataFrame:
        wanted = F.filter("parts", lambda p: p["level"] > 0 if quoted else p["level"] == 0)
        rows = placed.filter("n_quotes > 0") if quoted else placed
        return (rows.select("conv", "turn", F.explode(wanted).alias("p"))
                .select("conv", "turn", F.col("p.level").alias("level"), F.explode(units(F.col("p.text"))).alias("unit")))

    quoted = materialize(hashes(True).groupBy("conv", "turn", "unit").agg(F.min("level").alias("level")), "quotes")
    # Own passages only where some quote of the conversation has their hash.
    asked = quoted.select("conv", "unit").distinct()
    own = hashes(False).join(asked, ["conv", "unit"], "left_semi").select("conv", "turn", "unit").distinct()
    events = (own.select("conv", "turn", "unit", F.col("turn").alias("source"), F.lit(None).cast("int").alias("level"))
              .unionByName(quoted.select("conv", "turn", "unit", F.lit(None).cast("bigint").alias("source"), "level")))
    found = (latest_earlier(events, ["conv", "unit"], "turn", "source", "from_turn")
             .filter("level is not null and from_turn is not null"))
    # Votes: the outermost level that has any, then the most hashes, then the
    # latest message.
    votes = found.groupBy("conv", "turn", "level", "from_turn").agg(F.count("*").alias("n"))
    best = F.max(F.struct((-F.col("level")).alias("l"), "n", "from_turn")).alias("b")
    replies = votes.groupBy("conv", "turn").agg(best, F.sum("n").alias("n_linked")).select(
        "conv", "turn", F.col("b.from_turn").alias("quoted_turn"), "n_linked")
    replies = materialize(replies, "replies")

    # One row a (conversation, turn) carries order and predecessor.
    turns = placed.select("conv", "turn")
    counted = turns.groupBy("conv", "turn").agg(F.count("*").alias("n")).withColumn("value", F.col("turn"))
    before = latest_earlier(counted, ["conv"], "turn", "value", "previous")
    ranked = rank_in_key(before, ["conv"], "turn", "position").select("conv", "turn", "previous", "position")
    order = materialize(ranked, "turns")
    linked = (placed.join(grown(order), ["conv", "turn"], "left")
              .join(grown(replies), ["conv", "turn"], "left"))
    out = [F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col)]
    done = linked.select(
        *out, "position", F.coalesce("quoted_turn", "previous").alias("reply_to"),
        F.when(F.col("quoted_turn").isNotNull(), "quote").when(F.col("previous").isNotNull(), "previous")
        .otherwise("none").alias("link"),
        "n_quotes", "max_level", F.coalesce("n_linked", F.lit(0).cast("bigint")).alias("n_linked"), "text")
    none = F.lit(None).cast("bigint")
    rest = parsed.filter("conv is null or turn is null").select(
        *out, none.alias("position"), none.alias("reply_to"), F.lit("none").alias("link"), "n_quotes", "max_level",
        F.lit(0).cast("bigint").alias("n_linked"), "text")
    return done.unionByName(rest)
