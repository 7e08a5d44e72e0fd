"""Quotation linking in conversations, in DataFrame expressions only.

Lines that begin with `>` marks are quotes, and the number of marks is their level. A run of lines of one level is a
passage; a line such as "On ... wrote:" right before a quote belongs to it. Passages are normalised (lower case, runs of white space as one blank), hashed, and joined
to the first earlier message of the conversation that says the same in its own words: the whole message, or failing
that a paragraph or a line of at least `LEAST_WORDS` words, or of `LEAST_LETTERS` letters of scripts that set no blanks. The
quote of the lowest level with a match names the message that is replied to; of several the latest. Following these
replies gives the first message of a thread, and the place of each message in it: a message comes first, then each
reply to it in the order of turns, with all that was replied to that one before the next. Conversations are in reply
order when sorted by (conversation, thread, position).

Only conversations with a quote are searched. What messages say is combined to one row per conversation and hash
before it is shuffled, so a line that everyone repeats is one row, and a conversation with a third of all rows is
spread over its hashes. Places are counted along a walk around each tree of replies, which enters and leaves every
message once. Each step back on it has one source and one target, so following it by doubling has no key of many rows,
however many reply to one message, and takes a logarithm of the longest walk in rounds. Only linked messages take part.

Defined cases: null texts are empty and quote nothing; a null conversation or turn is never linked; messages that share
conversation and turn are linked alike; a message of quotes alone has an empty text; a quote without a match is removed
all the same. Columns of the input pass through; one of a name that is added is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize

MARKS = r"^[ \t]*((?:>[ \t]?)+)"
ATTRIBUTION = r"(?i)^[ \t]*(?:on|le|am|el)\b.{0,200}\b(?:wrote|écrit|schrieb|escribió)[^\p{L}]*:[ \t]*$"
LEAST_WORDS = 3
LEAST_LETTERS = 6
NO_BLANKS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
ADDED = ("reply_to", "thread", "position", "n_quotes", "quote_levels")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _lines(text: Column) -> Column:
    """Array of (level, body, attributed): of every line its quote level and what follows the marks."""

    def one(x):
        marks = F.regexp_extract(x, MARKS, 1)
        level = F.length(marks) - F.length(F.translate(marks, ">", ""))
        return F.struct(level.alias("level"), F.when(level > 0, F.regexp_replace(x, MARKS, "")).otherwise(x).alias("body"))

    return F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), one)


def _own(lines: Column) -> Column:
    """The lines that aren't quoted and don't introduce a quote, as one text."""

    def kept(a):
        def own(x, i):
            before_quote = F.coalesce(F.get(a, i + 1)["level"] > 0, F.lit(False))
            return F.when((x["level"] == 0) & ~(before_quote & x["body"].rlike(ATTRIBUTION)), x["body"])

        return F.array_join(F.filter(F.transform(a, own), lambda x: x.isNotNull()), "\n")

    return F.trim(let(lines, kept))


def _passages(lines: Column) -> Column:
    """Array of (level, lines): runs of quoted lines of one level."""

    def runs(a):
        level = lambda i: F.get(a, i)["level"]
        starts = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (level(i - 1) != level(i)))

        def of(begins):
            stop = lambda k: F.coalesce(F.get(begins, k + 1), F.size(a))
            run = lambda b, k: F.struct(level(b).alias("level"), F.transform(F.slice(a, b + 1, stop(k) - b), lambda x: x["body"]).alias("lines"))
            return F.filter(F.transform(begins, run), lambda q: q["level"] > 0)

        return let(starts, of)

    return let(lines, runs)


def parsed(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """`messages` with __own (the text without quotes) and __quotes (array of passages)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    quoted = text.rlike(r"(?m)^[ \t]*>")
    return messages.withColumns({
        "__own": F.when(quoted, _own(_lines(text))).otherwise(text),
        "__quotes": F.when(quoted, _passages(_lines(text))),
    })


def _units(text: Column) -> Column:
    """Array of (rank, said): a text, its paragraphs and its lines, normalised; the shorter the unit, the lower its rank."""
    count = lambda x, pattern: F.regexp_count(x["said"], F.lit(pattern))
    long_enough = lambda x: (count(x, r"\S+") >= LEAST_WORDS) | (count(x, NO_BLANKS) >= LEAST_LETTERS)
    unit = lambda rank: lambda x: F.struct(F.lit(rank).alias("rank"), normalised(x).alias("said"))
    parts = F.concat(F.transform(F.split(text, r"\n[ \t]*\n"), unit(2)), F.transform(F.split(text, "\n"), unit(1)))
    whole = F.filter(F.array(unit(3)(text)), lambda x: x["said"] != "")
    return F.concat(whole, F.filter(parts, long_enough))


def reply_links(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """(conv, turn, reply_to): one row per message that quotes an earlier one."""
    rows = parsed(messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(text_col).alias("t")).filter("conv is not null and turn is not null"), "t")
    quotes = rows.filter("__quotes is not null").select("conv", "turn", F.explode("__quotes").alias("q"))
    text = F.array_join("q.lines", "\n")
    units = quotes.select("conv", "turn", F.col("q.level").alias("level"), F.explode(_units(text)).alias("u"))
    asked = materialize(units.select("conv", "turn", "level", F.col("u.rank").alias("rank"), F.md5("u.said").alias("h")).distinct(), "quoted")
    busy = materialize(asked.select("conv").distinct(), "quoting-conversations")
    said = rows.join(busy, "conv", "left_semi").select("conv", "turn", F.explode(_units(F.col("__own"))).alias("u"))
    first = said.groupBy("conv", F.md5("u.said").alias("h")).agg(F.min("turn").alias("origin"))
    first = materialize(first, "said-first")
    found = asked.join(first, ["conv", "h"]).filter("origin < turn")
    best = F.max(F.struct((-F.col("level")).alias("level"), "rank", "origin"))
    return found.groupBy("conv", "turn").agg(best.alias("b")).select("conv", "turn", F.col("b.origin").alias("reply_to"))


def _with_previous(links: DataFrame) -> DataFrame:
    """`links` with `previous`: the turn of the reply before it to the same message, if any.

    Rows are sorted over all tasks and numbered, so replies to one message may lie in many of them. What links the
    tasks is a row per task.
    """
    ordered = materialize(links.orderBy("conv", "reply_to", "turn").withColumn("no", F.monotonically_increasing_id()), "replies-in-order")
    parts = ordered.groupBy(F.shiftright("no", 33).alias("part")).agg(F.min("no").alias("no"), F.max("no").alias("last"))
    borders = parts.select("no", F.lag("last").over(Window.orderBy("part")).alias("__border"))
    numbered = ordered.join(F.broadcast(borders), "no", "left").withColumn("__before", F.coalesce("__border", F.col("no") - 1))
    before = ordered.select(F.col("no").alias("__before"), F.struct("conv", "reply_to").alias("__family"), F.col("turn").alias("__turn"))
    previous = F.when(F.col("__family") == F.struct("conv", "reply_to"), F.col("__turn"))
    return numbered.join(before, "__before", "left").select("conv", "turn", "reply_to", previous.alias("previous"))


def threads(links: DataFrame) -> DataFrame:
    """(conv, turn, reply_to, thread, position): the first message of its tree of replies, and the place in reply order.

    `links` is a written table; a first message has position 0 and no row.
    """
    replies = materialize(_with_previous(links), "replies")
    inner = links.select("conv", F.col("turn").alias("reply_to"), F.lit(True).alias("inner"))
    eldest = replies.filter("previous is null").join(inner, ["conv", "reply_to"], "left")
    last = links.groupBy("conv", F.col("reply_to").alias("turn")).agg(F.max("turn").alias("last"))
    # steps back from entering (side 0) or leaving (side 1) a message; a step to a first message is an end
    walk = (
        eldest.selectExpr("conv", "turn as n", "0 as side", "if(inner, reply_to, null) as to_n", "0 as to_side", "1L as position", "if(inner, null, reply_to) as thread")
        .unionByName(replies.filter("previous is not null").selectExpr("conv", "turn as n", "0 as side", "previous as to_n", "1 as to_side", "1L as position", "null as thread"))
        .unionByName(links.join(last, ["conv", "turn"], "left").selectExpr("conv", "turn as n", "1 as side", "coalesce(last, turn) as to_n", "if(last is null, 0, 1) as to_side", "0L as position", "null as thread"))
    )
    walk = materialize(walk, "reply-walk")
    while not (going := walk.filter("to_n is not null")).isEmpty():
        step = walk.selectExpr("conv", "n as to_n", "side as to_side", "to_n as next_n", "to_side as next_side", "position as more", "thread as end")
        moved = going.join(step, ["conv", "to_n", "to_side"]).selectExpr("conv", "n", "side", "next_n as to_n", "next_side as to_side", "position + more as position", "end as thread")
        walk = materialize(walk.filter("to_n is null").unionByName(moved), "reply-walk")
    return links.join(walk.filter("side = 0").select("conv", F.col("n").alias("turn"), "thread", "position"), ["conv", "turn"])


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """`messages` with quotes removed from their texts, and reply_to, thread, position, n_quotes (passages), quote_levels (the highest).

    Sorted by conversation, `thread` and `position` they are in reply order.
    """
    links = materialize(reply_links(messages, conv_col, turn_col, text_col), "reply-links")
    followed = materialize(threads(links), "reply-threads").select(F.col("conv").alias("__c"), F.col("turn").alias("__t"), F.col("reply_to").alias("__r"), F.col("thread").alias("__h"), F.col("position").alias("__p"))
    rows = parsed(messages, text_col)
    out = rows.join(followed, (rows[conv_col] == F.col("__c")) & (rows[turn_col] == F.col("__t")), "left")
    levels = F.array_max(F.transform("__quotes", lambda q: q["level"]))
    out = out.withColumns({
        text_col: F.col("__own"),
        "reply_to": F.col("__r"),
        "thread": F.coalesce("__h", turn_col),
        "position": F.coalesce("__p", F.lit(0).cast("long")),
        "n_quotes": F.coalesce(F.size("__quotes"), F.lit(0)),
        "quote_levels": F.coalesce(levels, F.lit(0)),
    })
    return out.drop("__own", "__quotes", "__c", "__t", "__r", "__h", "__p")
