"""Conversations without quotes: quoted passages are linked to the messages they stem from.

Lines that begin with `>` marks are quotes; their number is the level. Consecutive lines of a level form a passage.
Passages and messages are cut into sentences, which are normalised and hashed. In a conversation, each hash belongs to
the earliest message that says it itself; a passage stems from the message that owns most of its sentences. Messages
are numbered in the order of replies within their conversation. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

_QUOTE = r"^[ \t]{0,3}((?:>[ \t]?)++)"  # possessive: the regex engine loops where it would else recurse
_SPACE = " \t\n\x0b\f\r"
# Lines that announce a quote in mail: how they begin and end before the colon, if not by `schrieb` (fixed values).
_ANNOUNCES = [("on ", " wrote"), ("le ", " a écrit"), ("el ", " escribió")]
_SAYS = (" wrote", " said", " writes")
_LONGEST = 80  # characters before _SAYS


def _announces(line: Column) -> Column:
    """Whether a line announces a quote: `On Monday, Ann wrote:`, `Am Montag schrieb Ann:`, `Ann said:`. In linear time."""
    whole = F.rtrim(F.lower(line), F.lit(_SPACE))
    before = F.rtrim(F.left(whole, F.length(whole) - 1), F.lit(_SPACE))
    text = F.ltrim(before, F.lit(_SPACE))
    holds = [text.startswith(a) & text.endswith(b) & (F.length(text) > len(a + b)) for a, b in _ANNOUNCES]
    holds.append(text.startswith("am ") & (F.locate(" schrieb", text, 5) > 0))
    for end in _SAYS:
        left = F.left(before, F.length(before) - len(end))
        holds.append(before.endswith(end) & (left != "") & (F.length(F.ltrim(left, F.lit(_SPACE))) <= _LONGEST))
    return whole.endswith(":") & reduce(lambda a, b: a | b, holds)


def parsed(text: Column) -> tuple[Column, Column]:
    """The text without quotes, and its passages: array of level and text."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    levels = F.transform(lines, lambda x: F.length(F.regexp_replace(F.regexp_extract(x, _QUOTE, 1), r"[^>]", "")))
    bodies = F.transform(lines, lambda x: F.regexp_replace(x, _QUOTE, ""))
    # Held in structs, so that no expression is worked out again for every line.
    one = F.transform(F.array(F.struct(lines.alias("lines"), levels.alias("levels"), bodies.alias("bodies"))), lambda s: F.struct(s["lines"], s["levels"], s["bodies"], _starts(s["levels"]).alias("starts")))
    at = lambda s, k: F.get(s["levels"], k)

    def own(s: Column) -> Column:
        said = F.filter(s["lines"], lambda line, k: (at(s, k) == 0) & ~((F.coalesce(at(s, k + 1), F.lit(0)) > 0) & _announces(line)))
        return F.regexp_replace(F.btrim(F.array_join(said, "\n"), F.lit(_SPACE)), r"\n{3,}", "\n\n")

    def passages(s: Column) -> Column:
        till = lambda i: F.coalesce(F.get(s["starts"], i + 1), F.size(s["levels"]))
        runs = F.transform(s["starts"], lambda k, i: F.struct(at(s, k).alias("level"), F.array_join(F.slice(s["bodies"], k + 1, till(i) - k), "\n").alias("text")))
        return F.filter(runs, lambda r: r["level"] > 0)

    quoted = text.rlike(r"(?m)^[ \t]{0,3}>")
    body = F.when(quoted, F.get(F.transform(one, own), 0)).otherwise(text)
    found = F.when(quoted, F.get(F.transform(one, passages), 0)).otherwise(F.array().cast("array<struct<level:int,text:string>>"))
    return body, found


def _starts(levels: Column) -> Column:
    """Where a level differs from that of the line before."""
    return F.filter(F.sequence(F.lit(0), F.size(levels) - 1), lambda k: (k == 0) | (F.get(levels, k) != F.get(levels, k - 1)))


def sentences(text: Column) -> Column:
    """Distinct hashes of the normalised sentences: lower-case letters and digits, one space between words."""
    parts = F.split(F.regexp_replace(text, r"\s+", " "), r"(?<=[.!?]) ")
    plain = F.transform(parts, lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " ")))
    return F.array_distinct(F.transform(F.filter(plain, lambda x: x != ""), lambda x: F.xxhash64(x)))


def _sorted_messages(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct messages sorted over all tasks by conv_id, thread and turn, nulls last; `at` rises in that order."""
    order = [F.col("conv_id"), F.col("thread").asc_nulls_last(), F.col("turn").asc_nulls_last()]
    n = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = messages.where("conv_id is not null").select("conv_id", "thread", "turn").distinct()
    return scratch.keep(nodes.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))


def _positions(nodes: DataFrame) -> DataFrame:
    """conv_id, turn and position. One conversation may span many tasks of the sort: a place is that within a task's part
    of the conversation, after what earlier tasks hold of it."""
    nodes = nodes.withColumn("part", F.shiftright("at", 33))
    held = nodes.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return nodes.join(held, ["conv_id", "part"]).select("conv_id", "turn", (F.col("at") - F.col("first") + F.col("before")).alias("position"))


def link_quotes(messages: DataFrame, rounds: int = 64) -> DataFrame:
    """Conversations without quotes: each message with the one it replies to and its place in the order of replies.

    Takes conv_id, turn, role and text. Returns for each row conv_id, turn, role, content (text without quotes),
    formatted (role tag and content), n_quotes (passages), n_linked (passages whose source was found), parent_turn (the
    message that its quotes of the first level stem from, most sentences first, then the latest), thread (turn
    of the first message that replies lead back to), depth (replies on the way) and position (from 0 in each conversation,
    thread by thread, each by turn, so every message follows the one it replies to). A message has no parent if it
    quotes nothing that was said earlier in its conversation. Rows with a null conv_id or turn link with nothing; without
    conv_id they have no position, without turn the last. Rows that share conv_id and turn are one message to those that
    quote it, and share its position. Null and empty texts have null and empty content. Chains of replies over 2 ** rounds
    are an error.
    """
    spark = messages.sparkSession
    scratch = Scratch(spark)
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    body, found = parsed(F.col("text"))
    rows = scratch.keep(rows.select("conv_id", "turn", "role", body.alias("content"), found.alias("passages")))
    node = ["conv_id", "turn"]
    known = rows.where("conv_id is not null and turn is not null")
    quotes = known.where("size(passages) > 0").select(*node, F.posexplode("passages").alias("k", "p")).select(*node, "k", F.col("p.level").alias("level"), F.explode(sentences(F.col("p.text"))).alias("h")).distinct()
    wanted = quotes.select("conv_id", "h").distinct()
    asked = wanted.select("conv_id").distinct()
    said = known.join(asked, "conv_id", "left_semi").select(*node, F.explode(sentences(F.col("content"))).alias("h"))
    first = said.join(wanted, ["conv_id", "h"], "left_semi").groupBy("conv_id", "h").agg(F.min("turn").alias("source"))
    votes = quotes.join(first, ["conv_id", "h"]).where("source < turn").groupBy(*node, "k", "level", "source").agg(F.count("*").alias("n"))
    best = votes.groupBy(*node, "k", "level").agg(F.max(F.struct("n", "source")).alias("b"))
    direct = F.max(F.when(F.col("level") == 1, F.col("b")))
    found = scratch.keep(best.groupBy(*node).agg(F.count("*").alias("n_linked"), direct["source"].alias("parent_turn")))

    # Each message's first ancestor, by doubling steps.
    steps = found.where("parent_turn is not null").select(*node, F.col("parent_turn").alias("thread"), F.lit(1).cast("long").alias("depth"))
    steps = scratch.keep(steps)
    if steps.take(1):
        for _ in range(rounds):
            on = steps.select(F.col("conv_id"), F.col("turn").alias("thread"), F.col("thread").alias("_up"), F.col("depth").alias("_more"))
            longer = steps.join(on, ["conv_id", "thread"], "left")
            nxt = scratch.keep(longer.select(*node, F.coalesce("_up", "thread").alias("thread"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), F.col("_up").isNotNull().alias("moved")))
            moved = nxt.where("moved").take(1)
            steps = nxt.drop("moved")
            if not moved:
                break
        else:
            raise ValueError("a chain of replies is too long")
    linked = scratch.keep(rows.join(found, node, "left").join(steps, node, "left").withColumn("thread", F.coalesce("thread", "turn")))
    nodes = _sorted_messages(linked, scratch)
    scratch.drop_others(linked, nodes)
    places = _positions(nodes).toDF("_conv", "_turn", "position")
    out = linked.join(places, (F.col("conv_id") == F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn")), "left")
    tag = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("content", F.lit("")))
    return out.select(*node, "role", "content", tag.alias("formatted"), F.size("passages").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "parent_turn", "thread", F.coalesce("depth", F.lit(0)).alias("depth"), "position")
