"""Quotation linking: reply-ordered conversations without quotes.

Lines that begin with ``>`` are quotes, as deep as they have marks. Quoted passages, paragraphs and their sentences,
are reduced to their words and hashed, and joined by hash to the message of the same conversation that says them
first in its own words. A message replies to the message that it quotes most, by words, at its lowest quote level.
Its text is what is left without quotes and without the line that introduces one.

A thread is a tree of replies. Its order is that of a walk that goes into the replies of a message, the earliest
first, before it goes on beside it: messages get their place from the lists that such a walk links, whose sums are
taken over twice the distance in every round. A conversation is written in that order, in pieces of at most ``PIECE``
messages.

Defined cases: a null text is a message without text; a message that quotes nothing known has no ``reply_to`` and
begins a thread; passages that the quoting message says itself or that are said first in a later turn link nothing;
ties go to the earliest turn; rows of one conversation and turn are one message for the links and keep their own
texts; a null conversation or turn links nothing; columns beyond the named ones are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .arrow import add_columns, stored

_MARK = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: Lines that introduce a quote, in several languages, and the rule above a forwarded message.
_INTRODUCTION = re.compile(
    r"^\s*(?:(?:on|am|le|el|em|il|op)\b.{0,200}\b(?:wrote|writes|schrieb\b.{0,80}|a écrit|escribió|escreveu|ha scritto|schreef\b.{0,80})\s*:"
    r"|.{1,80}\b(?:wrote|said|schrieb|escribió)\s*:|-{2,}\s*(?:original message|forwarded message|ursprüngliche nachricht|message d'origine)\s*-{2,})\s*$",
    re.I,
)
#: Messages of a written piece of a conversation.
PIECE = 64
#: Sentences of fewer words link nothing by themselves; a whole paragraph does.
LEAST_WORDS = 3

UNIT = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("words", T.IntegerType())])
FIELDS = [("own", T.StringType()), ("n_quotes", T.LongType()), ("units", T.ArrayType(UNIT))]


def parse(text: str | None) -> tuple[str | None, list[tuple[int, str]]]:
    """The text without quotes, and its passages as (quote level, text); level 0 is the message's own."""
    if text is None:
        return None, []
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = -1
    for line in re.split(r"\r\n|\r|\n", text):
        mark = _MARK.match(line)
        level = mark[1].count(">") if mark else 0
        rest = line[mark.end() :] if mark else line
        if level and last == 0:
            while own and not own[-1].strip():
                own.pop()
            if own and _INTRODUCTION.match(own[-1]):
                own.pop()
                if passages and passages[-1][1]:
                    passages[-1][1].pop()
        if not level:
            own.append(rest)
        if not rest.strip() or level != last:
            passages.append((level, []))
        if rest.strip():
            passages[-1][1].append(rest)
        last = level
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip(), [(level, "\n".join(p)) for level, p in passages if p]


def _units(messages: list[list[tuple[int, str]]]) -> list[list[dict]]:
    """(level, hash, words) of the passages of each message and of their sentences; the hash is of the words alone."""
    texts, of, levels, whole = [], [], [], []
    for k, passages in enumerate(messages):
        for level, passage in passages:
            sentences = _SENTENCE.split(passage)
            for i, part in enumerate([passage, *(sentences if len(sentences) > 1 else [])]):
                texts.append(part)
                of.append(k)
                levels.append(level)
                whole.append(i == 0)
    out: list[list[dict]] = [[] for _ in messages]
    if not texts:
        return out
    hashes, _, _, offsets = words.word_hashes(*words.utf8(pa.array(texts, pa.string())))
    found, counts = words.sequence_hashes(hashes, offsets).view(np.int64).tolist(), np.diff(offsets).tolist()
    for k, level, first, value, n in zip(of, levels, whole, found, counts, strict=True):
        if n >= (1 if first else LEAST_WORDS):
            out[k].append({"level": level, "hash": value, "words": n})
    return out


def parsed(messages: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, own text, number of quoted passages, and hashed passages of every message."""

    def make():
        def function(column: pa.Array):
            rows = [parse(x) for x in column.to_pylist()]
            return [o for o, _ in rows], [sum(level > 0 for level, _ in p) for _, p in rows], _units([p for _, p in rows])

        return function

    return add_columns(messages, text, keep, FIELDS, make)


def replies(found: DataFrame, conversation: str, turn: str) -> DataFrame:
    """(conversation, turn, reply_to, n_linked) of the messages that quote a known one."""
    units = found.filter(F.col(conversation).isNotNull() & F.col(turn).isNotNull()).select(
        F.col(conversation).alias("c"), F.col(turn).alias("t"), F.explode("units").alias("u")
    )
    units = units.select("c", "t", "u.level", "u.hash", "u.words").distinct()
    said = units.filter("level = 0").groupBy("c", "hash").agg(F.min("t").alias("said"))
    quoted = units.filter("level > 0")
    votes = quoted.join(said, ["c", "hash"]).filter("said < t").groupBy("c", "t", "level", "said").agg(F.sum("words").alias("votes"), F.count("*").alias("n"))
    # The lowest level that links at all, and there the message with most words; sums come first, so groups are small.
    best = votes.groupBy("c", "t").agg(F.min(F.struct("level", -F.col("votes"), "said")).alias("best"), F.sum("n").alias("n_linked"))
    return best.select("c", "t", F.col("best.said").alias("reply_to"), "n_linked")


def threads(links: DataFrame) -> DataFrame:
    """(c, t, thread, depth): first message above each linked one, and the links between them.

    Every round doubles the distance that a link spans; a reply's turn is above its parent's, so there is no ring.
    """
    now = stored(links.select("c", "t", F.col("reply_to").alias("thread"), F.lit(1).alias("depth")), "threads")
    while True:
        above = now.select("c", F.col("t").alias("thread"), F.col("thread").alias("_up"), F.col("depth").alias("_more"))
        step = now.join(above, ["c", "thread"], "left")
        now = stored(step.select("c", "t", F.coalesce("_up", "thread").alias("thread"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), F.col("_up").isNotNull().alias("moved")), "threads")
        if not now.filter("moved").limit(1).count():
            return now.drop("moved")
        now = now.drop("moved")


def positions(links: DataFrame, tops: DataFrame) -> DataFrame:
    """(c, t, position): the place of each linked message in the walk through its thread; the first message has 0.

    ``links`` has (c, t, reply_to), ``tops`` (c, t, thread). Replies to one message are ordered in one task.
    """
    siblings = Window.partitionBy("c", "reply_to").orderBy("t")
    edges = stored(links.select("c", "t", "reply_to", F.lead("t").over(siblings).alias("_beside"), F.row_number().over(siblings).alias("_nth")), "edges")
    # The walk enters a message and leaves it again: entering goes on to the first reply, or leaves; leaving goes on to
    # the next reply of the same message, or leaves that message.
    first = edges.filter("_nth = 1").select("c", F.col("reply_to").alias("t"), F.col("t").alias("_first"))
    roots = tops.select("c", F.col("thread").alias("t")).distinct()
    nodes = edges.select("c", "t").unionByName(roots).join(first, ["c", "t"], "left")
    into = nodes.select("c", "t", F.lit(True).alias("entering"), F.coalesce("_first", "t").alias("_to"), F.col("_first").isNotNull().alias("_into"))
    out_of = edges.select("c", "t", F.lit(False).alias("entering"), F.coalesce("_beside", "reply_to").alias("_to"), F.col("_beside").isNotNull().alias("_into"))
    ends = roots.select("c", "t", F.lit(False).alias("entering"), F.lit(None).cast(roots.schema["t"].dataType).alias("_to"), F.lit(False).alias("_into"))
    steps = into.unionByName(out_of).unionByName(ends)
    now = stored(steps.withColumn("left", F.col("entering").cast("long")), "walk")  # messages entered from here on
    while now.filter("_to IS NOT NULL").limit(1).count():
        ahead = now.select("c", F.col("t").alias("_to"), F.col("entering").alias("_into"), F.col("_to").alias("_far"), F.col("_into").alias("_far_into"), F.col("left").alias("_more"))
        joined = now.join(ahead, ["c", "_to", "_into"], "left")
        now = stored(joined.select("c", "t", "entering", F.col("_far").alias("_to"), F.coalesce("_far_into", F.lit(False)).alias("_into"), (F.col("left") + F.coalesce("_more", F.lit(0))).alias("left")), "walk")
    entered = now.filter("entering").select("c", "t", "left")
    whole = entered.join(roots, ["c", "t"]).select("c", F.col("t").alias("thread"), F.col("left").alias("_size"))
    return entered.join(tops.select("c", "t", "thread"), ["c", "t"]).join(whole, ["c", "thread"]).select("c", "t", (F.col("_size") - F.col("left")).alias("position"))


def link_quotes(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every message without its quotes, with the message it replies to, its thread, depth, position and chat form.

    A conversation in reply order is sorted by thread, position and turn: a message always follows the one it replies
    to, and no message of another branch stands between a reply and what it is a reply to but earlier replies to it.
    """
    named = messages.select(F.col(conversation).alias("_c"), F.col(turn).alias("_t"), F.col(role).alias("_role"), F.col(text).alias("_text"))
    found = stored(parsed(named, ["_c", "_t", "_role"], "_text"), "messages")
    links = stored(replies(found, "_c", "_t"), "links")
    tops = threads(links).join(links, ["c", "t"])
    if links.limit(1).count():
        tops = tops.join(positions(links, tops), ["c", "t"])
    else:
        tops = tops.withColumn("position", F.lit(0).cast("long"))
    joined = found.join(tops, (F.col("_c") == F.col("c")) & (F.col("_t") == F.col("t")), "left")
    return joined.select(
        F.col("_c").alias(conversation), F.col("_t").alias(turn), F.col("_role").alias(role), F.col("own").alias("text"), "reply_to",
        F.coalesce("thread", "_t").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("position", F.lit(0)).alias("position"),
        "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.concat(F.lit("<|"), F.coalesce("_role", F.lit("user")), F.lit("|>\n"), F.coalesce("own", F.lit("")), F.lit("<|end|>\n")).alias("chat"),
    )


def conversations(linked: DataFrame, conversation: str = "conv_id", turn: str = "turn", piece: int = PIECE) -> DataFrame:
    """(conversation, thread, piece, n_messages, chat): the threads of linked messages, written in reply order.

    A piece has the messages of ``piece`` places; rows of one turn share a place, in the order of their texts.
    """
    row = F.struct("position", F.col(turn).alias("turn"), "chat")
    grouped = linked.groupBy(conversation, "thread", F.floor(F.col("position") / piece).alias("piece"))
    return grouped.agg(F.count("*").alias("n_messages"), F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["chat"]), "").alias("chat"))


def report(messages: DataFrame) -> DataFrame:
    """One row per message."""
    return link_quotes(messages)
