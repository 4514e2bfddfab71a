"""Operator 6, chat formatting from an event log. DataFrame and SQL functions only.

A log has one row per event: ``message`` (a whole message), ``delta`` (text to append), ``edit`` (new
text) or ``regenerate`` (start over). Folding two stretches of a message's events is associative, so
a message is folded by stretches of its sequence numbers before its stretches meet, and a conversation
is rendered by blocks of turns: no task holds more than one block of messages with their markup.

The template marks a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles every ``<``,
run of backslashes, ``|`` gets one more backslash, which keeps control strings apart from text and can
be taken back; a line break in a role becomes ``<|nl|>``. The loss mask lists code point spans, one per
assistant text.

Defined cases: null texts and roles are empty; null positions and sequence numbers sort first; events
of one sequence number go by type, then text; a message with only deltas starts empty; a null
conversation is one by itself; an empty log gives an empty result; further columns are ignored. A
conversation's rendering is bounded by what one string may hold (2 GB); blocks are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
#: Sequence numbers of a stretch, and message positions of a block.
STRETCH = BLOCK = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _fold(parts: Column) -> Column:
    """Parts (in order) of (reset, role, text) folded into one."""
    zero = F.struct(F.lit(False).alias("reset"), F.lit(None).cast("string").alias("role"), F.lit("").alias("text"))

    def step(a: Column, b: Column) -> Column:
        text = F.when(b.reset, b.text).otherwise(F.concat(a.text, b.text))
        return F.struct((a.reset | b.reset).alias("reset"), F.coalesce(b.role, a.role).alias("role"), text.alias("text"))

    return F.aggregate(parts, zero, step)


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, pos, copy, role, text`` of a log ``conv_id, pos, copy, seq, type, role, text``.

    ``pos`` orders a conversation's messages, ``copy`` those of one position."""
    e = events.select("conv_id", "pos", "copy", "seq", F.floor(F.col("seq") / STRETCH).alias("stretch"), (F.col("type") != "delta").alias("reset"), "type", "role", F.coalesce("text", F.lit("")).alias("text"))
    e = e.withColumn("text", F.when(F.col("type") == "regenerate", "").otherwise(F.col("text")))
    key = ["conv_id", "pos", "copy"]
    part = e.groupBy(*key, "stretch").agg(F.sort_array(F.collect_list(F.struct("seq", "type", "text", "reset", "role"))).alias("parts"))
    part = part.select(*key, "stretch", _fold(F.transform("parts", lambda x: F.struct(x.reset.alias("reset"), x.role.alias("role"), x.text.alias("text")))).alias("f"))
    whole = part.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("stretch", "f"))).alias("parts"))
    return whole.select(*key, _fold(F.transform("parts", lambda x: x.f)).alias("m")).select(*key, F.coalesce("m.role", F.lit("")).alias("role"), "m.text")


def log_of(messages: DataFrame, delta_chars: int = 1024, discarded: str = "(a discarded draft)") -> DataFrame:
    """An event log ``conv_id, pos, copy, seq, type, role, text`` that folds into ``messages`` (``conv_id,
    pos, copy, role, text``), in no order: what a client that streams would have written.

    An assistant's message is opened empty, streams a draft, is regenerated and streams its text in
    deltas of ``delta_chars`` code points; others alternate between whole messages and a draft that an
    edit replaces. ``seq`` counts within a message; ``pos`` and ``copy`` come before it."""
    text, role = F.coalesce("text", F.lit("")), F.col("role")
    none = F.lit(None).cast("string")
    event = lambda kind, t, who=none: F.struct(F.lit(kind).alias("type"), who.alias("role"), t.alias("text"))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{delta_chars}}}"), F.lit(0))
    streamed = F.concat(F.array(event("message", F.lit(""), role), event("delta", F.lit(discarded)), event("regenerate", none)), F.transform(pieces, lambda t: event("delta", t)))
    edited = F.array(event("message", F.lit(discarded), role), event("edit", text))
    events = F.when(role == "assistant", streamed).when(F.pmod(F.col("pos"), F.lit(4)) == 0, edited).otherwise(F.array(event("message", text, role)))
    log = messages.select("conv_id", "pos", "copy", F.posexplode(events).alias("seq", "e"))
    return log.select("conv_id", "pos", "copy", F.col("seq").cast("long").alias("seq"), "e.type", "e.role", "e.text")


def render_blocks(messages: DataFrame) -> DataFrame:
    """``conv_id, block, formatted, loss_spans`` for each block of a conversation's messages, in order of ``block``."""
    m = messages.withColumn("block", F.floor(F.col("pos") / BLOCK))
    m = m.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "copy", "role", "text"))).alias("ms"))
    head = lambda x: F.concat(F.lit(START), F.replace(escape(x.role), F.lit("\n"), F.lit(BREAK)), F.lit("\n"))
    m = m.withColumn("parts", F.transform("ms", lambda x: F.struct(head(x).alias("head"), escape(x.text).alias("body"), (x.role == "assistant").alias("loss")))).drop("ms")
    spans = "cast(array() as array<struct<start: bigint, stop: bigint>>)"
    tail = len(END) + 1
    step = f"""aggregate(transform(parts, p -> struct(length(p.head) as h, length(p.body) as b, p.loss as loss)), struct(0L as at, {spans} as spans), (a, p) -> struct(a.at + p.h + p.b + {tail} as at,
        if(p.loss, array_append(a.spans, struct(a.at + p.h as start, a.at + p.h + p.b as stop)), a.spans) as spans), a -> a.spans)"""
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p.head, p.body, F.lit(END + "\n"))), "")
    return m.select("conv_id", "block", formatted.alias("formatted"), F.expr(step).alias("loss_spans"))


def conversations(blocks: DataFrame) -> DataFrame:
    """``conv_id, formatted`` of whole conversations."""
    b = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "formatted"))).alias("bs"))
    return b.select("conv_id", F.array_join(F.transform("bs", lambda x: x.formatted), "").alias("formatted"))


def parse_turns(formatted: Column) -> Column:
    """The array of (role, text) that a rendering holds."""
    turns = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")
    inner = F.transform(turns, lambda x: x.substr(F.lit(len(START) + 1), F.length(x)))
    role = lambda x: F.substring_index(x, "\n", 1)
    return F.transform(inner, lambda x: F.struct(unescape(F.replace(role(x), F.lit(BREAK), F.lit("\n"))).alias("role"), unescape(x.substr(F.length(role(x)) + 2, F.length(x))).alias("text")))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescape(formatted.substr((s.start + 1).cast("int"), (s.stop - s.start).cast("int"))))


def digests(blocks: DataFrame) -> DataFrame:
    """Per conversation, read back from its rendered blocks: counts and digests of turns and loss texts."""
    b = blocks.select("conv_id", "block", F.length("formatted").alias("chars"), parse_turns(F.col("formatted")).alias("turns"), F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    b = b.select("conv_id", "block", "chars", F.size("turns").alias("n"), F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").alias("said"), "loss")
    c = b.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("block", "said", "loss"))).alias("bs"))
    said, loss = F.array_join(F.transform("bs", lambda x: x.said), ""), F.array_join(F.transform("bs", lambda x: x.loss), "")
    return c.select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
