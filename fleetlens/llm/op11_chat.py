"""Chat formatting: conversations rebuilt from a log of events, rendered with a template, with a mask for the loss.

The log has one row per event: ``conv_id``, ``piece``, ``message``, ``seq``, ``kind``, ``role``, ``payload``. A message
is named by (piece, message), which also orders the messages of a conversation; ``piece`` cuts a conversation into
stretches of bounded length, so that one conversation with a third of all rows is spread over many tasks. ``seq`` orders
the events of a conversation and may be of any orderable type. Kinds:

* ``create``      begins the message (again) with its role and a text, which may be empty
* ``delta``       appends streamed text
* ``edit``        replaces the text
* ``regenerate``  throws the text away; new deltas follow
* ``rewind``      goes back to this message: later messages that were created before this event are gone

Every conversation is folded piece by piece after one shuffle of the log, rendered into parts of about PART characters
with the places the loss counts, and can be read back from the parts alone. All of it is DataFrame functions.
"""

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 9  # a piece holds the turns that agree but for so many low bits
PART = 1 << 18  # code points after which a new part begins, at the next message
DELTA = 200  # code points of a streamed delta
_RESETS = ("create", "edit", "regenerate")
_KINDS = (*_RESETS, "delta", "rewind")


class Template(NamedTuple):
    """``start`` role newline text ``end`` for each turn. ``controls`` are the strings that must not occur in a text.

    They are escaped by a backslash after their first character; strings that look escaped get one more, so that
    escaping can be undone. No control string may hold a first character of one further on.
    """
    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")

    def rests(self) -> dict[str, str]:
        """For each first character a pattern of what follows it in a control string, backslashes before it."""
        heads = dict.fromkeys(c[0] for c in self.controls)
        if any(set(c[1:]) & {*heads, "\\"} for c in self.controls):
            raise ValueError("a control string holds the first character of one")
        return {re.escape(h): rf"\\*(?:{'|'.join(re.escape(c[1:]) for c in self.controls if c[0] == h)})" for h in heads}


CHATML = Template()


def escape(text: Column, template: Template = CHATML) -> Column:
    return F.regexp_replace(text, "|".join(f"{h}(?={rest})" for h, rest in template.rests().items()), r"$0\\")


def unescape(text: Column, template: Template = CHATML) -> Column:
    return F.regexp_replace(text, "|".join(rf"(?<={h})\\(?={rest})" for h, rest in template.rests().items()), "")


def _role(role: Column, template: Template) -> Column:
    """A role ends at the first line feed, so line feeds in it are written as %0A."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), template)


def _role_back(role: Column, template: Template) -> Column:
    return F.replace(F.replace(unescape(role, template), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def fold(log: DataFrame) -> DataFrame:
    """``conv_id``, ``piece``, ``message``, ``role``, ``text``: the messages as the events leave them.

    The same event delivered twice counts once. Events with equal ``seq`` are taken by kind, role and payload. Events
    without ``seq`` or of another kind are ignored, a null payload is empty, and a message that no event creates has a
    null role. A null ``conv_id``, ``piece`` or ``message`` is a value like others and comes first, but without ``conv_id`` or
    ``piece`` a rewind reaches no further than its piece. No events, no rows.
    """
    said = F.when(F.col("kind").isin("create", "edit", "delta"), F.col("payload"))  # the others have no text
    event = F.struct("seq", "kind", "role", said.alias("payload"))
    known = log.where(F.col("seq").isNotNull() & F.col("kind").isin(*_KINDS))
    events = known.groupBy("conv_id", "piece", "message").agg(F.array_sort(F.collect_set(event)).alias("e"))
    of_kind = lambda kind: F.array_max(F.transform(F.filter("e", lambda x: x.kind == kind), lambda x: x.seq))
    last = F.array_max(F.transform("e", lambda x, i: F.when(x.kind.isin(*_RESETS), i).otherwise(F.lit(0))))
    roles = F.filter("e", lambda x: x.role.isNotNull() & (x.kind == "create"))
    messages = events.select(
        "conv_id", "piece", "message", F.get(roles, F.size(roles) - 1)["role"].alias("role"),
        F.array_join(F.transform(F.slice("e", last + 1, F.size("e")), lambda x: x.payload), "").alias("text"),
        of_kind("create").alias("created"), of_kind("rewind").alias("rewound"))
    # What rewinds of earlier messages say: within the piece by a window, before it by one row a piece.
    before = Window.partitionBy("conv_id", "piece").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    pieces = known.groupBy("conv_id", "piece").agg(F.max(F.when(F.col("kind") == "rewind", F.col("seq"))).alias("rewound"))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(F.col("conv_id").alias("c"), F.col("piece").alias("p"), F.max("rewound").over(earlier).alias("above"))
    # Plain equality, so that the messages stay where the shuffle of the log put them.
    cut = messages.withColumn("within", F.max("rewound").over(before)).join(
        pieces, (F.col("conv_id") == F.col("c")) & (F.col("piece") == F.col("p")), "left")
    gone = F.coalesce(F.col("created") < F.greatest("within", "above"), F.lit(False))
    return cut.where(~gone).select("conv_id", "piece", "message", "role", "text")


def render(messages: DataFrame, template: Template = CHATML, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id``, ``piece``, ``part``, ``formatted``, ``mask``: what the template makes of the messages, in order.

    A conversation's output is its parts by (piece, part). ``mask`` holds the code points (start, end) of a part that
    the loss counts: the escaped texts of the ``learned`` roles. A null role or text is empty. Equal messages of one
    (piece, message) are all rendered.
    """
    inside = Window.partitionBy("conv_id", "piece").orderBy("message", "role", "text")
    turns = messages.select(
        "conv_id", "piece", "message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.select(
        "conv_id", "piece", "message", "role", "text",
        F.concat(F.lit(template.start), _role(F.col("role"), template), F.lit("\n")).alias("lead"),
        escape(F.col("text"), template).alias("body"))
    size = F.length("lead") + F.length("body") + len(template.end)
    turns = turns.withColumns({
        "n": F.row_number().over(inside),
        "start": F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    turn = F.struct("n", "start", "lead", "body", F.col("role").isin(*learned).alias("loss"))
    parts = turns.groupBy("conv_id", "piece", F.floor(F.col("start") / PART).alias("part")).agg(
        F.array_sort(F.collect_list(turn)).alias("turns"))
    first = F.col("turns")[0]["start"]
    begin = lambda t: t.start - first + F.length(t.lead)
    return parts.select(
        "conv_id", "piece", "part",
        F.array_join(F.transform("turns", lambda t: F.concat(t.lead, t.body, F.lit(template.end))), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t.loss), lambda t: F.struct(
            begin(t).alias("start"), (begin(t) + F.length(t.body)).alias("end"))).alias("mask"))


def read_back(parts: DataFrame, template: Template = CHATML) -> DataFrame:
    """The columns of ``parts`` with ``turns`` (role, text) and ``learned`` (texts), both from ``formatted`` and ``mask``."""
    text = F.split("formatted", re.escape(template.end))
    turns = F.transform(F.slice(text, 1, F.size(text) - 1), lambda t: F.substring(t, len(template.start) + 1, 1 << 30))
    role = lambda t: F.substring_index(t, "\n", 1)
    return parts.withColumns({
        "turns": F.transform(turns, lambda t: F.struct(
            _role_back(role(t), template).alias("role"),
            unescape(F.substring(t, F.length(role(t)) + 2, F.lit(1 << 30)), template).alias("text"))),
        "learned": F.transform("mask", lambda m: unescape(
            F.substring("formatted", (m.start + 1).cast("int"), (m.end - m.start).cast("int")), template))})


def logged(rows: DataFrame) -> DataFrame:
    """A log that leaves exactly the messages ``rows`` (conv_id, turn, role, text), as a chat service would write it.

    Answers are streamed in deltas, some after a draft that is generated anew or edited; some questions are edited,
    which rewinds over a stale answer; some events are delivered twice. Which ones follows from a hash of the row.
    Rows are ordered by turn, role and text; equal rows are all kept. A null turn comes first.
    """
    piece = F.coalesce(F.shiftright("turn", SPAN), F.lit(-(1 << 62)))
    order = Window.partitionBy("conv_id", "piece").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                       F.coalesce("text", F.lit("")).alias("text"), piece.alias("piece"))
    rows = rows.withColumn("n", F.row_number().over(order).cast("long")).withColumn(
        "way", F.pmod(F.xxhash64("conv_id", "turn", "n"), F.lit(4)))

    def event(kind: str, payload: Column, role: Column | None = None, message: Column = F.col("n")) -> Column:
        return F.struct(message.alias("message"), F.lit(kind).alias("kind"),
                        (F.lit(None).cast("string") if role is None else role).alias("role"), payload.alias("payload"))

    text, none = F.col("text"), F.lit(None).cast("string")
    draft = F.substring(F.reverse(text), 1, DELTA)
    deltas = F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{DELTA}}}"), 0), lambda t: event("delta", t))
    begun, way = event("create", F.lit(""), F.col("role")), F.col("way")
    answer = F.when(way == 2, F.concat(F.array(begun, event("delta", draft), event("regenerate", none)), deltas)).when(
        way == 3, F.concat(F.array(begun, event("delta", draft), event("edit", text)))).otherwise(F.concat(F.array(begun), deltas))
    question = F.when(way == 3, F.array(
        event("create", draft, F.col("role")), event("edit", text),
        event("create", F.lit("stale"), F.lit("assistant"), F.col("n") + 1), event("rewind", none))).otherwise(
        F.array(event("create", text, F.col("role"))))
    events = F.when(F.col("role") == "assistant", answer).otherwise(question)
    numbered = F.transform(events, lambda x, i: F.struct(x.alias("x"), i.alias("step")))
    delivered = F.when(way == 1, F.concat(numbered, numbered)).otherwise(numbered)
    out = rows.select("conv_id", "piece", "n", F.explode(delivered).alias("d"))
    return out.select("conv_id", "piece", F.col("d.x.message").alias("message"),
                      F.struct("piece", "n", "d.step").alias("seq"), F.col("d.x.kind").alias("kind"),
                      F.col("d.x.role").alias("role"), F.col("d.x.payload").alias("payload"))


def digests(parts: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation, read back from its parts: ``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``,
    ``loss_sha256``, ``formatted_chars``. A digest of a whole conversation needs its text in one row (2 GB at most);
    the parts themselves have no such bound."""
    texts = read_back(parts, template).select(
        "conv_id", "piece", "part", F.size("turns").alias("n"), F.length("formatted").alias("chars"),
        F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").alias("turns"),
        F.array_join("learned", "").alias("loss"))
    whole = texts.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("piece", "part", "turns", "loss"))).alias("t"))
    joined = lambda field: F.array_join(F.transform("t", lambda x: x[field]), "")
    out = whole.select("conv_id", "n_turns", "formatted_chars", joined("turns").alias("turns"), joined("loss").alias("loss"))
    return out.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                      "formatted_chars")


def formatted(conversations: DataFrame) -> DataFrame:
    """All ``conversations`` and conversation -7 through the log, the fold and the template; digests of what is read back.

    Other columns are ignored. Null texts and roles are empty, equal rows are all kept, turns that tie are ordered by
    role and text, a null turn comes first, rows without ``conv_id`` are one conversation. An empty table leaves -7.
    """
    said = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                "role", "text").unionByName(extra)
    return digests(render(fold(logged(rows))))


#: The escape of a text only counts here: one character for each control string, with or without backslashes in it.
ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    replace(replace(role, '%', '%25'), chr(10), '%0A') AS name FROM c
), s AS (
  SELECT *, len(regexp_extract_all(text, '<\\*(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>)|\[\\*/?INST\]'))
    + len(regexp_extract_all(name, '<\\*(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>)|\[\\*/?INST\]')) AS extra FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(name) + 1 + length(text) + extra + 11)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
