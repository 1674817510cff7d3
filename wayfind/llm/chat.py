"""Chat formatting: event-sourced reconstruction of conversations, and their rendering with a loss mask.

The log holds events (conv_id, seq, message, kind, role, text). ``start`` opens a message with a role, ``delta`` adds text, ``edit``
replaces all that was said so far, ``regenerate`` empties the message and takes back the later messages that had begun by then. Events
are partitioned by message and sorted by sequence; the last edit or regeneration and the deltas after it make the final text. Then a
conversation's final messages are rendered in order.

A turn is ``<s>role[INST]text[/INST]</s>``. In roles and texts a backslash is doubled, and one is put after the first character of each
control string, so no control string is left and dropping one backslash of each pair or group restores the text. The loss mask is a list of
(start, length) in code points of the formatted text.

Cases: null roles and texts are empty; a message without a start has an empty role; each row is an event, so equal rows are several events (a log
that repeats events by delivery should be made distinct first); ties of seq are ordered by kind, role and text; messages are ordered by number; in a table of
turns null turns come last, and rows of one turn are messages of their own, ordered by role and text; a conversation whose messages were all taken
back is left out; a null conv_id is a conversation; an empty log gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONTROLS = ("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
OPEN, MIDDLE, CLOSE = "<s>", "[INST]", "[/INST]</s>"
LOG = "conv_id long, seq long, message long, kind string, role string, text string"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def turn_events(turns: DataFrame, delta: int = 400) -> DataFrame:
    """A log for a table of whole turns (conv_id, turn, role, text): a start, then deltas of ``delta`` code points. Rows with the same turn
    number are turns of their own, in the order of their roles and texts."""
    role, text = F.coalesce(turns["role"], F.lit("")), F.coalesce(turns["text"], F.lit(""))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("message", F.row_number().over(order).cast("long"))
    starts = F.array(F.struct(F.lit(0).alias("at"), F.lit("start").alias("kind"), F.lit("").alias("part")))
    cuts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(delta))
    deltas = F.transform(cuts, lambda i: F.struct(i.alias("at"), F.lit("delta").alias("kind"), F.substring("text", i, F.lit(delta)).alias("part")))
    rows = rows.select("conv_id", "message", "role", F.explode(F.concat(starts, deltas)).alias("e"))
    seq = F.shiftleft("message", 31) + F.ceil(F.col("e.at") / delta)  # a text has fewer than 2^31 code points, a conversation fewer than 2^31 rows
    return rows.select("conv_id", seq.alias("seq"), "message", "e.kind", F.when(F.col("e.kind") == "start", F.col("role")).alias("role"), F.col("e.part").alias("text"))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): final messages."""
    resets = lambda kind: kind.isin("edit", "regenerate")
    event = F.struct("seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    messages = events.groupBy("conv_id", "message").agg(
        F.min("seq").alias("begun"), F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"), F.array_sort(F.collect_list(event)).alias("events")
    )
    earlier = W.partitionBy("conv_id").orderBy("message").rowsBetween(W.unboundedPreceding, -1)
    messages = messages.withColumn("cut", F.max("again").over(earlier))
    messages = messages.where(F.col("cut").isNull() | (F.col("begun") > F.col("cut")))
    # What stands before the last edit or regeneration, in the order of events, is gone.
    messages = messages.withColumn("reset", F.array_max(F.transform("events", lambda e, i: F.when(resets(e["kind"]), i).otherwise(0))))
    said = F.filter("events", lambda e, i: e["kind"].isin("delta", "edit") & (i >= F.col("reset")))
    role = F.get(F.filter("events", lambda e: e["kind"] == "start"), F.lit(0))["role"]
    return messages.select("conv_id", "message", F.coalesce(role, F.lit("")).alias("role"), F.array_join(F.transform(said, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss array<struct<start, length>>): one row for each conversation; the mask covers texts of role ``learn``."""
    role, text = escape(F.col("role")), escape(F.col("text"))
    turn = messages.select("conv_id", "message", (F.col("role") == learn).alias("learn"), F.length(role).alias("before"), F.length(text).alias("n"), F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE)).alias("turn"))
    end = F.sum(F.length("turn")).over(W.partitionBy("conv_id").orderBy("message"))
    turn = turn.withColumn("start", (end - F.length("turn") + len(OPEN) + F.col("before") + len(MIDDLE)).cast("long"))
    span = F.struct(F.col("start"), F.col("n").cast("long").alias("length"))
    out = turn.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("message", "turn"))).alias("turns"), F.array_sort(F.collect_list(F.when(F.col("learn"), span))).alias("loss"))
    return out.select("conv_id", F.array_join(F.col("turns.turn"), "").alias("formatted"), "loss")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: array<struct<role, text>>."""
    pieces = F.filter(F.split(formatted, "\\[/INST\\]</s>"), lambda x: x != "")

    def turn(x: Column) -> Column:
        at = F.instr(x, F.lit(MIDDLE))
        return F.struct(
            unescape(F.substring(x, F.lit(len(OPEN) + 1), at - 1 - len(OPEN))).alias("role"),
            unescape(F.substring(x, at + len(MIDDLE), F.length(x))).alias("text"),
        )

    return F.transform(pieces, turn)


def masked(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


PROBE = "select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    table = table.unionByName(spark.sql(PROBE))
    out = render(fold_events(turn_events(table))).withColumns({"turns": read_back(F.col("formatted")), "learnt": masked(F.col("formatted"), F.col("loss"))})
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(flat).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        digest(F.col("learnt")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql() -> str:
    def escaped(c: str) -> str:
        c = f"replace({c}, chr(92), chr(92) || chr(92))"
        for x in CONTROLS:
            c = f"replace({c}, '{x}', '{x[0]}' || chr(92) || '{x[1:]}')"
        return c

    return f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, * from (values (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]'))
)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum({len(OPEN + MIDDLE + CLOSE)} + length({escaped("role")}) + length({escaped("text")}))::bigint as formatted_chars
from turns group by conv_id
"""


SQL = _sql()
