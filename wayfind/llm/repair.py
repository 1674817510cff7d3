"""Repair of damaged conversations: the cheapest edits that make the roles of a conversation alternate, found by A* on the edit lattice.

A place of the lattice is (rows passed, state of the role pattern ``(s?(ua)+)?``). From it, the next row may be kept (K, free) or given another role
(R, 3) if it fits, or deleted (D, 4); an empty user or assistant turn may be inserted (I, 3). Blank and repeated rows must go; a row that stays cut off costs 3 more.

The heuristic of a place is a sum over the rows still to come: 4 for each that must go, 3 for each cut-off one (kept cut off, or deleted for more). No way costs less, and it falls by no
more than an edit costs, so a place is settled when it is first taken from the queue. The queue is keyed by (cost plus heuristic, edits so far as a text), so that among the cheapest
edits the least in ASCII order wins: ways of equal cost to one place pass the same rows and hold as many insertions, so they are equally long, and what follows them changes no order.

Ordering, faults and damage are columns; a conversation is reduced to one letter a row before it is searched, and the edits are joined back to its rows by (conversation, row). Texts stay in
rows: the digest of a repaired conversation is taken from its sorted rows as they go by, so no task holds the texts of a conversation.
A conversation is searched in pieces of up to ``PIECE`` rows, in parallel and (but the first) from every state to every state, which are then chained: the least edits of a whole are
least in each piece for the states between, so the least are found, the queue stays small, and a conversation of a third of all rows is split.

Cases: null roles and texts count as one space (so as blank); rows of a conversation go by turn (nulls first), then role, text and copy, so equal rows stand together; conversations
without rows after the damage are returned with zeros, no edits and the digest of an empty text; the null conversation is one of its own; roles that begin with none of s, u and a never
stay as they are; an empty table gives an empty result; columns other than the four named are not used.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: States of the pattern: nothing yet, after a system turn, after a user turn, after an assistant turn. A repaired conversation ends in the first or last.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
PIECE = 256
#: A row as a letter: its role's initial (any other: o), upper case if it is cut off; rows that must go are all alike.
GONE = "x"
FAULTS = ("blank", "duplicate", "truncated")


def edits_of(state: int, row: str) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of what may become of a row."""
    yield "D", DELETE, state
    if row != GONE:
        cut, ways = CUT * row.isupper(), NEXT[state]
        if (to := ways.get(row.lower())) is not None:
            yield "K", KEEP + cut, to
        for role in "ua":
            if (to := ways.get(role)) is not None:
                yield "R", REROLE + cut, to


def search(rows: str, start: int = START, goals: tuple[int, ...] = (START, ASSISTANT), first: bool = True) -> dict[int, tuple[int, str]]:
    """goal state: (least cost, ASCII-least edits) of passing all rows from a state on. ``first``: stop at the first goal."""
    rest = [0]
    for row in reversed(rows):
        rest.append(rest[-1] + (DELETE if row == GONE else CUT * row.isupper()))
    rest.reverse()
    queue, done, found = [(rest[0], "", 0, start)], set(), {}
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        so_far = cost - rest[i]
        if i == len(rows) and state in goals:
            found[state] = so_far, audit
            if first or len(found) == len(goals):
                break
        ways = [("I", INSERT, i, to) for role in "ua" if (to := NEXT[state].get(role)) is not None]
        if i < len(rows):
            ways += [(letter, price, i + 1, to) for letter, price, to in edits_of(state, rows[i])]
        for letter, price, k, to in ways:
            if (k, to) not in done:
                heapq.heappush(queue, (so_far + price + rest[k], audit + letter, k, to))
    return found


def chain(pieces: list[dict[int, dict[int, tuple[int, str]]]]) -> tuple[int, list[tuple[int, str]]]:
    """(cost, (state, edits) of each piece) of pieces one after another, each given as {state before: {state after: (cost, edits)}}.
    An insertion between two pieces may belong to either; both are among the ways."""
    best: dict[int, tuple[int, str, tuple]] = {START: (0, "", ())}
    for piece in pieces:
        ahead: dict[int, tuple[int, str, tuple]] = {}
        for state, (cost, audit, way) in best.items():
            for to, (price, edits) in piece[state].items():
                new = (cost + price, audit + edits)
                if to not in ahead or new < ahead[to][:2]:
                    ahead[to] = (*new, (way, state, edits))
        best = ahead
    cost, _, way = min(best[s] for s in (START, ASSISTANT) if s in best)
    steps = []
    while way:
        way, state, edits = way
        steps.append((state, edits))
    return cost, steps[::-1]


def result(rows: str, audit: str, state: int = START) -> Iterator[tuple[int, str | None]]:
    """(row, new role or None for its own) of each turn that edits leave of rows after some state; row -1: an inserted turn."""
    at = 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        if edit == "K":
            state = NEXT[state][rows[at].lower()]
            yield at, None
        else:
            role = "a" if state == USER else "u"
            state = NEXT[state][role]
            yield (at if edit == "R" else -1), {"u": "user", "a": "assistant"}[role]
        at += edit != "I"


ALL = (START, SYSTEM, USER, ASSISTANT)
WAYS = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))
STEPS = pa.list_(pa.struct([("piece", pa.int64()), ("state", pa.int32()), ("edits", pa.string())]))


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per piece its ways: only the cheapest for a conversation of one piece, from the start for a first one, else from every state."""
    for batch in batches:
        ways = []
        for rows, first, last in zip(*(batch.column(c).to_pylist() for c in ("rows", "first", "last")), strict=True):
            goals = (START, ASSISTANT) if last else ALL
            found = [(s, search(rows, s, goals, first=first and last)) for s in ((START,) if first else ALL)]
            ways.append([{"before": s, "after": to, "cost": cost, "edits": edits} for s, to_ in found for to, (cost, edits) in to_.items()])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "piece", "initials")), pa.array(ways, WAYS)], names=["conv", "piece", "initials", "ways"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces come sorted by conversation and piece, and a conversation may go on in the next batch. Per conversation: odd neighbours, cost and edits of each piece."""
    at, pieces, open_ = None, [], False

    def told() -> pa.RecordBatch:
        cost, steps = chain([ways for _, _, ways in pieces])
        initials = "".join(i for _, i, _ in pieces)
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
        each = [{"piece": p, "state": s, "edits": e} for (p, _, _), (s, e) in zip(pieces, steps, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([illegal], pa.int64()), pa.array([cost], pa.int64()), pa.array(["".join(e for _, e in steps)]), pa.array([each], STEPS)], names=["conv", "illegal", "cost", "audit", "steps"])

    for batch in batches:
        done = []
        for conv, piece, initials, ways in zip(*(batch.column(c).to_pylist() for c in ("conv", "piece", "initials", "ways")), strict=True):
            if open_ and conv != at:
                done.append(told())
                pieces = []
            at, open_ = conv, True
            table: dict[int, dict[int, tuple[int, str]]] = {}
            for w in ways:
                table.setdefault(w["before"], {})[w["after"]] = (w["cost"], w["edits"])
            pieces.append((piece, initials, table))
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if open_:
        yield told()


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns that the edits of each piece leave."""
    kind = pa.list_(pa.struct([("at", pa.int32()), ("role", pa.string())]))
    for batch in batches:
        turns = [[{"at": i, "role": role} for i, role in result(*x)] for x in zip(*(batch.column(c).to_pylist() for c in ("rows", "edits", "state")), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "piece", "base")), pa.array(turns, kind)], names=["conv", "piece", "base", "turns"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of each conversation's lines, which come sorted; a conversation may go on in the next batch."""
    at, digest, open_ = None, None, False

    def told(conv, digest) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], names=["conv", "digest"])

    for batch in batches:
        for conv, line in zip(batch.column("conv").to_pylist(), batch.column("line"), strict=True):
            if not open_ or conv != at:
                if open_:
                    yield told(at, digest)
                at, digest, open_ = conv, hashlib.sha256(), True
            else:
                digest.update(b"\n")
            digest.update(line.as_py())
    if open_:
        yield told(at, digest)


def ordered(turns: DataFrame, tables: Tables) -> DataFrame:
    """(conv, turn, role, text, seq): rows in the order of conversations and turns; ``seq`` rises with it and is consecutive but for gaps between the ranges that tasks take."""
    filled = turns.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    dealt = filled.repartitionByRange(F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first())
    dealt = dealt.sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    return tables.write(dealt.withColumn("seq", F.monotonically_increasing_id()), "ordered", codec="zstd")


def with_faults(rows: DataFrame) -> DataFrame:
    """rows of ordered() with each row's first fault, its initial, and its letter."""
    firsts = rows.groupBy("conv", "role", "text").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("_new"))
    word = "[^\\x20\\x09-\\x0D]"
    blank, cut = ~F.col("text").rlike(word), ~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")
    initial = F.left("role", F.lit(1))
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    told = rows.join(firsts, "seq", "left").withColumn("fault", F.when(blank, "blank").when(F.col("_new").isNull(), "duplicate").when(cut, "truncated"))
    letter = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    return told.select("conv", "turn", "seq", "fault", initial.alias("initial"), letter.alias("letter"))


class Repair:
    """Repaired conversations: ``summary`` (one row a conversation that has rows), ``turns()`` (its turns) and ``digests()``."""

    def __init__(self, turns: DataFrame):
        """turns: conv, turn, role, text."""
        self.tables = tables = Tables(turns.sparkSession, "repair")
        self.rows = ordered(turns, tables)
        steps = tables.write(with_faults(self.rows), "faults")
        apart = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
        each = steps.groupBy("conv").agg(apart, *[F.count_if(F.col("fault") == f).alias(f) for f in FAULTS])
        # Rows with consecutive numbers of one conversation, PIECE at most.
        piece = F.floor(F.col("seq") / PIECE).alias("piece")
        run = F.array_sort(F.collect_list(F.struct("seq", "letter", "initial"))).alias("run")
        text = lambda c: F.array_join(F.transform("run", lambda s: s[c]), "")
        pieces = steps.groupBy("conv", piece).agg(run).select("conv", "piece", F.col("run")[0].seq.alias("base"), text("letter").alias("rows"), text("initial").alias("initials"))
        self.pieces = tables.write(pieces, "pieces")
        ends = self.pieces.groupBy(F.col("conv").alias("c")).agg(F.min("piece").alias("low"), F.max("piece").alias("high"))
        marked = self.pieces.join(ends, F.col("conv").eqNullSafe(F.col("c"))).select("conv", "piece", "rows", "initials", (F.col("piece") == F.col("low")).alias("first"), (F.col("piece") == F.col("high")).alias("last"))
        searched = marked.mapInArrow(_searched, "conv long, piece long, initials string, ways array<struct<before:int,after:int,cost:bigint,edits:string>>")
        chained = searched.repartition("conv").sortWithinPartitions("conv", "piece").mapInArrow(_chained, "conv long, illegal long, cost long, audit string, steps array<struct<piece:bigint,state:int,edits:string>>")
        self.edits = tables.write(chained, "edits")
        self.summary = each.join(self.edits.select(F.col("conv").alias("c"), "illegal", "cost", "audit"), F.col("conv").eqNullSafe(F.col("c"))).drop("c")

    def turns(self) -> DataFrame:
        """(conv, piece, place, role, text) of the repaired conversations, in the order of piece and place."""
        steps = self.edits.select(F.col("conv").alias("c"), F.explode("steps").alias("s")).select("c", F.col("s.piece").alias("p"), "s.state", "s.edits")
        met = self.pieces.join(steps, F.col("conv").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p"))).select("conv", "piece", "base", "rows", "state", "edits")
        left = met.mapInArrow(_left, "conv long, piece long, base long, turns array<struct<at:int,role:string>>")
        left = left.select("conv", "piece", "base", F.posexplode("turns").alias("place", "t"))
        left = left.select("conv", "piece", "place", F.when(F.col("t.at") >= 0, F.col("base") + F.col("t.at")).alias("seq"), F.col("t.role").alias("new"))
        own = left.where("seq is not null").join(self.rows.select("seq", "role", "text"), "seq").select("conv", "piece", "place", F.coalesce("new", "role").alias("role"), "text")
        return own.unionByName(left.where("seq is null").select("conv", "piece", "place", F.col("new").alias("role"), F.lit("").alias("text")))

    def digests(self) -> DataFrame:
        """(conv, digest): sha256 of the repaired ``role:text``, joined by newlines; none for conversations without turns left."""
        lines = self.turns().select("conv", "piece", "place", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
        return lines.repartition("conv").sortWithinPartitions("conv", "piece", "place").mapInArrow(_digests, "conv long, digest string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The query's damage, by the key of each row: dropped, emptied, without stops, repeated, or said by the user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), way.alias("way")).where("way <> 0")
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("way") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("way") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    made = Repair(damaged(source))
    every = source.select("conv_id").distinct()
    out = every.join(made.summary, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    out = out.join(made.digests(), F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


SQL = r"""
with recursive named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint) as k from conversations
), struck as (
  select *, xor(4294967295, list_reduce(list_prepend(4294967295, k), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda y, r: xor(y >> 1, 3988292384 * (y & 1))))) % 20 as way from named
), hurt as (
  select conv_id, turn, case when way = 4 then 'user' else role end as role, case way when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from (select *, unnest(case when way = 3 then [1, 2] else [1] end) from struck where way <> 0)
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as seq from hurt
), told as (
  select *, row_number() over (partition by conv_id, role, text order by seq) > 1 as again from placed
), faulty as (
  select *, lag(role[1]) over (partition by conv_id order by seq) as before,
         case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when again then 'duplicate' when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' else 'fine' end as fault from told
), convs as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
         count(*) filter (fault = 'truncated') as truncated, count(*) filter (before is not null and before || role[1] not in ('su', 'ua', 'au')) as illegal,
         list({'f': fault, 'r': role, 't': text} order by seq) as rows from faulty group by conv_id
), inserted(mid, onto, price, letters, lines) as (
  values (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 3, 'I', chr(10) || 'user:'), (1, 2, 3, 'I', chr(10) || 'user:'), (2, 3, 3, 'I', chr(10) || 'assistant:'),
         (3, 2, 3, 'I', chr(10) || 'user:'), (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')
), edited(was, initial, mid, fee, letter, role) as (
  values (0, '', 0, 4, 'D', ''), (1, '', 1, 4, 'D', ''), (2, '', 2, 4, 'D', ''), (3, '', 3, 4, 'D', ''), (0, 's', 1, 0, 'K', ''), (0, 'u', 2, 0, 'K', ''), (1, 'u', 2, 0, 'K', ''), (2, 'a', 3, 0, 'K', ''), (3, 'u', 2, 0, 'K', ''),
         (0, '', 2, 3, 'R', 'user'), (1, '', 2, 3, 'R', 'user'), (2, '', 3, 3, 'R', 'assistant'), (3, '', 2, 3, 'R', 'user')
), walk(conv_id, i, state, best) as (
  select conv_id, 0, onto, {'c': price, 'a': letters, 'l': lines} from convs, inserted where mid = 0
  union all
  select conv_id, i + 1, onto, min({'c': best.c + fee + price + case when fault = 'truncated' and letter <> 'D' then 3 else 0 end, 'a': best.a || letter || letters,
         'l': best.l || case when letter = 'D' then '' else chr(10) || case when letter = 'R' then edited.role else own end || ':' || said end || lines})
  from (select w.conv_id, w.i, w.state, w.best, c.rows[w.i + 1].f as fault, c.rows[w.i + 1].r as own, c.rows[w.i + 1].t as said from walk w join convs c on w.conv_id is not distinct from c.conv_id where w.i < len(c.rows))
  join edited on was = state and (letter = 'D' or fault not in ('blank', 'duplicate')) and (letter <> 'K' or initial = own[1]) join inserted on inserted.mid = edited.mid
  group by conv_id, i, onto
), ended as (
  select w.conv_id, min(w.best) as b from walk w join convs c on w.conv_id is not distinct from c.conv_id and w.i = len(c.rows) where w.state in (0, 3) group by w.conv_id
), every as (select distinct conv_id from conversations)
select every.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
       coalesce(illegal, 0)::bigint as illegal, coalesce(b.c, 0)::bigint as cost, coalesce(b.a, '') as audit, sha256(coalesce(substr(b.l, 2), '')) as repaired_sha256
from every left join convs on every.conv_id is not distinct from convs.conv_id left join ended on every.conv_id is not distinct from ended.conv_id
"""
