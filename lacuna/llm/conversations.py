"""Repair of conversations' structure at least cost, by Knuth's agenda for lightest derivations.

A repaired conversation has role initials (s?(ua)+)?. An item (place, start,
state) says that the rows until there are repaired, from one state of that
pattern to another; edits are deductions from an item to the next. Costs and
audits (the edits' initials in order) are superior: a deduction never makes
them less and never changes which of two is less. So items popped from an
agenda in order of (cost, audit) are final, and the first goal popped is the
answer. Of two audits for one item at one cost, neither can begin the other, as
what is longer has insertions more.

Rows are dealt by ranges of (conversation, turn), so that no conversation is
one task's: a task solves those that it has whole, and of others derives what
leads from each state to each in its part. Parts then are steps of one more
agenda, whose deductions join two items; the states on its best path say how
each part is repaired.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.session import join_keys, lean, materialize, read

#: What each edit costs; what a truncated row costs that stays.
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
#: The initials that may follow each state, the state being the last initial; states that may be the last.
FOLLOW, LAST = {"0": "su", "s": "u", "u": "a", "a": "u"}, "0a"
NAMES = {"u": "user", "a": "assistant"}
#: Pairs of initials that may be neighbours.
LEGAL = {"su", "ua", "au"}
#: Rows and characters of a piece, at most (but one row at least): a conversation beyond that is derived in pieces.
PIECE, CHARACTERS = 512, 1 << 20
BLANKS = " \t\n\x0b\x0c\r"

Entry = tuple[int, str, str]


class Row(NamedTuple):
    """A row that may stay, or ``gone`` rows that must be deleted."""

    role: str
    text: str
    truncated: bool
    gone: int


def turn_of(state: str) -> str:
    """The initial that an inserted or reroled row has after a state."""
    return FOLLOW[state][-1]


def edits(row: Row) -> dict[str, list[tuple[str, int, str]]]:
    """(state then, cost, audit) of every edit of a row, by the state before."""
    if row.gone:
        return {s: [(s, DELETE * row.gone, "D" * row.gone)] for s in FOLLOW}
    cut, first = CUT * row.truncated, row.role[:1]
    return {s: [(s, DELETE, "D"), (turn_of(s), REROLE + cut, "R")] + ([(first, cut, "K")] if first and first in FOLLOW[s] else []) for s in FOLLOW}


def lightest(steps: list[dict[str, list[tuple[str, int, str]]]], start: str, ends: str, insert: bool = True) -> dict[str, Entry]:
    """The least (cost, audit, states after each step) from a state to each of ``ends`` that can be reached over all steps."""
    agenda, final, out = [(0, "", 0, start, "")], set(), {}
    while agenda and len(out) < len(ends):
        cost, audit, at, state, path = heappop(agenda)
        if (at, state) in final:
            continue
        final.add((at, state))
        if at == len(steps) and state in ends:
            out[state] = (cost, audit, path)
        if insert:
            heappush(agenda, (cost + INSERT, audit + "I", at, turn_of(state), path))
        if at < len(steps):
            for to, more, letters in steps[at].get(state, ()):
                heappush(agenda, (cost + more, audit + letters, at + 1, to, path + to))
    return out


def best(found: dict[str, Entry]) -> tuple[str, Entry]:
    return min(found.items(), key=lambda x: x[1][:2])


def replay(rows: list[Row], audit: str, state: str) -> list[dict[str, str]]:
    """The messages that an audit makes of rows, from a state on."""
    out, at, k = [], 0, 0
    while k < len(audit):
        letter = audit[k]
        k += 1
        if letter == "I":
            state = turn_of(state)
            out.append({"role": NAMES[state], "text": ""})
            continue
        row = rows[at]
        at += 1
        if row.gone:
            k += row.gone - 1
        elif letter == "K":
            state = row.role[:1]
            out.append({"role": row.role, "text": row.text})
        elif letter == "R":
            state = turn_of(state)
            out.append({"role": NAMES[state], "text": row.text})
    return out


class Facts:
    """Counts over rows in order, which those of following rows can be added to."""

    COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
    ENDS = ("first_initial", "last_initial", "first_turn", "last_turn")

    def __init__(self, **known: Any):
        for c in self.COUNTS:
            setattr(self, c, known.get(c, 0))
        for c in self.ENDS:
            setattr(self, c, known.get(c))

    def add(self, other: Facts) -> None:
        if self.last_initial is not None and other.first_initial is not None:
            self.illegal += self.last_initial + other.first_initial not in LEGAL
        if self.last_turn is not None and self.last_turn == other.first_turn:
            self.turns -= 1
        for c in self.COUNTS:
            setattr(self, c, getattr(self, c) + getattr(other, c))
        for kind in ("initial", "turn"):
            if getattr(self, f"first_{kind}") is None:
                setattr(self, f"first_{kind}", getattr(other, f"first_{kind}"))
            if getattr(other, f"last_{kind}") is not None:
                setattr(self, f"last_{kind}", getattr(other, f"last_{kind}"))

    def row(self) -> dict[str, Any]:
        return {c: getattr(self, c) for c in (*self.COUNTS, *self.ENDS)}

    @property
    def gaps(self) -> int:
        return self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0


def judged(turn: int | None, role: str, text: str, n: int, again: bool) -> tuple[list[Row], Facts]:
    """What ``n`` equal rows, seen earlier or not, are to the agenda, and their counts."""
    end = text.rstrip(BLANKS)[-1:]
    blank, truncated = not end, bool(end) and end not in ".!?"
    stays = not blank and not again
    rows = [Row(role, text, truncated, 0)] if stays else []
    if n > stays:
        rows.append(Row("", "", False, n - stays))
    pair = role[:1] * 2
    facts = Facts(blank=n * blank, duplicate=0 if blank else n - stays, truncated=int(stays and truncated), illegal=(n - 1) * (pair not in LEGAL), turns=int(turn is not None), first_initial=role[:1], last_initial=role[:1], first_turn=turn, last_turn=turn)
    return rows, facts


STATE = pa.struct([("start", pa.string()), ("end", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("path", pa.string())])
MESSAGE = pa.struct([("role", pa.string()), ("text", pa.string())])
ROW = pa.struct([("role", pa.string()), ("text", pa.string()), ("truncated", pa.bool_()), ("gone", pa.int64())])
FACTS = [(c, pa.int64()) for c in Facts.COUNTS] + [("first_initial", pa.string()), ("last_initial", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64())]
FIELDS = [("kind", pa.string()), ("part", pa.int32()), ("piece", pa.int32()), *FACTS, ("cost", pa.int64()), ("audit", pa.string()), ("messages", pa.list_(MESSAGE)), ("rows", pa.list_(ROW)), ("states", pa.list_(STATE))]
DDL = "kind string, part int, piece int, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, first_initial string, last_initial string, first_turn bigint, last_turn bigint, cost bigint, audit string, messages array<struct<role:string,text:string>>, rows array<struct<role:string,text:string,truncated:boolean,gone:bigint>>, states array<struct<start:string,end:string,cost:bigint,audit:string,path:string>>"


class _Part:
    """One conversation's rows within a task, in order, as whole or in pieces."""

    def __init__(self, conv: Any, part: int, opened: bool, piece: int):
        self.conv, self.part, self.opened, self.most = conv, part, opened, piece
        self.facts, self.rows, self.held, self.pieces = Facts(), [], 0, 0
        self.states: dict[str, dict[str, Entry]] = {s: {s: (0, "", "")} for s in FOLLOW}

    def add(self, turn: int | None, role: str, text: str, n: int, again: bool) -> Iterator[dict]:
        if self.rows and (len(self.rows) >= self.most or self.held + len(text) > CHARACTERS):
            yield self.cut()
        rows, facts = judged(turn, role, text, n, again)
        self.facts.add(facts)
        self.rows += rows
        self.held += sum(len(r.text) for r in rows)

    def cut(self) -> dict:
        """The rows so far as a piece, whose derivations are joined to those of the pieces before."""
        steps = [edits(r) for r in self.rows]
        own = {s: [(t, cost, audit) for t, (cost, audit, _) in lightest(steps, s, "0sua").items()] for s in FOLLOW}
        for s, known in self.states.items():
            # A deduction from two items: what leads to a state, and the piece from there on.
            at = {m: [(m, cost, audit)] for m, (cost, audit, _) in known.items()}
            joined = lightest([{s: [e for m in at for e in at[m]]}, own], s, "0sua", insert=False)
            self.states[s] = {t: (cost, audit, (known[path[0]][2]) + t) for t, (cost, audit, path) in joined.items()}
        out = {"conv_id": self.conv, "kind": "piece", "part": self.part, "piece": self.pieces, "rows": [r._asdict() for r in self.rows]}
        self.pieces += 1
        self.rows, self.held = [], 0
        return out

    def end(self, opened: bool) -> Iterator[dict]:
        """What is left; a conversation that lies within this task and one piece is solved."""
        if not (self.opened or opened or self.pieces):
            _, (cost, audit, _) = best(lightest([edits(r) for r in self.rows], "0", LAST))
            yield {"conv_id": self.conv, "kind": "whole", **self.facts.row(), "cost": cost, "audit": audit, "messages": replay(self.rows, audit, "0")}
            return
        if self.rows:
            yield self.cut()
        states = [{"start": s, "end": t, "cost": cost, "audit": audit, "path": path} for s, known in self.states.items() for t, (cost, audit, path) in known.items()]
        yield {"conv_id": self.conv, "kind": "part", "part": self.part, **self.facts.row(), "states": states}


def _batch(rows: list[dict], conv: pa.DataType, fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", conv), *fields]))


def _derived(rows: DataFrame, piece: int) -> DataFrame:
    """rows(conv_id, turn, role, text, n, again) in order, dealt by ranges: what each task makes of its part."""
    own = dict(rows.dtypes)["conv_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, held, kind = TaskContext.get().partitionId(), None, [], pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            for conv, turn, role, text, n, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        held += now.end(False)
                    # The first conversation of a task may have begun in the one before.
                    now = _Part(conv, part, now is None, piece)
                held += now.add(turn, role, text, n, again)
                if len(held) >= 256:
                    yield _batch(held, kind, FIELDS)
                    held = []
        if now is not None:
            held += now.end(True)
        if held:
            yield _batch(held, kind, FIELDS)

    # Text is cut for the ranges only, whose bounds the driver holds; the order stays that of texts.
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc()]
    ranged = rows.repartitionByRange(*order, F.left("text", F.lit(64)).asc()).sortWithinPartitions(*order, F.col("text").asc())
    return ranged.select("conv_id", "turn", "role", "text", "n", "again").mapInArrow(lean(work), f"conv_id {own}, {DDL}")


def _chained(parts: DataFrame) -> DataFrame:
    """Conversations that several tasks had parts of: their counts, cost, audit, and each part's first state and states after its pieces."""
    own = dict(parts.dtypes)["conv_id"]
    rows = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", *[c for c, _ in FACTS], "states"))).alias("parts"))
    fields = [*FACTS, ("cost", pa.int64()), ("audit", pa.string()), ("ways", pa.list_(pa.struct([("part", pa.int32()), ("states", pa.string())])))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, own_parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                facts, steps, paths = Facts(), [], []
                for p in own_parts:
                    facts.add(Facts(**{c: p[c] for c, _ in FACTS}))
                    step: dict[str, list] = {s: [] for s in FOLLOW}
                    for e in p["states"]:
                        step[e["start"]].append((e["end"], e["cost"], e["audit"]))
                    steps.append(step)
                    paths.append({(e["start"], e["end"]): e["path"] for e in p["states"]})
                _, (cost, audit, path) = best(lightest(steps, "0", LAST, insert=False))
                ways = [{"part": p["part"], "states": s + known[s, t]} for p, known, s, t in zip(own_parts, paths, "0" + path, path, strict=False)]
                yield _batch([{"conv_id": conv, **facts.row(), "cost": cost, "audit": audit, "ways": ways}], batch.column(0).type, fields)

    facts = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, first_initial string, last_initial string, first_turn bigint, last_turn bigint"
    return rows.mapInArrow(lean(work), f"conv_id {own}, {facts}, cost bigint, audit string, ways array<struct<part:int,states:string>>")


def _rebuilt(pieces: DataFrame, ways: DataFrame) -> DataFrame:
    """Messages of pieces, whose states before and after are known now."""
    own = dict(pieces.dtypes)["conv_id"]
    ways = ways.select(F.col("conv_id").alias("_conv"), F.explode("ways").alias("w")).select("_conv", F.col("w.part").alias("_part"), "w.states")
    rows = pieces.select("conv_id", "part", "piece", "rows").join(ways, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                conv, part, piece, packed, states = (c[k].as_py() for c in batch.columns)
                found = [Row(**r) for r in packed]
                start, end = states[piece], states[piece + 1]
                audit = lightest([edits(r) for r in found], start, end)[end][1]
                yield _batch([{"conv_id": conv, "part": part, "piece": piece, "messages": replay(found, audit, start)}], batch.column(0).type, [("part", pa.int32()), ("piece", pa.int32()), ("messages", pa.list_(MESSAGE))])

    return rows.select("conv_id", "part", "piece", "rows", "states").mapInArrow(lean(work), f"conv_id {own}, part int, piece int, messages array<struct<role:string,text:string>>")


class Repaired(NamedTuple):
    """``found``: a row for each conversation with gaps, blank, duplicate, truncated, illegal, cost, audit. ``messages``: (conv_id, part, piece, messages), in that order a conversation's repaired rows. ``whole``: the messages of those that have one piece."""

    found: DataFrame
    whole: DataFrame
    pieces: DataFrame

    @property
    def messages(self) -> DataFrame:
        return self.whole.unionByName(self.pieces)


def repair(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece: int = PIECE) -> Repaired:
    """Conversations of ``rows`` repaired at least cost, of equal ones with the least audit.

    Rows of a conversation are taken by turn, null first, then role and text; a
    null role or text is one blank. A row's first fault counts: blank,
    duplicate (of role and text earlier in the conversation), truncated (no
    [.!?] at the end). Blank rows and duplicates must go. A null id is a
    conversation of its own. Equal rows are counted, not repeated. Other
    columns are ignored; an empty table has no conversations. No conversation
    must fit a task but for its audit, which is one text.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))
    own = own.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    own = materialize(own.withColumn("same", F.md5(F.concat_ws(":", conv, F.length("role").cast("string"), "role", "text").cast("binary"))))
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = materialize(own.groupBy("same").agg(F.min(when).alias("first"), F.count("*").alias("times")).where("times > 1").select("same", "first"))
    flagged = join_keys(own, seen, "same", "left").withColumn("again", F.coalesce(when > F.col("first"), F.lit(False)))
    made = materialize(_derived(flagged, piece))
    whole = made.where("kind = 'whole'")
    chained = materialize(_chained(made.where("kind = 'part'")))
    counts = ["conv_id", *[c for c, _ in FACTS], "cost", "audit"]
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    found = whole.select(*counts).unionByName(chained.select(*counts)).select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    pieces = _rebuilt(made.where("kind = 'piece'"), chained)
    return Repaired(found, whole.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("piece"), "messages"), pieces)


def written(messages: Column) -> Column:
    """Messages as lines of role and text."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")


def digests(repaired: Repaired) -> DataFrame:
    """(conv_id, repaired_sha256): digests of the conversations' lines. Those in several pieces stream through one digest in order, a piece at a time."""
    own = dict(repaired.whole.dtypes)["conv_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, some, kind = None, False, pa.int64()
        out = lambda: _batch([{"conv_id": now[0], "repaired_sha256": now[1].hexdigest()}], kind, [("repaired_sha256", pa.string())])
        for batch in batches:
            kind = batch.column(0).type
            for conv, lines, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now[0]:
                    if now is not None:
                        yield out()
                    now, some = (conv, hashlib.sha256()), False
                if n:
                    now[1].update((("\n" if some else "") + lines).encode())
                    some = True
        if now is not None:
            yield out()

    ordered = repaired.pieces.select("conv_id", "part", "piece", written(F.col("messages")).alias("lines"), F.size("messages").alias("n")).repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    long = ordered.select("conv_id", "lines", "n").mapInArrow(lean(work), f"conv_id {own}, repaired_sha256 string")
    return repaired.whole.select("conv_id", F.sha2(written(F.col("messages")).cast("binary"), 256).alias("repaired_sha256")).unionByName(long)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults by crc32 of conversation and turn: dropped, emptied, without ends of sentences, repeated, or the user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(case == 4, "user").otherwise(blank("role"))
    times = F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(case != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired: their faults, the cost, the audit and a digest of what they then are."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repaired = repair(damaged(rows))
    ids = rows.select("conv_id").distinct()
    same = lambda c, df: df.withColumnRenamed("conv_id", c)
    out = ids.join(same("_a", repaired.found), F.col("conv_id").eqNullSafe(F.col("_a")), "left").join(same("_b", digests(repaired)), F.col("conv_id").eqNullSafe(F.col("_b")), "left")
    none = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return out.select("conv_id", *[F.coalesce(c, none.get(c, F.lit(0).cast("long"))).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")])
