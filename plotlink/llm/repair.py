"""Repair of the turn structure of conversations with the cheapest edits.

Turns must follow the pattern `(s?(ua)+)?` of role initials. A turn is kept (K, 0), given another role (R, 1) or deleted (D, 2),
and a turn without text can be put in anywhere (I, 5); an undeleted turn that breaks off costs 5 more; blank turns and
repetitions must go. The edits are paths in a graph whose nodes are a place in the conversation and what the pattern has seen
(nothing, s, u or a). The least cost from the start to a node plus that from the node to an end tells whether an optimal path
leads through it; an arc is tight if the costs on both of its sides and its own make up the optimum. All tight arcs form an
acyclic graph; a walk through it keeps the set of nodes that the letters so far can lead to, and takes the least letter on any
arc out of that set, which gives the least of all optimal strings of edits.

A turn is one of sixteen letters for that purpose, so a conversation is a short string. Conversations longer than a block are cut:
a block's costs are a 4 x 4 matrix, from whose products the costs at all block ends follow, and a block's walk is a function
from sets to sets. Texts stay out of it; a last pass streams them beside the edits, conversation by conversation.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotlink.llm import common

#: Turns that one call solves at once, and that lie between two stored costs of a long conversation.
BLOCK = 4096
#: Costs of the contract (fixed values).
REROLE, DELETE, INSERT, BROKEN = 1, 2, 5, 5

START, SYSTEM, USER, ASSISTANT = range(4)
_FAR = 1 << 60
_BEFORE_USER = (START, SYSTEM, ASSISTANT)
_INSERTS = [(g, USER) for g in _BEFORE_USER] + [(USER, ASSISTANT)]

TURNS = "conv_id long, turn long, role string, text string"
_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_EDITED = "conv_id long, place long, edit string, role binary, text binary"

Vector = tuple[int, int, int, int]


@functools.cache
def _arcs(code: str) -> dict[str, list[tuple[int, int, int]]]:
    """Arcs (from, to, cost) that use a turn up, by letter. code: `A` and 4 times the initial (s, u, a, other) plus the fault
    (none, blank, duplicate, truncated)."""
    initial, fault = divmod(ord(code) - 65, 4)
    out = {"D": [(g, g, DELETE) for g in range(4)]}
    if fault not in (1, 2):
        more = BROKEN if fault == 3 else 0
        changes = {0: [(START, SYSTEM)], 1: [(g, USER) for g in _BEFORE_USER], 2: [(USER, ASSISTANT)], 3: []}
        out["K"] = [(f, t, more) for f, t in changes[initial]]
        out["R"] = [(f, t, REROLE + more) for f, t in changes[1] + changes[2]]
    return out


def _relaxed(v: Vector, forward: bool) -> Vector:
    out = list(v)
    for _ in range(2):
        for f, t in _INSERTS:
            if forward:
                out[t] = min(out[t], out[f] + INSERT)
            else:
                out[f] = min(out[f], out[t] + INSERT)
    return tuple(out)


@functools.lru_cache(100_000)
def _step(v: Vector, code: str, forward: bool) -> Vector:
    out = [_FAR] * 4
    for arcs in _arcs(code).values():
        for f, t, c in arcs:
            at, to = (f, t) if forward else (t, f)
            out[to] = min(out[to], v[at] + c)
    return _relaxed(tuple(min(x, _FAR) for x in out), forward)


def _move(v: Vector, code: str, forward: bool) -> Vector:
    """One turn on. Steps are remembered for costs less their least, of which there are few."""
    least = min(v)
    return tuple(x + least if x < _FAR else _FAR for x in _step(tuple(x - least if x < _FAR else _FAR for x in v), code, forward))


def _costs(codes: str, v: Vector, forward: bool) -> list[Vector]:
    """Least costs at each place of a block, from its left or right end."""
    out = [_relaxed(v, forward)]
    for code in codes if forward else reversed(codes):
        out.append(_move(out[-1], code, forward))
    return out if forward else out[::-1]


BEGIN = _relaxed((0, _FAR, _FAR, _FAR), True)
END = _relaxed((0, _FAR, _FAR, 0), False)


def _walk(codes: str, ahead: list[Vector], behind: list[Vector], total: int, frontier: frozenset[int], last: bool) -> tuple[str, frozenset[int]]:
    """The least letters through a block from a set of nodes, and the set at its end."""
    letters, i = [], 0
    while True:
        if i == len(codes) and (not last or any(ahead[i][g] == total for g in frontier & {START, ASSISTANT})):
            return "".join(letters), frontier
        arcs = _arcs(codes[i]) if i < len(codes) else {}
        for letter in "DIKR":
            step = letter != "I"
            options = arcs.get(letter, []) if step else [(f, t, INSERT) for f, t in _INSERTS]
            to = frozenset(t for f, t, c in options if f in frontier and ahead[i][f] + c + behind[i + step][t] == total)
            if to:
                letters.append(letter)
                frontier, i = to, i + step
                break
        else:
            raise AssertionError("no tight arc leads on")


@functools.lru_cache(50_000)
def solve(codes: str) -> tuple[str, int]:
    """The least optimal string of edits and its cost."""
    ahead, behind = _costs(codes, BEGIN, True), _costs(codes, END, False)
    return _walk(codes, ahead, behind, behind[0][START], frozenset([START]), True)[0], behind[0][START]


def _coded(rows: DataFrame) -> DataFrame:
    """grp, idx, n, code of rows as `_placed` gives them. Repetitions are found by digests of role and text."""
    role, text = F.col("role"), F.col("text")
    core = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    initial = F.coalesce(F.array_position(F.array(F.lit("s"), F.lit("u"), F.lit("a")), F.substring(role, 1, 1)), F.lit(0))
    content = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    fault = F.when(core == "", 1).when(~F.substring(core, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    seen = common.stored(rows.select("grp", "idx", "n", content.alias("content"), F.when(initial == 0, 3).otherwise(initial - 1).alias("initial"), fault.alias("fault")), "turn-codes")
    first = seen.groupBy("grp", "content").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    fault = F.when((F.col("idx") > F.col("first")) & (F.col("fault") != 1), 2).otherwise(F.col("fault"))
    return seen.join(first, ["grp", "content"], "left").select("grp", "idx", "n", F.char(F.lit(65) + 4 * F.col("initial") + fault).alias("code"))


def _placed(turns: DataFrame) -> DataFrame:
    """Turns with grp (the conversation as a string), idx and n. Ties go by role, then text; ranges are cut by a text's first
    characters, so that no whole text is sampled."""
    rows = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("grp"), "conv_id", "turn", "role", "text")
    return common.indexed(rows, "grp", ["turn", "role", "text"], [F.col("turn"), F.substring("role", 1, 32), F.substring("text", 1, 32)])


def _mapped(df: DataFrame, schema: str, fn) -> DataFrame:
    """fn from the values of a row to those of a row."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [fn(*r) for r in zip(*[batch.column(c).to_pylist() for c in names], strict=True)]
            yield pa.RecordBatch.from_pylist(rows, out) if rows else pa.RecordBatch.from_pylist([], out)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)


def _bits(mask: int) -> frozenset[int]:
    return frozenset(g for g in range(4) if mask >> g & 1)


def _mask(nodes: frozenset[int]) -> int:
    return sum(1 << g for g in nodes)


def _matrix(grp, block, codes):
    rows = [_costs(codes, tuple(0 if g == k else _FAR for g in range(4)), True)[-1] for k in range(4)]
    return {"grp": grp, "block": block, "m": [x for r in rows for x in r]}


def _ends(pdf: pd.DataFrame) -> pd.DataFrame:
    """Costs at a long conversation's block ends from its matrices."""
    pdf = pdf.sort_values("block", ignore_index=True)
    ahead, behind = [BEGIN], [END]
    through = lambda v, m: tuple(min(_FAR, *(v[k] + m[4 * k + g] for k in range(4))) for g in range(4))
    back = lambda v, m: tuple(min(_FAR, *(v[k] + m[4 * g + k] for k in range(4))) for g in range(4))
    for m in pdf["m"][:-1]:
        ahead.append(through(ahead[-1], [int(x) for x in m]))
    for m in pdf["m"][:0:-1]:
        behind.append(back(behind[-1], [int(x) for x in m]))
    total = back(behind[-1], [int(x) for x in pdf["m"][0]])[START]
    return pd.DataFrame({"grp": pdf["grp"], "block": pdf["block"], "ahead": ahead, "behind": behind[::-1], "total": total, "last": pdf["block"] == pdf["block"].max()})


def _walks(grp, block, codes, ahead, behind, total, last):
    """A block's walk as a function from sets of optimal nodes to sets; -1 where no walk can begin."""
    a, b = _costs(codes, tuple(ahead), True), _costs(codes, tuple(behind), False)
    optimal = frozenset(g for g in range(4) if a[0][g] + b[0][g] == total)
    to = [_mask(_walk(codes, a, b, total, _bits(m), last)[1]) if m and _bits(m) <= optimal else -1 for m in range(16)]
    return {"grp": grp, "block": block, "to": to}


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """The set with which a long conversation's walk enters each block."""
    pdf = pdf.sort_values("block", ignore_index=True)
    masks = [1 << START]
    for to in pdf["to"][:-1]:
        masks.append(int(to[masks[-1]]))
    return pd.DataFrame({"grp": pdf["grp"], "block": pdf["block"], "mask": masks})


def _audit_block(grp, block, codes, ahead, behind, total, last, mask):
    audit = _walk(codes, _costs(codes, tuple(ahead), True), _costs(codes, tuple(behind), False), total, _bits(mask), last)[0]
    return {"grp": grp, "block": block, "codes": codes, "audit": audit, "cost": total if last else 0}


def edits(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """grp, block, codes, audit, cost (of the whole conversation, in its last block) for blocks of turns as `_placed` gives them."""
    turn = F.struct("idx", "code")
    coded = _coded(placed).withColumn("block", F.floor(F.col("idx") / block))
    blocks = coded.groupBy("grp", "n", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(turn)), lambda t: t["code"]), "").alias("codes"))
    blocks = common.stored(blocks, "turn-blocks")
    schema = "grp string, block long, codes string, audit string, cost long"
    short = _mapped(blocks.where(F.col("n") <= block).select("grp", "block", "codes"), schema, lambda grp, b, codes: {"grp": grp, "block": b, "codes": codes, "audit": solve(codes)[0], "cost": solve(codes)[1]})
    long = blocks.where(F.col("n") > block).select("grp", "block", "codes")
    if long.isEmpty():
        return short
    ends = _mapped(long, "grp string, block long, m array<long>", _matrix).groupBy("grp").applyInPandas(_ends, "grp string, block long, ahead array<long>, behind array<long>, total long, last boolean")
    known = common.stored(long.join(ends, ["grp", "block"]).select("grp", "block", "codes", "ahead", "behind", "total", "last"), "turn-ends")
    entered = _mapped(known, "grp string, block long, to array<int>", _walks).groupBy("grp").applyInPandas(_entries, "grp string, block long, mask int")
    solved = known.join(entered, ["grp", "block"]).select("grp", "block", "codes", "ahead", "behind", "total", "last", "mask")
    return short.unionByName(_mapped(solved, schema, _audit_block))


class _Conversation:
    """One conversation while its turns pass by."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.cost, self.audit = conv_id, 0, []
        self.faults, self.illegal, self.initial = [0, 0, 0, 0], 0, None
        self.low = self.high = None
        self.turns = 0
        self.codes, self.letters, self.at, self.step = "", "", 0, 0
        self.out, self.place = "", 0

    def block(self, codes: str, audit: str, cost: int) -> list[tuple]:
        done = self.rest()
        self.codes, self.letters, self.at, self.step = codes, audit, 0, 0
        self.cost += cost
        self.audit.append(audit)
        for c in codes:
            initial, fault = divmod(ord(c) - 65, 4)
            self.faults[fault] += 1
            if self.initial is not None and (self.initial, initial) not in ((0, 1), (1, 2), (2, 1)):
                self.illegal += 1
            self.initial = initial
        return done

    def _next_role(self) -> bytes:
        return b"assistant" if self.out == "u" else b"user"

    def _put(self, edit: str, role: bytes, text: bytes) -> tuple:
        self.out = role[:1].decode("ascii", "replace")
        self.place += 1
        return (self.conv_id, self.place - 1, edit, role, text)

    def rest(self) -> list[tuple]:
        """Turns put in where the letters go on without using a turn up."""
        done = []
        while self.letters[self.step : self.step + 1] == "I":
            self.step += 1
            done.append(self._put("I", self._next_role(), b""))
        return done

    def turn(self, turn: int | None, role: bytes, text: bytes) -> list[tuple]:
        """Turns of the repaired conversation that this one leads to."""
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        done = self.rest()
        edit = self.letters[self.step]
        self.step += 1
        if edit == "R":
            role = self._next_role()
        return done if edit == "D" else [*done, self._put(edit, role, text)]

    def report(self, digest: str) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), digest)


def _streamed(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Conversations pass by turn by turn, each block's edits ahead of its turns; nothing of a conversation is kept but its audit.
    whole: repaired turns go out, else one report a conversation."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.binary()), ("text", pa.binary())]) if whole else pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    grp, now, sha = None, None, None

    def written(done: list[tuple]) -> list[tuple]:
        for _, place, _, role, text in done:
            sha.update((b"\n" if place else b"") + role + b":" + text)
        return done

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    for batch in batches:
        out = []
        names = ("grp", "kind", "conv_id", "turn", "role", "text", "codes", "audit", "cost")
        for name, kind, conv_id, turn, role, text, codes, audit, cost in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            if name != grp:
                if now is not None:
                    done = written(now.rest())
                    out += done if whole else [now.report(sha.hexdigest())]
                grp, now, sha = name, _Conversation(conv_id), hashlib.sha256()
            if kind == 1:
                done = written(now.block(codes, audit, cost))
            elif kind == 2:
                done = written(now.turn(turn, role, text))
            else:
                continue
            out += done if whole else []
        if out:
            yield pack(out)
    if now is not None:
        done = written(now.rest())
        last = done if whole else [now.report(sha.hexdigest())]
        if last:
            yield pack(last)


def _stream(turns: DataFrame, ids: DataFrame, schema: str, whole: bool, block: int) -> DataFrame:
    placed = _placed(turns)
    null = lambda **types: [F.lit(None).cast(t).alias(c) for c, t in types.items()]
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("grp")
    heads = ids.select("conv_id").distinct().select(key, F.lit(-1).cast("long").alias("idx"), F.lit(0).alias("kind"), "conv_id", *null(turn="long", role="binary", text="binary", codes="string", audit="string", cost="long"))
    blocks = edits(placed, block).select("grp", (F.col("block") * block).alias("idx"), F.lit(1).alias("kind"), *null(conv_id="long", turn="long", role="binary", text="binary"), "codes", "audit", "cost")
    rows = placed.select("grp", "idx", F.lit(2).alias("kind"), "conv_id", "turn", F.col("role").cast("binary"), F.col("text").cast("binary"), *null(codes="string", audit="string", cost="long"))
    return heads.unionByName(blocks).unionByName(rows).repartition("grp").sortWithinPartitions("grp", "idx", "kind").mapInArrow(lambda b: _streamed(b, whole), schema)


def _turns(conversations: DataFrame) -> DataFrame:
    """The columns that count; a null role or text is one space."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])


def repaired(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, place, edit, role, text of the turns of the repaired conversations. One that loses all turns has no rows."""
    turns = _turns(conversations)
    out = _stream(turns, turns, _EDITED, True, block)
    return out.select("conv_id", "place", "edit", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def report(conversations: DataFrame, ids: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One row per conversation: faults, cost, edits and a digest of the repaired turns.

    Turns go by number, null first, ties by role and text; equal rows are repetitions. A null conv_id is a conversation of its
    own. Conversations of ids without turns have zeros, no edits and the digest of nothing. Empty texts are blank; texts may be of
    any length. An empty table gives no rows. Only the last pass sees the turns of a conversation in one task, as a stream: a
    digest over all of its text can't be had otherwise.
    """
    turns = _turns(conversations)
    return _stream(turns, turns if ids is None else ids, _REPORT, False, block)


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage: by a hash of conv_id and turn a row goes, loses its text or its sentence ends, comes twice, or
    is a user's."""
    turns = _turns(conversations)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(fate == 4, "user").otherwise(F.col("role"))
    times: Column = F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.where(fate != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The registered query: the report on damaged conversations."""
    return report(damaged(conversations), conversations.select(F.col("conv_id").cast("long").alias("conv_id")))
