"""Review decisions replayed in their order: each is judged by what held at its moment, not by how things ended.

An event's candidate brings along what is fixed about it (recommendation, prerequisites, links of its alignment group); the
states change with the events. A session's events pass through one task as a sorted stream that keeps the state of touched
candidates and the session's commands; sessions are independent of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from plotlink.operators.match import APPLICABLE, DEFAULT_ACCEPT

OPEN, SKIPPED, APPLIED, REJECTED = "open", "skipped", "applied", "rejected"
_UNDECIDED = (OPEN, SKIPPED)


class _Session:
    """States of a session's candidates and its commands, the last one behind."""

    def __init__(self) -> None:
        self.state: dict[Any, str] = {}
        self.command: dict[Any, int] = {}
        self.members: dict[int, list] = {}
        self.done: list[int] = []
        self.undone: list[int] = []

    def of(self, key: Any) -> str:
        return self.state.get(key, OPEN)

    def _set(self, keys: list, to: str) -> list[dict]:
        changed = [k for k in keys if self.of(k) != to]
        self.state.update(dict.fromkeys(changed, to))
        return [{"id": k, "status": to} for k in changed]

    def _group(self, start: Any, links: list[dict]) -> list:
        """Who moves with start just now: links lead to undecided candidates only."""
        follow: dict[Any, list] = {}
        for link in links:
            follow.setdefault(link["src"], []).append(link["dst"])
        met, todo = {start}, [start]
        while todo:
            for k in follow.get(todo.pop(), ()):
                if k not in met and self.of(k) in _UNDECIDED:
                    met.add(k)
                    todo.append(k)
        return sorted(met)

    def _accept(self, seq: int, key: Any, force: bool, recommendation: str | None, can_apply: bool, needs: list, links: list[dict]) -> tuple[str, Any, list[dict]]:
        if self.of(key) not in _UNDECIDED:
            return "ignored", None, []
        if recommendation not in APPLICABLE or (recommendation not in DEFAULT_ACCEPT and not force):
            return "refused", None, []
        first = next((p for p in needs if self.of(p) in _UNDECIDED), None)
        if first is not None:
            return "held", first, self._set([first], OPEN)
        if not can_apply:
            return "failed", None, []
        group = self._group(key, links)
        self.command.update(dict.fromkeys(group, seq))
        self.members[seq] = group
        self.done.append(seq)
        for old in self.undone:
            del self.members[old]
        self.undone.clear()
        return APPLIED, None, self._set(group, APPLIED)

    def _back(self, frm: list[int], to: list[int], old: str, new: str) -> list[dict]:
        seq = frm.pop()
        to.append(seq)
        return self._set([k for k in self.members[seq] if self.command[k] == seq and self.of(k) == old], new)

    def event(self, seq: int, key: Any, decision: str, *fixed: Any) -> tuple[str, Any, list[dict]]:
        now = self.of(key)
        if decision in ("accept", "force"):
            return self._accept(seq, key, decision == "force", *fixed)
        if decision == "reject" and now in _UNDECIDED:
            return REJECTED, None, self._set([key], REJECTED)
        if decision == "skip" and now == OPEN:
            return SKIPPED, None, self._set([key], SKIPPED)
        if decision == "reset" and now != APPLIED:
            return "reset", None, self._set([key], OPEN)
        if self.done and (decision == "undo" or (decision == "reset" and self.command[key] == self.done[-1])):
            return "undone", None, self._back(self.done, self.undone, APPLIED, OPEN)
        if decision == "redo" and self.undone:
            return "redone", None, self._back(self.undone, self.done, OPEN, APPLIED)
        return "ignored", None, []


def _with_fixed(events: DataFrame, candidates: DataFrame, prerequisites: DataFrame, links: DataFrame | None, groups: DataFrame | None) -> DataFrame:
    kind = events.schema["id"].dataType.simpleString()
    needs = prerequisites.groupBy(F.col("candidate").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "prerequisite"))), lambda p: p["prerequisite"]).alias("needs"))
    can = F.coalesce("can_apply", F.lit(True)) if "can_apply" in candidates.columns else F.lit(True)
    c = candidates.select("id", "recommendation", can.alias("can_apply")).join(needs, "id", "left")
    if links is None or groups is None:
        c = c.withColumn("links", F.lit(None))
    else:
        inner = groups.join(links.select(F.col("src").alias("node"), "dst"), "node").groupBy(F.col("start").alias("id")).agg(F.collect_set(F.struct(F.col("node").alias("src"), "dst")).alias("links"))
        c = c.join(inner, "id", "left")
    e = events.select("session", "seq", "id", "decision").join(c, "id", "left")
    link = f"array<struct<src:{kind},dst:{kind}>>"
    return e.select("session", "seq", "id", "decision", "recommendation", F.coalesce("can_apply", F.lit(True)).alias("can_apply"), F.coalesce("needs", F.array().cast(f"array<{kind}>")).alias("needs"), F.coalesce(F.col("links").cast(link), F.array().cast(link)).alias("links"))


def replayed(events: DataFrame, candidates: DataFrame, prerequisites: DataFrame, links: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """session, seq, id, decision, outcome, redirect and changes (array of id, status) of every event.

    accept and force apply an undecided candidate, accept only one that is accepted by default; nothing else applies it
    (`refused`). While a prerequisite is undecided nothing is applied: the event is `held`, leads to the first such one
    (redirect), which is opened again if it was skipped. What is applied takes along whoever its group's links lead to over
    undecided candidates; one command then settles all of them. If that can't be done (can_apply is false) the event has
    `failed` and nothing changes. reject needs an undecided candidate, skip an open one. reset opens a candidate, an
    applied one only if its command is the session's last; undo takes the last command back, redo repeats the last one
    taken back, until a new command comes. Candidates that nothing is known about have no recommendation.

    events: session, seq (ascending within a session), id, decision; candidates: id, recommendation, can_apply (optional);
    prerequisites: candidate, prerequisite, n (their order); links: src, dst; groups: start, node.
    """
    out = f"session {events.schema['session'].dataType.simpleString()}, seq long, id {events.schema['id'].dataType.simpleString()}, decision string, outcome string, redirect {events.schema['id'].dataType.simpleString()}, changes array<struct<id:{events.schema['id'].dataType.simpleString()},status:string>>"
    rows = _with_fixed(events.withColumn("seq", F.col("seq").cast("long")), candidates, prerequisites, links, groups)
    schema = to_arrow_schema(events.sparkSession.createDataFrame([], out).schema)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, session, begun = None, _Session(), False
        for batch in batches:
            done = []
            for key, seq, *rest in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if not begun or key != name:
                    name, session, begun = key, _Session(), True
                outcome, redirect, changes = session.event(seq, *rest)
                done.append({"session": key, "seq": seq, "id": rest[0], "decision": rest[1], "outcome": outcome, "redirect": redirect, "changes": changes})
            yield pa.RecordBatch.from_pylist(done, schema)

    return rows.repartition("session").sortWithinPartitions("session", "seq").mapInArrow(run, out)


def final_states(replay: DataFrame) -> DataFrame:
    """session, id, status, since (seq) of every candidate that an event has changed."""
    c = replay.select("session", "seq", F.explode("changes").alias("c"))
    return c.groupBy("session", F.col("c.id").alias("id")).agg(F.max(F.struct("seq", "c.status")).alias("m")).select("session", "id", "m.status", F.col("m.seq").alias("since"))


