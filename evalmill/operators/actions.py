"""Action logs, and replay and checking of sessions of simulated services."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.operators.relational import top_k
from evalmill.operators.simulated import SERVICES
from evalmill.operators.simulated.core import Service, as_json, public

#: Calls with this method start a service anew from the scenario that their arguments hold.
LOAD = "load"


def history(log: DataFrame, session: str, order: list[str], size: int = 10) -> DataFrame:
    """The last ``size`` actions of each session, newest first."""
    return top_k(log, [session], [F.desc(c) for c in order], size)


def arguments(text: str | None) -> dict | None:
    """Arguments as JSON; none for null, and None for what isn't an object."""
    try:
        found = json.loads(text) if text else {}
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def apply(states: dict[str, dict], services: dict[str, Service], service: str, method: str | None, args: str | None) -> Any:
    """One call on the session's states; unknown services and unreadable arguments are error values."""
    if service not in services:
        return {"error": f"no service {service}"}
    read = arguments(args)
    if read is None:
        return {"error": "arguments aren't a JSON object"}
    if method == LOAD:
        states[service] = services[service].start(read)
        return None
    if service not in states:
        states[service] = services[service].start()
    return services[service].call(states[service], method or "", read)


def in_order(df: DataFrame, keys: list[str], order: list[str], cols: list[str], fold: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """``fold`` over each task's rows, sorted by keys and order; rows of a key follow each other in one task.

    Spark sorts and spills; the task holds a batch and what ``fold`` keeps, however long a session is.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (tuple(None if isinstance(x, float) and x != x else x for x in r) for f in frames for r in f.itertuples(index=False, name=None))
        buffer: list[tuple] = []
        for out in fold(rows):
            buffer.append(out)
            if len(buffer) >= 4096:
                yield pd.DataFrame(buffer, columns=names)
                buffer = []
        if buffer:
            yield pd.DataFrame(buffer, columns=names)

    return df.select(*keys, *order, *cols).repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *cols).mapInPandas(run, schema)


def replay(calls: DataFrame, session: str = "session", order: str = "ord", services: dict[str, Service] | None = None) -> DataFrame:
    """(session, service, ord, result, state) a call: its result as JSON, and the state after a session's last call, else null.

    ``calls`` has service, method and args (a JSON object, null for none).  Only operations of the
    services run.  Calls of equal order run by method and arguments.  Null sessions are one session.
    """
    known = SERVICES if services is None else services

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        held, states = None, {}
        for key, service, at, method, args in rows:
            if held and held[:2] != (key, service):
                yield *held, as_json(public(states[held[1]])) if held[1] in states else None
                states = {}
            elif held:
                yield *held, None
            held = (key, service, at, as_json(apply(states, known, service, method, args)))
        if held:
            yield *held, as_json(public(states[held[1]])) if held[1] in states else None

    df = calls.select(F.col(session).cast("string").alias("session"), F.col("service").cast("string").alias("service"), F.coalesce(F.col(order).cast("long"), F.lit(-1)).alias("ord"), "method", "args")
    return in_order(df.select("session", "service", F.col("ord").alias("em_at"), F.col("method").alias("em_m"), F.col("args").alias("em_a"), "ord", "method", "args"), ["session", "service"], ["em_at", "em_m", "em_a"], ["ord", "method", "args"], fold, "session string, service string, ord long, result string, state string")


def check_turns(calls: DataFrame, services: dict[str, Service] | None = None) -> DataFrame:
    """(session, valid, error_type, turn) a session: the model's calls against the true ones, turn by turn.

    ``calls`` has session, turn, side (``model`` or ``truth``; null for scenarios that both load), ord,
    service, method and args; a null method marks a turn without calls.  After each turn with true calls
    the model must have called something, all public states must be equal, and each result of the true
    calls must be among the model's results so far, as often.  The first failure decides.  Sides with
    other turns were ended by force.
    """
    known = SERVICES if services is None else services

    class Session:
        def __init__(self):
            self.states: dict[str, dict[str, dict]] = {"model": {}, "truth": {}}
            self.seen: Counter = Counter()
            self.turns = {"model": set(), "truth": set()}
            self.failed: tuple[str, int] | None = None
            self.turn: int | None = None
            self.results: dict[str, list] = {"model": [], "truth": []}

        def end_turn(self) -> None:
            self.seen.update(self.results["model"])
            if self.results["truth"] and not self.failed:
                if not self.results["model"]:
                    self.failed = ("multi_turn:empty_turn_model_response", self.turn)
                elif self.differ():
                    self.failed = ("multi_turn:instance_state_mismatch", self.turn)
                elif Counter(self.results["truth"]) - self.seen:
                    self.failed = ("multi_turn:execution_response_mismatch", self.turn)
            self.results = {"model": [], "truth": []}

        def differ(self) -> bool:
            a, b = self.states["model"], self.states["truth"]
            fresh = lambda s: known[s].start()
            return any(public(a.get(s) or fresh(s)) != public(b.get(s) or fresh(s)) for s in {*a, *b})

        def add(self, turn: int, side: str | None, service: str, method: str | None, args: str | None) -> None:
            if self.turn is not None and turn != self.turn:
                self.end_turn()
            self.turn = turn
            if side is None:
                for s in self.states.values():
                    apply(s, known, service, method, args)
                return
            self.turns[side].add(turn)
            if method is not None:
                result = as_json(apply(self.states[side], known, service, method, args))
                if method != LOAD:
                    self.results[side].append(f"{service}:{result}")

        def verdict(self, key: str | None) -> tuple:
            self.end_turn()
            if self.turns["model"] != self.turns["truth"]:
                return key, False, "multi_turn:force_terminated", None
            return (key, True, None, None) if not self.failed else (key, False, *self.failed)

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        key, held = None, None
        for name, turn, side, service, method, args in rows:
            if held and name != key:
                yield held.verdict(key)
                held = None
            key, held = name, held or Session()
            held.add(turn, side, service, method, args)
        if held:
            yield held.verdict(key)

    df = calls.select(F.col("session").cast("string").alias("session"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), "side", F.coalesce(F.col("ord").cast("long"), F.lit(-1)).alias("ord"), "service", "method", "args")
    keyed = df.select("session", F.col("turn").alias("em_turn"), F.col("side").alias("em_side"), F.col("ord").alias("em_ord"), "turn", "side", "service", "method", "args")
    return in_order(keyed, ["session"], ["em_turn", "em_side", "em_ord"], ["turn", "side", "service", "method", "args"], fold, "session string, valid boolean, error_type string, turn long")


def first_true(log: DataFrame, key: str, forward: str, ok: Column, order: str) -> DataFrame:
    """The undo log: for each forward action its first undo that worked, and all that failed, in order."""
    tried = log.select(key, forward, F.col(order).alias("em_at"), "undo", F.coalesce(ok, F.lit(False)).alias("em_ok"))
    failed = F.array_sort(F.collect_list(F.when(~F.col("em_ok"), F.struct("em_at", "undo"))))
    grouped = tried.groupBy(key, forward).agg(F.min_by("undo", F.when(F.col("em_ok"), F.col("em_at"))).alias("em_best"), F.max("em_ok").alias("em_any"), failed.alias("em_failed"))
    return grouped.select(key, forward, F.when(F.col("em_any"), F.col("em_best")).alias("success"), F.col("em_failed.undo").alias("failures"))
