"""Sessions of simulated services: a state of plain values, and named operations over it.

A service is an initial state and its operations.  An operation takes the state
and its arguments and returns a value; ``Refused`` becomes an error value, so a
session never stops.  Keys that begin with an underscore are no part of what
two sessions are compared by.
"""

from __future__ import annotations

import copy
import json
import random
from collections.abc import Callable
from typing import Any


class Refused(Exception):
    """An operation that its preconditions forbid; ``extra`` joins the error value."""

    def __init__(self, message: str, **extra: Any):
        super().__init__(message)
        self.extra = extra


def require(ok: Any, message: str, **extra: Any) -> None:
    if not ok:
        raise Refused(message, **extra)


class Service:
    def __init__(self, seed: int = 0, prepare: Callable[[dict], None] | None = None, **initial: Any):
        self.seed, self.prepare, self.initial, self.operations = seed, prepare, initial, {}

    def operation(self, *guards: Callable[[dict], None], name: str | None = None):
        """Registers a function under its name; ``guards`` are checked first."""

        def add(fn: Callable) -> Callable:
            def run(state: dict, **args: Any) -> Any:
                for guard in guards:
                    guard(state)
                return fn(state, **args)

            self.operations[name or fn.__name__.rstrip("_")] = run
            return fn

        return add

    def start(self, scenario: dict | None = None) -> dict:
        """A fresh state; keys of ``scenario`` that the service knows replace its own."""
        scenario = scenario or {}
        state = copy.deepcopy({k: scenario.get(k, v) for k, v in self.initial.items()})
        state["_random"] = random.Random(scenario.get("random_seed", self.seed))
        if self.prepare:
            self.prepare(state)
        return state

    def call(self, state: dict, method: str, args: dict) -> Any:
        fn = self.operations.get(method)
        if fn is None:
            return {"error": f"no operation {method}"}
        try:
            return fn(state, **args)
        except Refused as e:
            return {**e.extra, "error": str(e)}
        except (TypeError, KeyError, ValueError, OverflowError, ArithmeticError) as e:
            return {"error": f"{type(e).__name__}: {e}"}


def digits(state: dict, n: int) -> int:
    """A number of ``n`` digits from the session's own generator."""
    return state["_random"].randint(10 ** (n - 1), 10**n - 1)


def public(state: dict) -> dict:
    return {k: v for k, v in state.items() if not k.startswith("_")}


def as_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, default=str)


def whole_keys(table: dict) -> dict:
    """``table`` with its keys as numbers, as JSON can't hold them."""
    return {int(k): v for k, v in table.items()}
