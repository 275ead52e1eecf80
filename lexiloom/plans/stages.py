"""Stage graphs: named transforms of DataFrames wired by a small language, evaluated in topological order.

    clean = 0 :> lower -> tokens[order=2]; sizes = clean :> count; both = clean + clean :> dedupe; marked = 0:clean :> tag

Input 0 is the outer DataFrame. `a + b` is the union of both; `a:m` joins a with metadata m by set_id, `a^m` gives all
of a the one row of m. After `:>` transforms follow one another; after `|>` they are composed by `*`, the first one first. The
results are lazy DataFrames, so a stage that nothing reads costs nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Transform = Callable[..., DataFrame]
TOKEN = re.compile(r"\s*(:>|\|>|->|\"[^\"]*\"|'[^']*'|-?\d+\.\d+|-?\d+|[A-Za-z_][\w.]*|[;=+:^*,\[\]()])")


class Registry(dict):
    """Transforms by name."""

    def __call__(self, f: Transform) -> Transform:
        self[f.__name__] = f
        return f


@dataclass(frozen=True)
class Call:
    name: str
    options: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class Stage:
    name: str
    inputs: tuple[tuple[str, str, str], ...]  # data, ":" or "^" or "", metadata
    calls: tuple[Call, ...]


class Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while text[at:].strip():
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"can't read the stages at: {text[at : at + 30].strip()}")
            self.tokens.append(m[1])
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        got = self.peek()
        if not got or wanted and got not in wanted:
            raise ValueError(f"expected {' or '.join(wanted) or 'more'}, found {got or 'the end'}")
        self.at += 1
        return got

    def stages(self) -> list[Stage]:
        out = [self.stage()]
        while self.peek():
            self.take(";")
            if self.peek():
                out.append(self.stage())
        return out

    def stage(self) -> Stage:
        name = self.take()
        self.take("=")
        inputs = [self.input()]
        while self.peek() == "+":
            self.take()
            inputs.append(self.input())
        link = "->" if self.take(":>", "|>") == ":>" else "*"
        calls = [self.call()]
        while self.peek() == link:
            self.take()
            calls.append(self.call())
        return Stage(name, tuple(inputs), tuple(calls))

    def input(self) -> tuple[str, str, str]:
        data = self.take()
        if self.peek() in (":", "^"):
            return data, self.take(), self.take()
        return data, "", ""

    def call(self) -> Call:
        name, options = self.take(), []
        if self.peek() == "[":
            self.take()
            while self.peek() != "]":
                key = self.take()
                self.take("=")
                options.append((key, self.value(self.take())))
                if self.peek() == ",":
                    self.take()
            self.take("]")
        return Call(name, tuple(options))

    @staticmethod
    def value(token: str) -> object:
        if token[0] in "\"'":
            return token[1:-1]
        if re.fullmatch(r"-?\d+", token):
            return int(token)
        return float(token) if re.fullmatch(r"-?\d+\.\d+", token) else token


def parse(text: str) -> list[Stage]:
    return Parser(text).stages()


def levels(stages: list[Stage]) -> list[list[str]]:
    """Stages that can run at once, level by level. A cycle or an unknown input raises."""
    needs = {s.name: {x for d, _, m in s.inputs for x in (d, m) if x and x != "0"} for s in stages}
    if unknown := {n for ns in needs.values() for n in ns} - set(needs):
        raise ValueError(f"unknown inputs: {', '.join(sorted(unknown))}")
    out: list[list[str]] = []
    done: set[str] = set()
    while len(done) < len(needs):
        ready = sorted(n for n, ns in needs.items() if n not in done and ns <= done)
        if not ready:
            raise ValueError("the stages form a cycle")
        out.append(ready)
        done |= set(ready)
    return out


def with_metadata(data: DataFrame, how: str, meta: DataFrame) -> DataFrame:
    if how == ":":
        return data.join(meta, "set_id")
    return data.join(F.broadcast(meta.limit(1)))  # one row, to all


def run(text: str, outer: DataFrame, registry: Registry) -> dict[str, DataFrame]:
    """All stages' results by name."""
    stages = {s.name: s for s in parse(text)}
    done: dict[str, DataFrame] = {"0": outer}
    for level in levels(list(stages.values())):
        for name in level:
            s = stages[name]
            parts = [done[d] if not how else with_metadata(done[d], how, done[m]) for d, how, m in s.inputs]
            df = parts[0]
            for p in parts[1:]:
                df = df.unionByName(p)
            for c in s.calls:
                if c.name not in registry:
                    raise ValueError(f"no transform named {c.name}")
                df = registry[c.name](df, **dict(c.options))
            done[name] = df
    return {n: df for n, df in done.items() if n != "0"}
