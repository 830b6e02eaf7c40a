"""Stages with budgets: what runs, what is skipped, retried, degraded or failed, and its telemetry."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

#: Fixed value: ms under which no attempt begins.
LEAST_LEFT = 5.0


class StageTimeout(Exception):
    """A stage took longer than its budget; never tried again."""


@dataclass
class Stage:
    name: str
    run: Callable[[Any], Any]
    budget_ms: float
    retries: int = 0
    on_error: str = "fail"  # or "degrade": the value goes on unchanged
    min_remaining_ms: float = 0.0


@dataclass
class Told:
    name: str
    outcome: str  # ok, degraded, skipped, failed
    ms: float
    attempts: int
    note: str = ""


@dataclass
class Result:
    value: Any
    ok: bool
    total_ms: float
    telemetry: list[Told] = field(default_factory=list)


def run_stages(value: Any, stages: list[Stage], budget_ms: float, clock: Callable[[], float] = lambda: time.perf_counter() * 1000) -> Result:
    """Runs ``stages`` in order on the driver; a stage that raises StageTimeout or overruns its budget is not tried again."""
    began, told, ok = clock(), [], True
    for s in stages:
        left = budget_ms - (clock() - began)
        if not ok or left < s.min_remaining_ms:
            told.append(Told(s.name, "skipped", 0.0, 0, "an earlier stage failed" if not ok else "too little time left"))
            continue
        at, attempts, note, done = clock(), 0, "", False
        while attempts <= s.retries and not done:
            attempts += 1
            start = clock()
            try:
                got = s.run(value)
                if clock() - start > s.budget_ms:
                    raise StageTimeout(f"over {s.budget_ms:g} ms")
                value, done = got, True
            except StageTimeout as e:
                note = str(e) or "timed out"
                break
            except Exception as e:  # a stage's own error is its outcome
                note = f"{type(e).__name__}: {e}"
                if budget_ms - (clock() - began) < LEAST_LEFT:
                    break
        outcome = "ok" if done else "degraded" if s.on_error == "degrade" else "failed"
        ok = ok and outcome != "failed"
        told.append(Told(s.name, outcome, clock() - at, attempts, "" if done else note))
    return Result(value, ok, clock() - began, told)


class AnswerCache:
    """Answers by trimmed, lower-cased question and version of the sources; emptied past ``most`` or on a new version."""

    def __init__(self, most: int = 256):
        self.most, self.version, self.held = most, None, {}

    def get(self, question: str, version: Any) -> Any:
        return self.held.get(question.strip().lower()) if version == self.version else None

    def put(self, question: str, version: Any, answer: Any) -> None:
        if version != self.version or len(self.held) >= self.most:
            self.held, self.version = {}, version
        self.held[question.strip().lower()] = answer


def provider(config: dict[str, str]) -> str | None:
    """Who writes answers: an address of one's own, else the named one, else whose key there is, else nobody."""
    if config.get("base_url"):
        return "custom"
    return config.get("provider") or ("groq" if config.get("groq_key") else "anthropic" if config.get("anthropic_key") else None)


def warm(queries: list[Callable[[], Any]], cache: AnswerCache) -> int:
    """Runs ``queries`` once so that code is compiled and tables are read, then forgets what they answered."""
    for q in queries:
        q()
    cache.held = {}
    return len(queries)
