"""What limits, breakers and caches do with one event after another: pure steps from a state to the next, for batches and streams alike.

Times are whole microseconds. A state is what JSON can hold, so that streams can keep it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple


class Fold(NamedTuple):
    start: Callable[[], Any]
    step: Callable[..., tuple[Any, Any]]


def _micros(seconds: float) -> int:
    return round(seconds * 1_000_000)


def anchored(width: float, most: int) -> Fold:
    """A window opens with the first event and lasts `width` seconds; `most` are allowed in it."""

    def step(state: list, t: int) -> tuple[list, bool]:
        opened, n = state
        if opened is None or t - opened >= _micros(width):
            opened, n = t, 0
        return [opened, n + 1], n < most

    return Fold(lambda: [None, 0], step)


def aligned(width: int, most: int) -> Fold:
    """Windows of `width` seconds from the epoch on; `most` are allowed in each."""

    def step(state: list, t: int) -> tuple[list, bool]:
        window, n = state
        now = t // _micros(width)
        n = n if window == now else 0
        return [now, n + 1], n < most

    return Fold(lambda: [None, 0], step)


def bucket(burst: int, refill: float) -> Fold:
    """A token a use; one comes back each whole `refill` seconds, up to `burst`."""

    def step(state: list, t: int) -> tuple[list, bool]:
        tokens, last = state
        last = t if last is None else last
        back = (t - last) // _micros(refill)
        if back > 0:
            tokens, last = min(burst, tokens + back), last + back * _micros(refill)
        return [max(tokens - 1, 0), last], tokens > 0

    return Fold(lambda: [burst, None], step)


def breaker(failures: int, rest: float) -> Fold:
    """The state before each event: closed; open after `failures` in a row or one when half-open; half-open `rest` seconds later."""

    def step(state: list, t: int, ok: bool) -> tuple[list, str]:
        name, row, since = state
        if name == "open" and t - since >= _micros(rest):
            name = "half-open"
        before = name
        if before != "open":
            row = 0 if ok else row + 1
            if ok:
                name = "closed"
            elif before == "half-open" or row >= failures:
                name, since, row = "open", t, 0
        return [name, row, since], before

    return Fold(lambda: ["closed", 0, 0], step)


def recently_used(most: int) -> Fold:
    """Items from the least to the most recently used, `most` at most; what goes at each use."""

    def step(state: list, t: int, item: str) -> tuple[list, list]:
        held = [x for x in state if x != item] + [item]
        return held[-most:], held[:-most]

    return Fold(list, step)


def registry(most: int, idle: float) -> Fold:
    """Open sessions, `most` at most, in the order in which they were opened; a use keeps one open, `idle` seconds without one end it.
    What goes at each use: those that are idle, then, where a new one finds no room, the one that was opened first."""

    def step(state: list, t: int, session: str) -> tuple[list, list]:
        live = [x for x in state if t - x[1] < _micros(idle)]
        gone = [x[0] for x in state if t - x[1] >= _micros(idle)]
        if any(x[0] == session for x in live):
            return [[name, t if name == session else last] for name, last in live], gone
        if len(live) >= most:
            gone.append(live[0][0])
            live = live[1:]
        return [*live, [session, t]], gone

    return Fold(list, step)
