"""Requests of an investigation: commands over an immutable state, with bounded undo. No data moves here."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from .registry import PROJECTIONS

MOST_PINS, MOST_UNDO, VIEW_VERSION = 5, 50, 1


@dataclass(frozen=True)
class State:
    """What a view shows."""

    focal: str | None = None
    projection: str = "dependencies"
    question: str | None = None
    upstream: int | None = 1
    downstream: int | None = 2
    abstraction: str = "symbol"
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    evidence: str = "observed"
    include_stale: bool = False
    pins: tuple[str, ...] = ()
    path: tuple[str, ...] = ()
    expansions: dict[str, int] = field(default_factory=dict)
    snapshot: int | None = None


class CommandError(ValueError):
    """A command that its context does not allow."""


def _known(value: str, nodes: set[str]) -> str:
    if value not in nodes:
        raise CommandError(f"{value} is not in this graph")
    return value


def _depth(value: object) -> int | None:
    if value == "all":
        return None
    if value not in (0, 1, 2, 3):
        raise CommandError(f"depth {value} is not one of 0, 1, 2, 3, all")
    return value  # type: ignore[return-value]


def _pin(state: State, node: str) -> State:
    if node in state.pins:
        return state
    if len(state.pins) >= MOST_PINS:
        raise CommandError(f"there are {MOST_PINS} pins")
    return replace(state, pins=(*state.pins, node))


def _choose(value: str, known: object) -> str:
    if value not in known:  # type: ignore[operator]
        raise CommandError(f"{value} is unknown")
    return value


#: Name of a command, and what it makes of a state; arguments are checked against the nodes.
COMMANDS: dict[str, Callable[..., State]] = {
    "focus": lambda s, nodes, node: replace(s, focal=_known(node, nodes), path=(), expansions={}),
    "set-projection": lambda s, nodes, projection: replace(s, projection=_choose(projection, PROJECTIONS), question=None, expansions={}),
    "set-question": lambda s, nodes, question: replace(s, question=question, projection=_choose(question, PROJECTIONS), expansions={}),
    "set-depth": lambda s, nodes, upstream, downstream: replace(s, upstream=_depth(upstream), downstream=_depth(downstream)),
    "set-abstraction": lambda s, nodes, level: replace(s, abstraction=_choose(level, ("symbol", "package", "component", "service"))),
    "include": lambda s, nodes, kind: replace(s, include=tuple(sorted({*s.include, kind})), exclude=tuple(k for k in s.exclude if k != kind)),
    "exclude": lambda s, nodes, kind: replace(s, exclude=tuple(sorted({*s.exclude, kind})), include=tuple(k for k in s.include if k != kind)),
    "set-evidence": lambda s, nodes, level, include_stale=False: replace(s, evidence=_choose(level, ("proven", "observed", "inferred")), include_stale=include_stale),
    "pin": lambda s, nodes, node: _pin(s, _known(node, nodes)),
    "unpin": lambda s, nodes, node: replace(s, pins=tuple(p for p in s.pins if p != node)),
    "lock-path": lambda s, nodes, path: replace(s, path=tuple(_known(n, nodes) for n in path)),
    "unlock-path": lambda s, nodes: replace(s, path=()),
    "expand": lambda s, nodes, frontier: replace(s, expansions=s.expansions | {frontier: s.expansions.get(frontier, 0) + 1}),
    "collapse": lambda s, nodes, frontier: replace(s, expansions={k: v for k, v in s.expansions.items() if k != frontier}),
}


def apply(state: State, commands: list[dict], nodes: set[str]) -> State:
    """The state after all commands ({"command": name, ...arguments}); none takes effect if one is refused."""
    for command in commands:
        rest = {k: v for k, v in command.items() if k != "command"}
        state = COMMANDS[_choose(command["command"], COMMANDS)](state, nodes, **rest)
    return state


# The phrase that has a plan, and the nodes it pins at most.
RISKY_PATHS, PLANNED_PINS = "show only risky paths introduced by this pr", 3


def plan(phrase: str, changed: list[str]) -> list[dict]:
    """The commands that a phrase stands for; other phrases are refused."""
    if re.sub(r"[.?!]+$", "", phrase.strip().lower()) != RISKY_PATHS:
        raise CommandError(f"no commands stand for {phrase!r}")
    first = [{"command": "set-projection", "projection": "what-changed-architecturally"}, {"command": "set-evidence", "level": "observed", "include_stale": False}, {"command": "set-depth", "upstream": 1, "downstream": 2}]
    return [*first, *({"command": "pin", "node": n} for n in sorted(set(changed))[:PLANNED_PINS])]


def relationships(state: State) -> list[str]:
    return sorted({*PROJECTIONS[state.projection], *state.include} - {*state.exclude})


class History:
    """States with undo and redo."""

    def __init__(self, state: State):
        self.past: list[State] = []
        self.now, self.future = state, []  # type: ignore[var-annotated]

    def push(self, state: State) -> None:
        if state != self.now:
            self.past = [*self.past, self.now][-MOST_UNDO:]
            self.now, self.future = state, []

    def undo(self) -> State:
        if self.past:
            self.future = [self.now, *self.future]
            self.now = self.past.pop()
        return self.now

    def redo(self) -> State:
        if self.future:
            self.past.append(self.now)
            self.now, *self.future = self.future
        return self.now

    def breadcrumbs(self) -> list[str]:
        """Focal nodes of the same snapshot, each run of equal ones once."""
        trail = [s.focal for s in [*self.past, self.now] if s.snapshot == self.now.snapshot and s.focal]
        return [f for k, f in enumerate(trail) if k + 1 == len(trail) or trail[k + 1] != f]


def focal_of(state: State, nodes: set[str], fallback: str | None = None) -> str | None:
    """The focal node if it is there, else the first available of the path, the pins and the fallback."""
    return next((n for n in (state.focal, *state.path, *state.pins, fallback) if n in nodes), None)


@dataclass(frozen=True)
class SavedView:
    name: str
    context: str
    state: State
    version: int = VIEW_VERSION


def save_views(views: list[SavedView], path: str) -> None:
    """Write views, the last of each name and context (letter case aside), by name."""
    last = {(v.name.lower(), v.context): v for v in views}
    rows = [asdict(v) for v in sorted(last.values(), key=lambda v: (v.name, v.context))]
    with open(path, "w") as out:
        json.dump(rows, out)


def load_views(path: str) -> list[SavedView]:
    """Views of a file; unknown fields of older versions are left out."""
    fields = State.__dataclass_fields__
    with open(path) as file:
        rows = json.load(file)
    tuples = lambda state: {k: tuple(v) if isinstance(v, list) else v for k, v in state.items() if k in fields}
    return [SavedView(r["name"], r.get("context", ""), State(**tuples(r.get("state", {})))) for r in rows if re.search(r"\S", r.get("name", ""))]
