"""Declarative registries: projections and their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# Projections and the edge kinds of each; owns and implements are always transparent.
PROJECTIONS = {
    "dependencies": ["calls", "depends_on"],
    "data flow": ["calls", "reads", "writes", "transforms", "publishes", "consumes"],
    "runtime": ["calls", "reads", "writes", "publishes", "consumes", "depends_on"],
    "impact": ["calls", "depends_on", "reads", "writes", "publishes", "consumes"],
    "coverage": ["calls", "tests"],
    "complexity": ["calls", "depends_on"],
    "contracts": ["calls", "depends_on", "publishes", "consumes"],
    "lint": ["calls", "depends_on", "reads", "writes", "publishes", "consumes"],
    "review": ["calls", "depends_on", "reads", "writes", "publishes", "consumes"],
    "what-can-break": ["calls", "depends_on", "implements", "retries", "writes", "publishes", "consumes"],
    "hot-path": ["calls", "publishes", "consumes"],
    "state-mutation": ["calls", "writes", "publishes"],
    "retry-paths": ["retries", "calls"],
    "transaction-boundaries": ["calls", "reads", "writes"],
    "cross-team-dependencies": ["calls", "publishes", "consumes", "implements"],
    "what-changed-architecturally": ["calls", "depends_on", "reads", "writes", "publishes", "consumes", "implements"],
}
# What the frontiers of a projection are grouped by; the first that any member has counts.
GROUPINGS = {
    "hot-path": ["traffic", "service", "package", "relation"],
    "state-mutation": ["access", "service", "package", "relation"],
    "transaction-boundaries": ["access", "service", "package", "relation"],
    "cross-team-dependencies": ["team", "service", "package", "relation"],
    "what-can-break": ["service", "team", "package", "relation"],
}
GROUPING = ["service", "package", "relation"]
TRANSPARENT = ["owns", "implements"]
NEEDS = {"hot-path": "runtime", "cross-team-dependencies": "ownership", "what-changed-architecturally": "changes"}


@dataclass(frozen=True)
class ProjectionRequest:
    """What a bounded view asks for."""

    roots: tuple[str, ...] = ()
    projection: str = "dependencies"
    upstream: int | None = 1
    downstream: int | None = 2
    budget: int = 30
    hard_budget: int = 40
    branch: int = 8
    page: int = 8
    pins: tuple[str, ...] = ()
    required_nodes: tuple[str, ...] = ()
    required_edges: tuple[str, ...] = ()
    expansions: dict[str, int] = field(default_factory=dict)
    evidence_level: str = "inferred"
    include_stale: bool = True
