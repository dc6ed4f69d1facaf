"""Spark schemas of the entities."""

from __future__ import annotations

from pyspark.sql.types import StructType

_META = "STRUCT<exported: BOOLEAN, startLine: INT, endLine: INT, fingerprint: STRING, module: STRING, type: STRING, component: STRING>"

NODE = StructType.fromDDL(f"id STRING, kind STRING, label STRING, service STRING, pkg STRING, file STRING, owner STRING, owners ARRAY<STRING>, description STRING, tags ARRAY<STRING>, meta {_META}, pr STRING")
EDGE = StructType.fromDDL("id STRING, source STRING, target STRING, kind STRING, label STRING, boundary STRING, sync BOOLEAN, pr STRING, evidenceRefs ARRAY<STRING>, canonicalEdgeIds ARRAY<STRING>, underlyingCount INT")
EVIDENCE = StructType.fromDDL("id STRING, source STRING, strength STRING, subject STRUCT<kind: STRING, id: STRING>, summary STRING, location STRUCT<file: STRING, line: INT>, snapshotId BIGINT, commit STRING, reviewId STRING, observedAt TIMESTAMP, validUntil TIMESTAMP, metrics MAP<STRING, STRING>")
VIOLATION = StructType.fromDDL("id STRING, ruleId STRING, primaryNode STRING, path ARRAY<STRING>, severity STRING, title STRING, consequences ARRAY<STRING>, evidence ARRAY<STRUCT<kind: STRING, text: STRING>>")
COVERAGE = StructType.fromDDL("nodeId STRING, status STRING, line INT, tests ARRAY<STRING>, note STRING")
CONTRACT = StructType.fromDDL("id STRING, name STRING, type STRING, node STRING, path STRING, fingerprint STRING, shape MAP<STRING, STRING>")
TELEMETRY = StructType.fromDDL("nodeId STRING, rpm DOUBLE, qps DOUBLE, trafficObserved BOOLEAN, p50 DOUBLE, p95 DOUBLE, p99 DOUBLE, errorRate DOUBLE, lag DOUBLE, window STRING, source STRING, note STRING")
COMPLEXITY = StructType.fromDDL("nodeId STRING, cyclomatic INT, loc INT, fanIn INT, fanOut INT, score INT")
_FILE = "STRUCT<path: STRING, oldPath: STRING, additions: INT, deletions: INT, generated: BOOLEAN, rename: BOOLEAN, excluded: BOOLEAN>"
CHANGE_EVENT = StructType.fromDDL(f"id STRING, commit STRING, occurredAt TIMESTAMP, authorKey STRING, parents ARRAY<STRING>, files ARRAY<{_FILE}>, refactorNoise BOOLEAN")
SNAPSHOT = StructType.fromDDL("repository_id STRING, snapshot_id BIGINT, kind STRING, commit STRING, branch STRING, created_at STRING, fingerprint STRING")

# Closed domains.
NODE_KINDS = "service package function method endpoint transaction external contract table topic cache test database broker".split()
EDGE_KINDS = "calls writes publishes consumes reads retries tests depends_on transforms owns implements".split()
STRENGTHS = ["proven", "observed", "inferred"]
COMPATIBILITY = ["safe", "conditional", "potential", "break"]
