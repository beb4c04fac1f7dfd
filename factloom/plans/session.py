"""The engine's front: sources, ingest, queries under policy, audit, resolution."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.fixtures import FACT_SCHEMA
from factloom.functions import columns as C
from factloom.functions.scalars import store_time
from factloom.operators import resolution, spatial, store
from factloom.plans import compiler, planner
from factloom.plans.compiler import Binding, PlanError
from factloom.plans.language import Problem, Query, parse
from factloom.plans.policy import Decision, Policy, Request
from factloom.runtime import cut_lineage

AUDIT_ATTRS = ("audit_query", "audit_purpose", "audit_rule", "audit_allowed", "audit_rows")
AUDIT_SOURCE = 65_535
#: Audit entities have a range of ids of their own, so that later data can't meet them.
AUDIT_BASE = 1 << 40
MAX_POINTS = 262_144
MERGE_PARTS = 16
TXN_SCHEMA = "txn_id long, wall_clock_unix long, fact_count long, first_fact long"


@dataclass
class Result:
    """A query's outcome: rows, or an error with its span, or a refusal with its rule."""

    rows: DataFrame | None = None
    error: Problem | None = None
    decision: Decision | None = None
    plan: planner.Plan | None = None
    truncated: bool = False

    @property
    def ok(self) -> bool:
        return self.rows is not None


class Session:
    """Stored facts and transactions, with the session's own additions beside them.

    Additions are small tables that are unioned to the stored facts; they are merged once
    there are ``MERGE_PARTS`` of them. Neither a query nor its audit entry rewrites or rescans
    what is stored: the zone map and the catalogue are read once and then added to.
    """

    def __init__(self, spark: SparkSession, facts: DataFrame | None = None, txns: DataFrame | None = None):
        self.spark = spark
        self.stored = facts if facts is not None else spark.createDataFrame([], FACT_SCHEMA)
        self.txns = (txns if txns is not None else spark.createDataFrame([], TXN_SCHEMA)).select("txn_id", "wall_clock_unix", "fact_count", "first_fact")
        self.parts: list[DataFrame] = []
        self.closed: DataFrame | None = None
        self.policy = Policy()
        self.bindings: dict[str, Binding] = {}
        self.chunks = cut_lineage(store.chunk_stats(self.stored))
        self.cells = cut_lineage(store.key_cells(self.stored))
        self.known = frozenset(r[0] for r in store.attributes(self.stored).collect())
        last = self.txns.agg(F.coalesce(F.max("txn_id"), F.lit(0)).alias("t"), F.max("wall_clock_unix").alias("w")).first()
        self.current_txn, self.last_wall = last["t"], last["w"]
        self.next_fact = self.stored.agg(F.coalesce(F.max("fact_id") + 1, F.lit(0))).first()[0]

    @property
    def facts(self) -> DataFrame:
        rows = self.stored
        for part in self.parts:
            rows = rows.unionByName(part)
        return rows if self.closed is None else store.apply_retractions(rows, self.closed)

    def _add(self, rows: DataFrame, txn: int, wall: int, count: int) -> None:
        """Append the rows of a new transaction."""
        if count:
            part = cut_lineage(rows)
            self.parts.append(part)
            if len(self.parts) >= MERGE_PARTS:
                merged = self.parts[0]
                for other in self.parts[1:]:
                    merged = merged.unionByName(other)
                self.parts = [cut_lineage(merged.coalesce(1) if count < 10_000 else merged)]
            both = self.chunks.unionByName(store.chunk_stats(part)).groupBy("chunk")
            bounds = [F.min("min_valid_from"), F.max("max_valid_to"), F.min("min_sys_from"), F.max("max_sys_to"), F.sum("rows")]
            names = ["min_valid_from", "max_valid_to", "min_sys_from", "max_sys_to", "rows"]
            self.chunks = cut_lineage(both.agg(*[b.alias(n) for b, n in zip(bounds, names, strict=True)]))
            cells = self.cells.unionByName(store.key_cells(part)).groupBy("attr", "cell").agg(F.sum("rows").alias("rows"))
            self.cells = cut_lineage(cells)
            self.known |= {r[0] for r in store.attributes(part).collect()}
        added = self.spark.createDataFrame([(txn, wall, count, self.next_fact)], TXN_SCHEMA)
        self.txns = cut_lineage(self.txns.unionByName(added))
        self.current_txn, self.last_wall, self.next_fact = txn, wall, self.next_fact + count

    def register_source(self, names: str | tuple[str, ...], geo_attr: str, scalar_attr: str) -> None:
        """Bind one or more names to a layer; a later binding of a name replaces the earlier."""
        for name in (names,) if isinstance(names, str) else names:
            self.bindings[name] = Binding(geo_attr, scalar_attr)

    def ingest(self, staged: DataFrame, wall_clock: int) -> tuple[int, int]:
        """Commit staged rows ``(entity, attr, kind, v_*, valid_from, valid_to, source)`` as one transaction.

        Returns (accepted, rejected). No rows commit nothing; rows that are all rejected
        still open an empty transaction. The wall clock never runs backwards.
        """
        counts = store.ingest_counts(staged).first()
        if not sum(counts):
            return 0, 0
        wall = max(wall_clock, self.last_wall) if self.last_wall is not None else wall_clock
        txn = self.current_txn + 1
        fine = staged.where(store.accepted(staged))
        numbered = store.numbered(fine)
        rows = store.as_facts(numbered, F.lit(txn), F.col("place") + self.next_fact)
        self._add(rows, txn, wall, counts["accepted"])
        return counts["accepted"], counts["rejected"]

    def retract(self, fact_ids: list[int], wall_clock: int) -> None:
        """Close facts in a transaction of their own; unknown and closed ones stay as they are."""
        txn = self.current_txn + 1
        closed = self.spark.createDataFrame([(i, txn) for i in fact_ids], "fact_id long, txn_id long")
        self.closed = cut_lineage(closed if self.closed is None else self.closed.unionByName(closed))
        self._add(self.stored, txn, max(wall_clock, self.last_wall or wall_clock), 0)

    def run_query(self, text: str, now: int, override: tuple[int, int] | None = None, record: bool = True, execute: bool = True, places: dict[str, tuple[float, float]] | None = None) -> Result:
        """Parse, plan, ask the policy, and only then build and run the query."""
        parsed = parse(text)
        if parsed.error:
            return Result(error=parsed.error)
        query = parsed.query
        binding = self.bindings.get(query.source)
        if binding is None:
            known = ", ".join(sorted(self.bindings)) or "none at all"
            return Result(error=Problem(f"no source is bound to `{query.source}`; bound are {known}", *query.source_span))
        place = (places or {}).get(":".join(query.within.place)) if query.within and query.within.place else None
        try:
            if query.within and query.within.place and place is None:
                raise PlanError(f"no gazetteer entry resolves the place {':'.join(query.within.place)}")
            valid_at, sys_at = planner.resolve_times(query, self.txns, self.current_txn, now, override)
            plan = planner.plan(query, binding, self.cells, self.chunks, self.known, valid_at, sys_at, place)
        except PlanError as problem:
            return Result(error=Problem(str(problem), 0, len(text.encode())))
        decision = self.policy.check(self._request(query, binding, plan))
        if not decision.allowed:
            self.record_audit(text, decision, 0, now)
            return Result(decision=decision, plan=plan)
        rows = compiler.points(compiler.entities(self.facts, query, binding, valid_at, sys_at, now, place, plan.by_space), query)
        # whether rows were cut is known once they have been counted
        result = Result(rows=rows.limit(MAX_POINTS) if execute else rows, decision=decision, plan=plan)
        if execute:
            self._run(result, rows)
        if record:
            self.record_audit(text, decision, plan.emitted_rows, now)
        return result

    def _run(self, result: Result, rows: DataFrame) -> None:
        began = time.perf_counter()
        kept = cut_lineage(rows.limit(MAX_POINTS + 1))
        found = kept.count()
        result.truncated = found > MAX_POINTS
        result.rows = kept.limit(MAX_POINTS)
        result.plan.emitted_rows = min(found, MAX_POINTS)
        top = result.plan.root
        top.actual_rows, top.actual_us = result.plan.emitted_rows, (time.perf_counter() - began) * 1e6

    def _request(self, query: Query, binding: Binding, plan: planner.Plan) -> Request:
        by_identity = any(c.op == "=" and c.field in self.policy.identifying for c in query.comparisons())
        return Request(binding.geo_attr, plan.root.est_rows, by_identity, query.within.metres if query.within else 0.0)

    def record_audit(self, text: str, decision: Decision, rows: int, now: int) -> None:
        """Five facts of an audit entity in a transaction of their own."""
        txn, wall = self.current_txn + 1, max(now, self.last_wall or now)
        entity, at = AUDIT_BASE + txn, store_time(now)
        values = (text, self.policy.purpose.replace("-", " "), decision.rule, decision.allowed, rows)
        staged = [
            (entity, attr, C.SYM if isinstance(v, str) else C.BOOL if isinstance(v, bool) else C.I64,
             v if isinstance(v, bool) else None, v if type(v) is int else None, v if isinstance(v, str) else None, at, C.OPEN_VALID, AUDIT_SOURCE, i)
            for i, (attr, v) in enumerate(zip(AUDIT_ATTRS, values, strict=True))
        ]
        schema = "entity long, attr string, kind int, v_bool boolean, v_i64 long, v_str string, valid_from int, valid_to int, source int, place long"
        facts = store.as_facts(self.spark.createDataFrame(staged, schema), F.lit(txn), F.col("place") + self.next_fact)
        self._add(facts, txn, wall, len(staged))

    def audit(self, limit: int = 50) -> DataFrame:
        return audit_log(self.facts).limit(limit)

    def query_points(self, valid_at: int, sys_at: int, geo_attr: str, scalar_attr: str) -> DataFrame:
        return spatial.query_points(self.facts, valid_at, sys_at, geo_attr, scalar_attr)

    def layers(self, valid_at: int, sys_at: int) -> dict[str, float]:
        """Points, rows scanned, chunks skipped and in all, and milliseconds, summed over a query of each layer."""
        out = {"points": 0, "rows_scanned": 0, "chunks_skipped": 0, "chunks_total": 0, "query_ms": 0.0}
        told = store.prune_counts(self.chunks, valid_at, sys_at).first()
        for binding in dict.fromkeys(self.bindings.values()):
            began = time.perf_counter()
            out["points"] += self.query_points(valid_at, sys_at, binding.geo_attr, binding.scalar_attr).count()
            out["query_ms"] += (time.perf_counter() - began) * 1000
            out["rows_scanned"] += told["rows_kept"]
            out["chunks_skipped"] += told["chunks_skipped"]
            out["chunks_total"] += told["chunks_total"]
        return out

    def inspect(self, lat: float, lon: float, metres: float, valid_at: int, sys_at: int, geo_attrs: tuple[str, ...] = ()) -> DataFrame:
        return spatial.inspect(self.facts, lat, lon, metres, valid_at, sys_at, geo_attrs)

    def resolve_entities(self, geo_attr: str, scalar_attr: str, config: resolution.Config = resolution.Config()) -> tuple[DataFrame, DataFrame]:
        """(scored pairs, clusters) of the layer's records."""
        recs = cut_lineage(resolution.records(self.facts, geo_attr, scalar_attr))
        scored = cut_lineage(resolution.score(resolution.candidate_pairs(recs, config), recs, config))
        return scored, resolution.clusters(recs, scored.where("accepted"))


def audit_log(facts: DataFrame) -> DataFrame:
    """Audit entries, newest first: the five facts of each as one row."""
    rows = facts.where(F.col("attr").isin(*AUDIT_ATTRS))
    pick = lambda attr, column: F.max(F.when(F.col("attr") == attr, F.col(column)))
    return (
        rows.groupBy("entity")
        .agg(
            F.min("fact_id").alias("fact_id"),
            pick("audit_query", "v_str").alias("query"),
            pick("audit_purpose", "v_str").alias("purpose"),
            pick("audit_rule", "v_str").alias("rule"),
            pick("audit_allowed", "v_bool").alias("allowed"),
            pick("audit_rows", "v_i64").alias("rows"),
            F.min("valid_from").alias("at"),
        )
        .orderBy(F.desc("fact_id"))
    )
