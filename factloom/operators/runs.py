"""Runs of the stages: a recorder that leaves a row also when the stage fails, and what is read from its rows."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.search import active_facts
from factloom.operators.funnel import latest_facts
from factloom.operators.stats import json_sum

RUN_SCHEMA = (
    "run_id string, doc_id string, stage string, started_at timestamp_ntz, finished_at timestamp_ntz, n_items int, n_calls int, tokens_in int, tokens_out int, errors string, notes string"
)
MOST_DETAIL = 600


@dataclass
class RunRecorder:
    """Context manager: appends one row of RUN_SCHEMA at ``path`` when the stage ends; exceptions are noted and raised on."""

    spark: SparkSession
    path: str
    stage: str
    doc_id: str | None = None
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex[:16])
    n_items: int = 0
    n_calls: int = 0
    n_hits: int = 0
    tokens_in: int = 0
    tokens_out: int = 0
    errors: list[dict[str, Any]] = field(default_factory=list)
    notes: dict[str, Any] = field(default_factory=dict)

    def fail(self, kind: str, detail: object) -> None:
        self.errors.append({"kind": kind, "detail": str(detail)[:MOST_DETAIL]})

    def called(self, cached: bool, tokens_in: int = 0, tokens_out: int = 0) -> None:
        self.n_hits, self.n_calls = self.n_hits + cached, self.n_calls + (not cached)
        self.tokens_in, self.tokens_out = self.tokens_in + tokens_in, self.tokens_out + tokens_out

    def __enter__(self) -> RunRecorder:
        self._at, self._start = datetime.now(timezone.utc).replace(tzinfo=None), time.perf_counter()
        return self

    def __exit__(self, kind, error, trace) -> bool:
        if error is not None:
            self.fail("exception", f"{kind.__name__}: {error}")
        notes = {"seconds": round(time.perf_counter() - self._start, 3), "cache_hits": self.n_hits} | self.notes
        row = (self.run_id, self.doc_id, self.stage, self._at, datetime.now(timezone.utc).replace(tzinfo=None), self.n_items, self.n_calls, self.tokens_in, self.tokens_out, json.dumps(self.errors, default=str), json.dumps(notes, default=str))
        self.spark.createDataFrame([row], RUN_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return False


def document_runs(runs: DataFrame, doc_id) -> DataFrame:
    """One document's runs in their order, errors and notes decoded (what is no JSON counts as none)."""
    return (
        runs.filter(F.col("doc_id") == doc_id)
        .withColumns({
            "errors": F.coalesce(F.from_json("errors", "array<map<string,string>>"), F.array().cast("array<map<string,string>>")),
            "notes": F.coalesce(F.from_json("notes", "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))),
        })
        .orderBy("started_at", "run_id")
    )


def recent_runs(runs: DataFrame, documents: DataFrame, limit: int = 60) -> DataFrame:
    """The last runs with their document's file name, if it is known."""
    last = runs.orderBy(F.desc("started_at"), "run_id").limit(limit)
    return last.join(documents.select("doc_id", "filename"), "doc_id", "left").orderBy(F.desc("started_at"), "run_id")


def run_totals(runs: DataFrame) -> DataFrame:
    """One row: calls, cache hits and tokens of all runs; 0 without any."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return runs.agg(n("n_calls"), json_sum("notes", "$.cache_hits").alias("cache_hits"), n("tokens_in"), n("tokens_out"))


def document_status(documents: DataFrame, runs: DataFrame, facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each document's status, facts, verified facts, runs, stages and errors: each side is grouped before it is joined."""
    per_run = runs.groupBy("doc_id").agg(
        F.count("*").alias("n_runs"), F.count_distinct("stage").alias("n_stages"), F.sum(F.coalesce(F.json_array_length("errors"), F.lit(0))).cast("bigint").alias("n_errors"), F.sum("n_items").cast("bigint").alias("n_items")
    )
    n_facts = latest_facts(facts).groupBy("doc_id").agg(F.count("*").alias("n_facts"))
    n_ok = active_facts(facts, evidence).groupBy("doc_id").agg(F.count("*").alias("n_verified"))
    rows = documents.select("doc_id", "status")
    for part in (n_facts, n_ok, per_run):
        rows = rows.join(part, "doc_id", "left")
    return rows.select("doc_id", "status", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_facts", "n_verified", "n_runs", "n_stages", "n_errors", "n_items")])
