"""Ordered folds over events: stream deltas, limiter windows, breakers, document states, runs of failures.

A ``Fold`` takes the rows of a key in order, each with the state before it, and gives a row and
the state after it.  ``fold_rows`` runs one over a table, ``FoldProcessor`` over a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lodestone.constants import BREAKER_FAILURES, BREAKER_SECONDS, LEASE_MINUTES, LIMITER_COUNT, LIMITER_MINUTES

SECOND = 1_000_000  # times are microseconds


def merge_tool_calls(deltas: DataFrame) -> DataFrame:
    """``turn, seq, index, id, name, args`` to one call per slot up to the greatest index.

    A null index is 0; id and name take the last value that is not empty; args are joined in
    order of seq; slots without deltas are empty.
    """
    own = deltas.withColumn("index", F.coalesce("index", F.lit(0)))
    last = lambda c: F.max_by(F.col(c), F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.col("seq")))
    calls = own.groupBy("turn", "index").agg(last("id").alias("id"), last("name").alias("name"), F.array_sort(F.collect_list(F.struct("seq", "args"))).alias("parts"))
    calls = calls.select("turn", "index", "id", "name", F.array_join(F.transform("parts", lambda p: F.coalesce(p["args"], F.lit(""))), "").alias("args"))
    slots = own.groupBy("turn").agg(F.max("index").alias("top")).select("turn", F.explode(F.sequence(F.lit(0), F.col("top").cast("int"))).alias("index"))
    empty = F.lit("")
    return slots.join(calls, ["turn", "index"], "left").select("turn", F.col("index").cast("int").alias("index"), *(F.coalesce(F.when(F.col(c) != "", F.col(c)), empty).alias(c) for c in ("id", "name", "args")))


def drain(events: DataFrame) -> DataFrame:
    """``turn, seq, kind ('delta', 'final', 'error'), text`` to each turn's text and status; the final text, where there is one, counts."""
    parts = F.array_sort(F.collect_list(F.when(F.col("kind") == "delta", F.struct("seq", "text"))))
    own = events.groupBy("turn").agg(parts.alias("parts"), F.max_by("text", F.when(F.col("kind") == "final", F.col("seq"))).alias("final"), F.max((F.col("kind") == "final").cast("int")).alias("has_final"), F.max((F.col("kind") == "error").cast("int")).alias("error"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    done = (F.col("has_final") == 1) & (F.col("error") == 0)
    return own.select("turn", F.when(F.col("has_final") == 1, F.col("final")).otherwise(text).alias("text"), F.when(done, "ok").otherwise("failed").alias("status"))


class Fold:
    """State and step of a fold; rows are tuples of ``takes``, states of ``state``, results of ``gives``."""

    takes: list[str] = []
    state: str = ""
    gives: str = ""

    def start(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, row: tuple) -> tuple[tuple, tuple]:
        raise NotImplementedError


class FixedWindow(Fold):
    """Hits in windows that start at their first hit; allowed up to the limit."""

    takes, state, gives = ["at"], "start long, count long", "allowed boolean"

    def __init__(self, minutes: int = LIMITER_MINUTES, limit: int = LIMITER_COUNT) -> None:
        self.length, self.limit = minutes * 60 * SECOND, limit

    def start(self) -> tuple:
        return None, 0

    def step(self, state: tuple, row: tuple) -> tuple[tuple, tuple]:
        (start, count), (at,) = state, row
        if start is None or at >= start + self.length:
            start, count = at, 0
        return (start, count + 1), (count + 1 <= self.limit,)


class Breaker(Fold):
    """Closed until ``failures`` fail in a row; then open for ``seconds``, in which calls are turned away; the next call is a trial that closes it or opens it again."""

    takes, state, gives = ["at", "failed"], "status string, failures long, opened long", "status string, allowed boolean, failures long"

    def __init__(self, failures: int = BREAKER_FAILURES, seconds: int = BREAKER_SECONDS) -> None:
        self.most, self.length = failures, seconds * SECOND

    def start(self) -> tuple:
        return "closed", 0, None

    def step(self, state: tuple, row: tuple) -> tuple[tuple, tuple]:
        (status, failures, opened), (at, failed) = state, row
        if status == "open" and at <= opened + self.length:
            return state, ("open", False, failures)
        trial, failures = status == "open", failures + 1 if failed else 0
        if failed and (trial or failures >= self.most):
            return ("open", failures, at), ("half-open" if trial else "closed", True, failures)
        return ("closed", failures, None), ("half-open" if trial else "closed", True, failures)


class DocumentStates(Fold):
    """A document's compare-and-swap updates in order.

    An update applies only to the version it names (null: the present one) in the states it is
    for; ``reclaim`` and ``recover`` also need a lease that ran out before their own time.
    ``retry`` and ``reclaim`` start over with the next version; ``renew_…``, ``recover`` and those
    that begin work give a new lease.
    """

    takes, state, gives = ["at", "event", "version"], "status string, version long, lease long", "applied boolean, status string, version long, lease long"
    #: event: (states it applies to, state after it)
    UPDATES = {
        "claim": (("pending", "failed"), "processing"),
        "renew_processing": (("processing",), "processing"),
        "publishing": (("processing",), "publishing"),
        "renew_publishing": (("publishing",), "publishing"),
        "ready": (("publishing",), "ready"),
        "fail": (("processing",), "failed"),
        "retry": (("pending", "failed"), "pending"),
        "reclaim": (("processing",), "pending"),
        "recover": (("publishing",), "publishing"),
    }

    def __init__(self, minutes: int = LEASE_MINUTES) -> None:
        self.length = minutes * 60 * SECOND

    def start(self) -> tuple:
        return "pending", 1, None

    def step(self, state: tuple, row: tuple) -> tuple[tuple, tuple]:
        (status, version, lease), (at, event, asked) = state, row
        states, target = self.UPDATES.get(event, ((), None))
        fits = status in states and asked in (None, version)
        if event in ("reclaim", "recover"):
            fits = fits and lease is not None and lease < at
        if fits:
            status, version = target, version + (event in ("retry", "reclaim"))
            lease = at + self.length if target in ("processing", "publishing") else None
        return (status, version, lease), (fits, status, version, lease)


def fold_rows(events: DataFrame, key: str, order: list[str], fold: Fold) -> DataFrame:
    """``key``, ``order`` and what the fold gives, for each row; rows of one key go through in order.

    Rows are sorted within partitions of keys and stream through, so a key of any size takes
    bounded memory.  Columns: key, order and ``fold.takes``.
    """
    own = events.select(key, *order, *(c for c in fold.takes if c not in order)).repartition(key).sortWithinPartitions(key, *order)
    names = own.columns
    gives = [f.split()[0] for f in fold.gives.split(", ")]
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields if f.name in (key, *order) and f.name not in gives)
    kept_names = [f.split()[0] for f in kept.split(", ")]
    schema = f"{kept}, {fold.gives}"
    kinds = {"boolean": pa.bool_(), "string": pa.string(), "long": pa.int64()}
    types = [kinds[f.split()[1]] for f in fold.gives.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            out = []
            columns = {n: batch.column(n).to_pylist() for n in {key, *fold.takes}}
            for k, *row in zip(columns[key], *(columns[c] for c in fold.takes), strict=True):
                if k != last:
                    last, state = k, fold.start()
                state, given = fold.step(state, tuple(row))
                out.append(given)
            given = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept_names), *(pa.array(g, t) for g, t in zip(given, types, strict=True))], [*kept_names, *gives])

    assert set(kept_names) <= set(names)
    return own.mapInArrow(run, schema)


class FoldProcessor(StatefulProcessor):
    """A fold over a stream, for ``transformWithStateInPandas``: rows of a batch are sorted by ``order``, the state is kept by key.

    Results are the key, ``id`` of the row and what the fold gives; columns: key, id, ``order``
    and ``fold.takes``.
    """

    def __init__(self, fold: Fold, id: str, order: list[str]) -> None:
        self.fold, self.id, self.order = fold, id, order

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("state", self.fold.state)

    def state(self) -> tuple:
        return tuple(self.value.get()) if self.value.exists() else self.fold.start()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order)
        state, out = self.state(), []
        columns = ([None if pd.isna(x) else x for x in batch[c].tolist()] for c in self.fold.takes)
        for row in zip(*columns, strict=True):
            state, given = self.fold.step(state, row)
            out.append(given)
        self.value.update(state)
        self.moved(state)
        yield self.frame(key, batch[self.id].to_numpy(), out)

    def frame(self, key, ids, out: list[tuple]) -> pd.DataFrame:
        kinds = dict(f.split() for f in self.fold.gives.split(", "))
        frame = pd.DataFrame(out, columns=list(kinds)).astype({n: "Int64" for n, k in kinds.items() if k == "long"})
        frame.insert(0, "key", key[0])
        frame.insert(1, "id", ids)
        return frame

    def moved(self, state: tuple) -> None:
        """Called with the state after a batch."""

    def close(self) -> None:
        pass


class LeaseProcessor(FoldProcessor):
    """Document states whose leases run out by the stream's own time: work is taken back, publishing is recovered, without any event."""

    def moved(self, state: tuple) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state[2] is not None:
            self.handle.registerTimer(state[2] // 1000 + 1)  # milliseconds

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        state, outs = self.state(), []
        for event in ("reclaim", "recover"):
            new, given = self.fold.step(state, (at, event, None))
            if given[0]:
                state = new
                outs.append(given)
                break
        self.value.update(state)
        if state[2] is not None:
            self.handle.registerTimer(state[2] // 1000 + 1)
        if outs:
            yield self.frame(key, -1, outs)


def fold_stream(events: DataFrame, key: str, processor: FoldProcessor, mode: str = "none") -> DataFrame:
    """The processor over a stream: ``key, id`` and what its fold gives.  ``mode`` "eventTime" lets timers run by the watermark."""
    kinds = dict(events.dtypes)
    return events.groupBy(key).transformWithStateInPandas(processor, f"key {kinds[key]}, id {kinds[processor.id]}, {processor.fold.gives}", "append", mode)


def micros(at: Column | str) -> Column:
    """Microseconds of a time, with or without a zone (that of the session)."""
    return F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))


def rate_limit(events: DataFrame, minutes: int = LIMITER_MINUTES, limit: int = LIMITER_COUNT) -> DataFrame:
    """``user_id, event_id, ts`` to ``user_id, event_id, allowed``; rows without user or time are left out."""
    own = events.where("user_id is not null and ts is not null").select("user_id", micros("ts").alias("at"), "event_id")
    return fold_rows(own, "user_id", ["at", "event_id"], FixedWindow(minutes, limit)).select("user_id", "event_id", "allowed")


class Runs(Fold):
    """First and length so far of the run of failures that a row is in; null and 0 outside."""

    takes, state, gives = ["seq", "failed"], "first long, n long", "first long, n long"

    def start(self) -> tuple:
        return None, 0

    def step(self, state: tuple, row: tuple) -> tuple[tuple, tuple]:
        (first, n), (seq, failed) = state, row
        state = (seq if first is None else first, n + 1) if failed else (None, 0)
        return state, state


def failure_runs(calls: DataFrame, least: int = BREAKER_FAILURES) -> DataFrame:
    """``key, seq, failed`` to maximal runs of at least ``least`` failures in a row: first, last and length.  A null ``failed`` ends a run."""
    runs = fold_rows(calls.select("key", F.col("seq").cast("long").alias("seq"), "failed"), "key", ["seq"], Runs()).where("n > 0")
    longest = runs.groupBy("key", F.col("first").alias("first_seq")).agg(F.max("seq").alias("last_seq"), F.max("n").alias("failures"))
    return longest.where(F.col("failures") >= least)
