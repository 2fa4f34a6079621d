"""Provider selection as a stateful stream keyed by site.

The state of a site (selection, last scores, cycles still waiting for a
provider) lives in RocksDB and survives lost executors through the checkpoint. A task's
memory does not grow with the micro-batch, in whatever order its rows come.
Still, micro-batches should stay small (``maxFilesPerTrigger``): long histories
belong to the batch fold, which splits a site over many tasks and whose
:func:`pathmeter.operators.failover.final_states` can start this stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pathmeter import params as P
from pathmeter.functions import times
from pathmeter.functions.steps import initial_state, mean_in_order, pack_cycle, penalty_score, step
from pathmeter.operators import failover
from pathmeter.params import FailoverParams

_FIGURES = ["score", *P.METRICS, "switch_margin"]

SELECTION = T.StructType(
    [
        T.StructField("current", T.IntegerType()),
        T.StructField("candidate", T.IntegerType()),
        T.StructField("count", T.LongType()),
        T.StructField("before_last", T.IntegerType()),
        T.StructField("next_cycle", T.LongType()),
        T.StructField("history", T.ArrayType(T.DoubleType())),
        # The time of the one timer that is set; -1: none.
        T.StructField("alarm", T.LongType()),
    ]
)
# Waiting cycles by span: how many parts hold its rows, and a time none of its cycles was complete before.
SPAN_KEY = T.StructType([T.StructField("span", T.LongType())])
SPAN_INFO = T.StructType([T.StructField("parts", T.IntegerType()), T.StructField("first_ts", T.LongType())])
PART_KEY = T.StructType([T.StructField("span", T.LongType()), T.StructField("part", T.IntegerType())])
PART = T.StructType([T.StructField("rows", T.BinaryType())])
ROW = np.dtype([("cycle", "<i8"), ("order", "<i4"), ("ts", "<i8"), ("figures", "<f8", (len(_FIGURES),))])

# Cycles of one span, rows of later spans held before they go to the state
# store, parts of a span before they are made one, decisions in one frame.
SPAN = 256
HELD = 1 << 16
PARTS = 64
FRAME = 4096


def output_schema(n: int) -> T.StructType:
    """Decision of a cycle and the figures of every provider."""
    return T.StructType(
        [
            T.StructField("site_id", T.LongType()),
            T.StructField("cycle", T.LongType()),
            T.StructField("ts_micros", T.LongType()),
            T.StructField("current", T.IntegerType()),
            T.StructField("reason", T.StringType()),
            T.StructField("counter", T.LongType()),
            T.StructField("new", T.IntegerType()),
            T.StructField("previous", T.IntegerType()),
            T.StructField("after_candidate", T.IntegerType()),
            # Only in rows that came too late: the provider, and how many cycles the site was past the row's.
            T.StructField("late_provider", T.IntegerType()),
            T.StructField("late_by", T.LongType()),
        ]
        + [
            T.StructField(f"{name}_{i}", T.DoubleType())
            for i in range(n)
            for name in ("smoothed", *P.METRICS)
        ]
    )


class _Waiting:
    """The cycles of one site that cannot be taken yet.

    Only the span of the next cycle is open, with an entry per cycle. Rows of
    later spans are kept as they came, at most ``HELD`` of them here and the
    rest in the state store, so memory depends neither on how many cycles wait
    nor on the order of the rows.
    """

    def __init__(self, spans, parts, n: int, next_cycle: int):
        self.spans, self.parts, self.n = spans, parts, n
        self.index = {span: tuple(info) for (span,), info in list(spans.iterator())}
        self.stored = dict(self.index)
        self.held: dict[int, list[np.ndarray]] = {}
        self.n_held = 0
        self._open(next_cycle // SPAN)

    def add(self, rows: np.ndarray) -> None:
        """Rows of cycles not yet taken; of a cycle and provider the last one holds."""
        spans = rows["cycle"] // SPAN
        here = spans == self.span
        if here.any():
            self._merge(self.entries, rows[here])
            self.touched = True
        rest, spans = rows[~here], spans[~here]
        if len(rest):
            order = np.argsort(spans, kind="stable")
            cuts = np.flatnonzero(np.diff(spans[order])) + 1
            for part in np.split(rest[order], cuts):
                self.held.setdefault(int(part["cycle"][0]) // SPAN, []).append(part.copy())
            self.n_held += len(rest)
            if self.n_held > HELD:
                self._put_held()

    def pop(self, cycle: int) -> list:
        self.touched = True
        return self.entries.pop(cycle)

    def go_to(self, span: int) -> None:
        """Open another span; the one left must be taken whole."""
        if span != self.span:
            self._forget(self.span)
            self._open(span)

    def spans_up_to(self, last: int) -> list[int]:
        return sorted(span for span in {*self.index, self.span} if span <= last)

    def last_overdue(self, ts: int) -> int | None:
        """The last cycle whose newest row is not after ``ts``; on the way the times of the spans become exact."""
        for span in sorted((s for s, (_, first) in self.index.items() if first <= ts), reverse=True):
            entries = self._entries(span)
            overdue = [cycle for cycle, (at, _) in entries.items() if at <= ts]
            if overdue:
                # Later cycles of this span stay, and may be due only after that.
                return max(overdue)
            self.index[span] = (self.index[span][0], min(at for at, _ in entries.values()))
        return None

    def first_ts(self) -> int | None:
        return min((first for _, first in self.index.values()), default=None)

    def store(self) -> None:
        self._put_held()
        if self.touched:
            self._put_whole(self.span, self.entries)
        for span in self.stored.keys() - self.index.keys():
            self.spans.removeKey((span,))
        for span, info in self.index.items():
            if self.stored.get(span) != info:
                self.spans.updateValue((span,), info)

    def _open(self, span: int) -> None:
        self.span = span
        self.entries = self._entries(span)
        held = self.held.pop(span, [])
        for rows in held:
            self._merge(self.entries, rows)
            self.n_held -= len(rows)
        self.touched = bool(held)

    def _entries(self, span: int) -> dict[int, list]:
        out: dict[int, list] = {}
        for part in range(self.index.get(span, (0, 0))[0]):
            self._merge(out, np.frombuffer(self.parts.getValue((span, part))[0], ROW))
        return out

    def _merge(self, entries: dict[int, list], rows: np.ndarray) -> None:
        width = len(_FIGURES)
        for cycle, order, ts, figures in zip(*[rows[name].tolist() for name in ROW.names]):
            entry = entries.setdefault(cycle, [ts, [None] * (self.n * width)])
            entry[0] = max(entry[0], ts)
            entry[1][order * width : (order + 1) * width] = figures

    def _put_held(self) -> None:
        for span, arrays in self.held.items():
            rows = np.concatenate(arrays)
            count, first = self.index.get(span, (0, int(rows["ts"].min())))
            if count >= PARTS:
                entries = self._entries(span)
                self._merge(entries, rows)
                self._put_whole(span, entries)
                continue
            self.parts.updateValue((span, count), (rows.tobytes(),))
            self.index[span] = (count + 1, min(first, int(rows["ts"].min())))
        self.held.clear()
        self.n_held = 0

    def _put_whole(self, span: int, entries: dict[int, list]) -> None:
        self._forget(span)
        if entries:
            width = len(_FIGURES)
            rows = [
                (cycle, order, ts, figures[order * width : (order + 1) * width])
                for cycle, (ts, figures) in entries.items()
                for order in range(self.n)
                if figures[order * width] is not None
            ]
            self.parts.updateValue((span, 0), (np.array(rows, ROW).tobytes(),))
            self.index[span] = (1, min(ts for ts, _ in entries.values()))

    def _forget(self, span: int) -> None:
        for part in range(self.index.pop(span, (0, 0))[0]):
            self.parts.removeKey((span, part))


class SelectionProcessor(StatefulProcessor):
    """Steps one site through its cycles in order.

    Rows come in any order. A cycle is taken once all its providers are there;
    when the watermark passes its time plus ``grace``, missing ones count as
    failed. Rows of cycles already taken come out as they are, tagged as late,
    and change nothing.
    """

    def __init__(self, n: int, params: FailoverParams, grace_seconds: int, first_cycle: int = 0):
        self.n = n
        self.params = params
        self.grace_ms = grace_seconds * 1000
        self.first_cycle = first_cycle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.selection = handle.getValueState("selection", SELECTION)
        self.spans = handle.getMapState("spans", SPAN_KEY, SPAN_INFO)
        self.parts = handle.getMapState("parts", PART_KEY, PART)

    def close(self) -> None:
        pass

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.selection.update(
            (
                int(row["current"]),
                int(row["candidate"]),
                int(row["count"]),
                int(row["before_last"]),
                int(row["cycle"]) + 1,
                [float(x) for x in row["history"]],
                -1,
            )
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self._load()
        waiting = _Waiting(self.spans, self.parts, self.n, state["next_cycle"])
        # Complete cycles are taken after every Arrow batch, so rows that arrive
        # roughly in order never pile up.
        for pdf in rows:
            yield self._frame(self._add(key[0], pdf, waiting, state["next_cycle"]))
            yield from self._frames(self._drain(key[0], waiting, state))
        self._keep(waiting, state)

    def _add(self, site_id: int, pdf: pd.DataFrame, waiting: _Waiting, next_cycle: int) -> list[dict]:
        """Put the rows to their waiting cycles; those of cycles already taken are returned."""
        rows = np.empty(len(pdf), ROW)
        for name, column in (("cycle", "cycle"), ("order", "provider_ord"), ("ts", "ts_micros")):
            rows[name] = pdf[column].astype("int64")
        rows["figures"] = pdf[_FIGURES].to_numpy()
        late = rows["cycle"] < next_cycle
        waiting.add(rows[~late])
        return [
            {"site_id": site_id, "cycle": cycle, "ts_micros": ts, "late_provider": order, "late_by": next_cycle - cycle}
            for cycle, order, ts in zip(*[rows[late][name].tolist() for name in ("cycle", "order", "ts")])
        ]

    def _drain(self, site_id: int, waiting: _Waiting, state: dict) -> Iterator[dict]:
        """Take the cycles that are complete, up to the first that is not."""
        waiting.go_to(state["next_cycle"] // SPAN)
        while (entry := waiting.entries.get(state["next_cycle"])) and None not in entry[1]:
            yield self._take(site_id, state["next_cycle"], waiting.pop(state["next_cycle"]), state)
            state["next_cycle"] += 1
            waiting.go_to(state["next_cycle"] // SPAN)

    def _take_up_to(self, site_id: int, last: int, waiting: _Waiting, state: dict) -> Iterator[dict]:
        """Take the waiting cycles up to ``last``, whatever they lack."""
        for span in waiting.spans_up_to(last // SPAN):
            waiting.go_to(span)
            for cycle in sorted(c for c in waiting.entries if c <= last):
                yield self._take(site_id, cycle, waiting.pop(cycle), state)
                state["next_cycle"] = cycle + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # The timer may go off early, as spans only know a time before which nothing is due.
        due = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        state = self._load()
        waiting = _Waiting(self.spans, self.parts, self.n, state["next_cycle"])
        # A cycle is due by the millisecond its last row falls into.
        last = waiting.last_overdue((due - self.grace_ms) * 1000 + 999)
        if last is not None:
            # All waiting cycles up to the overdue one, then whatever is complete.
            yield from self._frames(self._take_up_to(key[0], last, waiting, state))
            yield from self._frames(self._drain(key[0], waiting, state))
        self._keep(waiting, state, fired=True)

    def _keep(self, waiting: _Waiting, state: dict, fired: bool = False) -> None:
        """Store what waits and set the timer to the first time one of it may be due."""
        waiting.store()
        first = waiting.first_ts()
        alarm = -1 if first is None else first // 1000 + self.grace_ms
        if fired or alarm != state["alarm"]:
            # A timer that has fired goes by itself.
            if state["alarm"] >= 0 and not fired:
                self.handle.deleteTimer(state["alarm"])
            if alarm >= 0:
                self.handle.registerTimer(alarm)
        state["alarm"] = alarm
        self._save(state)

    def _frames(self, rows: Iterator[dict]) -> Iterator[pd.DataFrame]:
        while out := list(islice(rows, FRAME)):
            yield self._frame(out)

    def _load(self) -> dict:
        if self.selection.exists():
            current, candidate, count, before_last, next_cycle, history, alarm = self.selection.get()
            history = list(history)
        else:
            current, candidate, count = initial_state(self.params)
            before_last, next_cycle, history, alarm = current, self.first_cycle, [], -1
        return {
            "state": (current, candidate, count),
            "before_last": before_last,
            "next_cycle": next_cycle,
            "history": history,
            "alarm": alarm,
        }

    def _save(self, s: dict) -> None:
        self.selection.update((*s["state"], s["before_last"], s["next_cycle"], s["history"], s["alarm"]))

    def _take(self, site_id: int, cycle: int, entry: list, s: dict) -> dict:
        """Smooth and decide one cycle; history holds the last scores, oldest first."""
        ts, flat = entry
        width = len(_FIGURES)
        margin = next(m for m in flat[width - 1 :: width] if m is not None)
        penalty = [penalty_score(), *P.PENALTY.values(), margin]
        if self.params.mode == "warning":
            penalty[:2] = [float("inf"), float("inf")]
        providers = []
        for i in range(self.n):
            part = flat[i * width : (i + 1) * width]
            providers.append(dict(zip(_FIGURES, penalty if part[0] is None else part)))
        values = [p["peer_avg"] if self.params.mode == "warning" else p["score"] for p in providers]
        history = s["history"] + values
        averages = [mean_in_order(history[i :: self.n]) for i in range(self.n)]
        before = s["state"][0]
        s["state"], reason = step(
            s["state"], *pack_cycle(averages, providers, self.params, margin), self.params
        )
        after, candidate, count = s["state"]
        row = {
            "site_id": site_id,
            "cycle": cycle,
            "ts_micros": ts,
            "current": before,
            "reason": reason,
            "counter": count,
            "new": after if after != before else None,
            "previous": s["before_last"] if after != before else None,
            "after_candidate": candidate,
        }
        for i, p in enumerate(providers):
            row[f"smoothed_{i}"] = averages[i]
            row.update({f"{m}_{i}": p[m] for m in P.METRICS})
        if after != before:
            s["before_last"] = before
        keep = self.n * (self.params.history - 1)
        s["history"] = history[-keep:] if keep else []
        return row

    def _frame(self, rows: list[dict]) -> pd.DataFrame:
        schema = output_schema(self.n)
        pdf = pd.DataFrame(rows, columns=schema.fieldNames())
        # Late rows alone have no reason: the column would be taken for floats.
        pdf["reason"] = pdf["reason"].astype(object)
        for name in ("current", "new", "previous", "after_candidate", "late_provider"):
            pdf[name] = pdf[name].astype("Int32")
        for name in ("counter", "late_by"):
            pdf[name] = pdf[name].astype("Int64")
        for name in ("site_id", "cycle", "ts_micros"):
            pdf[name] = pdf[name].astype("int64")
        return pdf


def select_stream(
    measurements: DataFrame,
    providers: list[str],
    params: FailoverParams = FailoverParams(),
    delay: str = "2 minutes",
    grace_seconds: int = 120,
    starts: DataFrame | None = None,
    first_cycle: int = 0,
    late_rows: bool = False,
) -> DataFrame:
    """One row per completed site and cycle from a stream of imputed measurements.

    With ``late_rows`` the measurements that came after their cycle was taken
    come out too, with ``late_provider`` and ``late_by`` and no decision;
    ``jobs.split_batches`` parts the two.

    Measurements may bring the ``switch_margin`` of their site. ``starts`` comes
    from :func:`stream_starts`. Use the RocksDB state store.
    """
    margin = F.lit(float(params.margin))
    if "switch_margin" in measurements.columns:
        margin = F.coalesce("switch_margin", margin)
    order = F.array(*[F.lit(p) for p in providers])
    rows = (
        measurements.where(F.col("provider").isin(providers))
        .withColumn("event_time", times.instant("ts"))
        .withWatermark("event_time", delay)
        .select(
            "site_id",
            "cycle",
            (F.array_position(order, F.col("provider")) - 1).cast("int").alias("provider_ord"),
            "event_time",
            times.micros("ts").alias("ts_micros"),
            F.col("score"),
            *P.METRICS,
            margin.alias("switch_margin"),
        )
    )
    if late_rows:
        # Without the column the watermark still moves on, but does not keep older rows from the processor.
        rows = rows.drop("event_time")
    n = len(providers)
    out = rows.groupBy("site_id").transformWithStateInPandas(
        statefulProcessor=SelectionProcessor(n, params, grace_seconds, first_cycle),
        outputStructType=output_schema(n),
        outputMode="append",
        timeMode="eventTime",
        initialState=None if starts is None else starts.groupBy("site_id"),
    )
    if not late_rows:
        return name_decisions(out.where("late_by IS NULL").drop("late_provider", "late_by"), providers)
    return name_decisions(out, providers).withColumn("late_provider", failover.provider_name("late_provider", providers))


def name_decisions(df: DataFrame, providers: list[str]) -> DataFrame:
    """Provider names for their numbers and a plain timestamp."""
    named = {
        "current_provider": "current",
        "new_provider": "new",
        "previous_provider": "previous",
        "candidate": "after_candidate",
    }
    return (
        df.withColumns({k: failover.provider_name(v, providers) for k, v in named.items()})
        .withColumn("provider_changed", F.col("new").isNotNull())
        .withColumn("ts", times.from_micros("ts_micros"))
        .drop("ts_micros", *named.values())
    )


def stream_starts(decisions: DataFrame, scored: DataFrame, providers: list[str], params: FailoverParams) -> DataFrame:
    """State per site after a batch fold, for the stream to go on from.

    ``scored`` must hold the score of every provider in the last cycles; only
    those that still matter to the trailing mean are looked at.
    """
    keep = params.history - 1
    last = failover.final_states(decisions, providers)
    order = F.array(*[F.lit(p) for p in providers])
    recent = (
        scored.join(last.select("site_id", F.col("cycle").alias("_last")), "site_id")
        .where(F.col("cycle") > F.col("_last") - keep)
        .groupBy("site_id")
        .agg(F.array_sort(F.collect_list(F.struct("cycle", F.array_position(order, F.col("provider")).alias("o"), "score"))).alias("h"))
        .select("site_id", F.transform("h", lambda x: x["score"]).alias("history"))
    )
    lagged = decisions.where("provider_changed").groupBy("site_id").agg(
        F.max_by("current_provider", "cycle").alias("_before")
    )
    before = F.coalesce(F.array_position(order, F.col("_before")).cast("int") - 1, F.lit(params.initial))
    return (
        last.join(recent, "site_id")
        .join(lagged, "site_id", "left")
        .select("site_id", "cycle", "current", "candidate", "count", before.alias("before_last"), "history")
    )
