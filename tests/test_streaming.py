import json
import pickle
import random
import tracemalloc
from datetime import datetime, timedelta

import pandas as pd
import pytest
from measured import PROVIDERS, START, frame, naive_fold, rows
from test_failover import random_cycles

from pathmeter import params as P
from pathmeter import schemas, session
from pathmeter.functions import scoring
from pathmeter.operators import failover
from pathmeter.params import FailoverParams
from pathmeter.sources import reports, tables
from pathmeter.streaming import failover as live
from pathmeter.streaming import jobs


def write_slices(spark, data, folder, slices):
    """One file per slice, older slices first, rows shuffled within."""
    import os
    import time

    folder.mkdir()
    rng = random.Random(3)
    bounds = [len(data) * i // slices for i in range(slices + 1)]
    names = ["site_id", "cycle", "provider", "provider_ord", "ts", "failed", *P.METRICS]
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        part = data[a:b]
        rng.shuffle(part)
        path = folder / f"{i:03d}.json"
        lines = [json.dumps({**dict(zip(names, r)), "ts": r[4].isoformat()}) for r in part]
        path.write_text("\n".join(lines) + "\n")
        os.utime(path, (time.time() - 1000 + i, time.time() - 1000 + i))


def stream(spark, folder, per_trigger=1):
    df = spark.readStream.schema(schemas.MEASUREMENT).option("maxFilesPerTrigger", per_trigger).json(str(folder))
    return scoring.with_score(df)


def run(spark, df, tmp_path, name):
    out = str(tmp_path / f"{name}-out")
    jobs.append_table(df, out, str(tmp_path / f"{name}-cp"), once=True).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def by_site(df):
    index = {p: i for i, p in enumerate(PROVIDERS)} | {None: None}
    out = {}
    for r in df.orderBy("site_id", "cycle").collect():
        out.setdefault(r.site_id, []).append(
            (index[r.current_provider], r.reason, r.counter, index[r.new_provider], index[r.previous_provider])
        )
    return out


@pytest.mark.parametrize("slices", [1, 5])
def test_stream_equals_fold_in_any_split(spark, tmp_path, slices):
    session.use_rocksdb(spark)
    sites = {s: random_cycles(60, 2, s) for s in range(3)}
    data = sorted((r for s, c in sites.items() for r in rows(c, s)), key=lambda r: (r[1], r[0]))
    write_slices(spark, data, tmp_path / "in", slices)
    decided = live.select_stream(stream(spark, tmp_path / "in"), PROVIDERS)
    got = by_site(run(spark, decided, tmp_path, "fold"))
    assert got == {s: naive_fold(c) for s, c in sites.items()}


def test_stream_takes_the_margin_of_each_site(spark, tmp_path):
    session.use_rocksdb(spark)
    sites = {s: random_cycles(40, 2, 40 + s) for s in range(2)}
    write_slices(spark, sorted((r for s, c in sites.items() for r in rows(c, s)), key=lambda r: r[1]), tmp_path / "in", 2)
    margins = spark.createDataFrame([(1, 0.5)], "site_id bigint, switch_margin double")
    calibrated = stream(spark, tmp_path / "in").join(margins, "site_id", "left")
    got = by_site(run(spark, live.select_stream(calibrated, PROVIDERS), tmp_path, "margin"))
    assert got == {0: naive_fold(sites[0]), 1: naive_fold(sites[1], margin=0.5)}


def test_late_provider_is_taken_as_failed(spark, tmp_path):
    session.use_rocksdb(spark)
    cycles = [(6, 10)] * 30
    data = [r for r in rows(cycles) if not (r[1] == 3 and r[2] == "P1")]
    write_slices(spark, data, tmp_path / "in", 6)
    decided = live.select_stream(stream(spark, tmp_path / "in"), PROVIDERS, delay="30 seconds", grace_seconds=60)
    got = by_site(run(spark, decided, tmp_path, "late"))[0]
    assert got == naive_fold([(None, 10) if c == 3 else v for c, v in enumerate(cycles)])[: len(got)]
    assert len(got) == 30


def test_stream_goes_on_from_batch(spark, tmp_path):
    session.use_rocksdb(spark)
    sites = {s: random_cycles(50, 2, 20 + s) for s in range(2)}
    old = [r for s, c in sites.items() for r in rows(c[:30], s)]
    new = [r for s, c in sites.items() for r in rows(c[30:], s, first=30)]
    params = FailoverParams()
    scored = scoring.with_score(frame(spark, old))
    starts = live.stream_starts(failover.fold(scored, PROVIDERS, params, chunk=8), scored, PROVIDERS, params)
    write_slices(spark, sorted(new, key=lambda r: r[1]), tmp_path / "in", 4)
    decided = live.select_stream(
        stream(spark, tmp_path / "in"), PROVIDERS, params, starts=session.materialize(starts, "starts"), first_cycle=30
    )
    got = by_site(run(spark, decided, tmp_path, "on"))
    assert got == {s: naive_fold(c)[30:] for s, c in sites.items()}


def test_actions_are_written_once_per_batch(spark, tmp_path):
    actions = spark.createDataFrame([(0, 1, "P1", 1, "f", "0")], "site_id bigint, cycle bigint, provider string, rule_id bigint, field string, value string")
    path = str(tmp_path / "actions")
    for batch_id in (0, 1, 1):
        tables.write_actions(actions, path, batch_id, dry_run=batch_id == 0)
    got = tables.read_actions(spark, path)
    assert got.count() == 2 and got.where("dry_run").count() == 1


def test_malformed_reports_become_failed_measurements(spark, tmp_path):
    good = {"report": {"mtr": {"src": "s", "dst": "d", "tests": 5}, "hubs": [
        {"count": 1, "host": "p1", "Loss%": 50.0, "Avg": 2.0, "StDev": 0.1},
        {"count": 2, "host": "d1", "Loss%": 1.0, "Avg": None}]}}
    bodies = [json.dumps(good), json.dumps(good)[:-4], "not json", None]
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [
        {"site_id": 0, "provider": "P1", "cycle": i, "ts": (START + timedelta(minutes=i)).isoformat(), "body": b}
        for i, b in enumerate(bodies)
    ]
    (folder / "r.json").write_text("\n".join(map(json.dumps, lines)))
    dimension = spark.createDataFrame([(0, "P1", 0, "d1", "p1", "6")], schemas.PROVIDER)
    out = run(spark, jobs.measure_stream(reports.stream_reports(spark, str(folder)), dimension), tmp_path, "reports")
    got = {r.cycle: r for r in out.collect()}
    assert [got[i].failed for i in range(4)] == [False, True, True, True]
    assert (got[0].peer_avg, got[0].peer_loss, got[0].dns_avg, got[0].dns_stddev) == (2.0, 1.0, float("inf"), 0.0)
    assert got[1].score == 20999.0


def test_late_rows_are_stored_apart_and_counted(spark, tmp_path):
    """A row of cycle 3 comes after the watermark has closed it: the decisions stay, the row is kept."""
    session.use_rocksdb(spark)
    data = rows([(6, 10)] * 30)
    late = [r for r in data if r[1] == 3 and r[2] == "P1"]
    # The last slice brings the late row alone.
    first = [r for r in data if r not in late]
    write_slices(spark, first + late * 6, tmp_path / "in", 6)
    decided = live.select_stream(stream(spark, tmp_path / "in"), PROVIDERS, delay="30 seconds", grace_seconds=60, late_rows=True)
    paths = [str(tmp_path / n) for n in ("out", "late", "counts")]
    jobs.start(decided, str(tmp_path / "cp"), jobs.split_batches(*paths), once=True).awaitTermination()
    out, kept, counts = (spark.read.parquet(p) for p in paths)
    assert by_site(out)[0] == naive_fold([(None, 10) if c == 3 else (6, 10) for c in range(30)])
    got = kept.collect()
    assert {(r.site_id, r.cycle, r.late_by > 0) for r in got} == {(0, 3, True)}
    total = counts.groupBy().sum("decisions", "late_rows").first()
    assert tuple(total) == (30, len(got))


class FakeHandle:
    """State of one site in dictionaries, to run the processor without Spark."""

    class Value:
        kept = None

        def exists(self):
            return self.kept is not None

        def get(self):
            return self.kept

        def update(self, value):
            self.kept = value

    class Map(dict):
        most = 0

        def iterator(self):
            return iter(list(self.items()))

        def getValue(self, key):
            return self[key]

        def updateValue(self, key, value):
            self[key] = value
            self.most = max(self.most, len(self))

        def removeKey(self, key):
            del self[key]

    def __init__(self):
        self.timers, self.maps = set(), {}

    def getValueState(self, name, schema):
        return self.Value()

    def getMapState(self, name, *schemas):
        return self.maps.setdefault(name, self.Map())

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class At:
    def __init__(self, ms):
        self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms


def measured_frame(data):
    names = ["site_id", "cycle", "provider", "provider_ord", "ts", "failed", *P.METRICS]
    pdf = pd.DataFrame(data, columns=names)
    score = (pdf.peer_avg * 0.7 + pdf.dns_avg * 0.3) + (pdf.peer_loss + pdf.dns_loss) * 100.0 + (pdf.peer_stddev + pdf.dns_stddev) * 0.5
    micros = (pdf.ts - pd.Timestamp("1970-01-01")) // pd.Timedelta(microseconds=1)
    return pdf.assign(score=score, ts_micros=micros, switch_margin=5.0)


@pytest.mark.parametrize("order", ["reversed", "shuffled"])
def test_memory_of_the_stream_does_not_grow_with_the_batch(monkeypatch, order):
    """Rows that come long before their turn go to the state store; decisions come out in small frames."""
    for name, size in (("SPAN", 8), ("HELD", 100), ("PARTS", 3), ("FRAME", 64)):
        monkeypatch.setattr(live, name, size, raising=False)
    cycles = random_cycles(600, 2, 5)
    data = rows(cycles)
    data.reverse()
    if order == "shuffled":
        random.Random(4).shuffle(data)
    handle = FakeHandle()
    processor = live.SelectionProcessor(2, FailoverParams(), 120)
    processor.init(handle)
    batches = (measured_frame(data[i : i + 50]) for i in range(0, len(data), 50))
    frames = list(processor.handleInputRows((0,), batches, At(0)))
    assert max(map(len, frames)) <= 64
    assert handle.maps["parts"].most > 10
    out = pd.concat([f for f in frames if len(f)])
    assert out.cycle.tolist() == list(range(600))
    want = naive_fold(cycles)
    assert [(r.current, r.reason, r.counter) for r in out.itertuples()] == [w[:3] for w in want]
    assert not handle.timers and not any(handle.maps.values())


def test_overdue_cycles_over_many_spans_are_taken_in_small_frames(monkeypatch):
    """The first cycle never comes, so all others wait until they are overdue."""
    for name, size in (("SPAN", 8), ("HELD", 100), ("FRAME", 64)):
        monkeypatch.setattr(live, name, size, raising=False)
    cycles = random_cycles(300, 2, 6)
    data = [r for r in rows(cycles) if r[1] > 0]
    handle = FakeHandle()
    processor = live.SelectionProcessor(2, FailoverParams(), 120)
    processor.init(handle)
    assert not sum(map(len, processor.handleInputRows((0,), iter([measured_frame(data[::-1])]), At(0))))
    # At the time of cycle 200 it and all before are overdue; the complete cycles after them follow at once.
    at = measured_frame(data).set_index("cycle").ts_micros[200].iloc[0] // 1000 + 120_000
    assert handle.timers == {at - 199 * 30_000}
    handle.timers.clear()
    frames = list(processor.handleExpiredTimer((0,), At(at), At(at)))
    assert max(map(len, frames)) <= 64
    out = pd.concat(frames)
    assert out.cycle.tolist() == list(range(1, 300))
    want = naive_fold(cycles[1:])
    assert [(r.current, r.reason, r.counter) for r in out.itertuples()] == [w[:3] for w in want]
    assert not handle.timers and not any(handle.maps.values())


def test_cycles_not_yet_overdue_stay_with_a_timer(monkeypatch):
    monkeypatch.setattr(live, "SPAN", 8, raising=False)
    data = [r for r in rows([(6, 10)] * 60) if r[1] > 0 and (r[1] % 2 == 0 or r[2] == "P1")]
    handle = FakeHandle()
    processor = live.SelectionProcessor(2, FailoverParams(), 120)
    processor.init(handle)
    list(processor.handleInputRows((0,), iter([measured_frame(data)]), At(0)))
    due = {c: ts // 1000 + 120_000 for c, ts in measured_frame(data)[["cycle", "ts_micros"]].itertuples(index=False)}
    got = []
    for c in (1, 29, 59):
        handle.timers.clear()
        frames = processor.handleExpiredTimer((0,), At(due[c]), At(due[c]))
        got.append([cycle for f in frames for cycle in f.cycle])
        assert handle.timers == ({due[got[-1][-1] + 1]} if c < 59 else set())
    # A complete cycle after an overdue one is taken with it.
    assert got == [[1, 2], list(range(3, 31)), list(range(31, 60))]


def test_late_rows_alone_make_a_frame_with_text_as_reason():
    frame = live.SelectionProcessor(2, FailoverParams(), 120)._frame([{"site_id": 0, "cycle": 1, "ts_micros": 5, "late_provider": 0, "late_by": 3}])
    assert frame.reason.dtype == object


class StoredHandle(FakeHandle):
    """State of one site whose values lie in files, so that only the processor's own memory counts."""

    class Map(FakeHandle.Map):
        def __init__(self, folder):
            folder.mkdir(parents=True)
            self.folder, self.written = folder, 0

        def iterator(self):
            return ((key, self.getValue(key)) for key in list(self))

        def getValue(self, key):
            return pickle.loads((self.folder / str(self[key])).read_bytes())

        def updateValue(self, key, value):
            self.removeKey(key)
            self.written += 1
            (self.folder / str(self.written)).write_bytes(pickle.dumps(value))
            self[key] = self.written

        def removeKey(self, key):
            if key in self:
                (self.folder / str(self.pop(key))).unlink()

    def __init__(self, folder):
        super().__init__()
        self.folder = folder

    def getMapState(self, name, *schemas):
        if name not in self.maps:
            self.maps[name] = self.Map(self.folder / name)
        return self.maps[name]


def taken_at_peak(frames):
    """Cycles that the frames hold, and the most memory it took to make them one after the other."""
    tracemalloc.start()
    try:
        taken = sum(map(len, frames))
        return taken, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def newest_first(cycles, first=0, size=200):
    """Frames of a site's rows, made as they are asked for."""
    for end in range(len(cycles), first, -size // 2):
        start = max(end - size // 2, first)
        yield measured_frame(rows(cycles[start:end], first=start)[::-1])


def test_peak_of_a_batch_stays_when_its_rows_grow(monkeypatch, tmp_path):
    """Newest rows first, as blocks may be fetched for the policy streams: all wait until the oldest come."""
    for name, size in (("SPAN", 32), ("HELD", 256), ("FRAME", 64)):
        monkeypatch.setattr(live, name, size, raising=False)
    peaks = []
    for count in (800, 3200):
        handle = StoredHandle(tmp_path / str(count))
        processor = live.SelectionProcessor(2, FailoverParams(), 120)
        processor.init(handle)
        cycles = random_cycles(count, 2, 7)
        taken, peak = taken_at_peak(processor.handleInputRows((0,), newest_first(cycles), At(0)))
        assert taken == count and not any(handle.maps.values())
        peaks.append(peak)
    assert peaks[1] < 1.5 * peaks[0]


def test_peak_of_a_timer_stays_when_its_rows_grow(monkeypatch, tmp_path):
    """The first cycle never comes, so the timer alone takes all the others."""
    for name, size in (("SPAN", 32), ("HELD", 256), ("FRAME", 64)):
        monkeypatch.setattr(live, name, size, raising=False)
    peaks = []
    for count in (800, 3200):
        handle = StoredHandle(tmp_path / str(count))
        processor = live.SelectionProcessor(2, FailoverParams(), 120)
        processor.init(handle)
        cycles = random_cycles(count, 2, 8)
        assert not sum(map(len, processor.handleInputRows((0,), newest_first(cycles, first=1), At(0))))
        at = At((START - datetime(1970, 1, 1)) // timedelta(milliseconds=1) + 30_000 * count + 120_000)
        taken, peak = taken_at_peak(processor.handleExpiredTimer((0,), at, at))
        assert taken == count - 1 and not any(handle.maps.values())
        peaks.append(peak)
    assert peaks[1] < 1.5 * peaks[0]
