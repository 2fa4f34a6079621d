import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from measured import PROVIDERS, frame, naive_fold, rows

from pathmeter import params as P
from pathmeter.functions import steps
from pathmeter.operators import failover
from pathmeter.params import FailoverParams
from pathmeter.sources import providers

FAIL = None
# (name, initial, cycles, [(current, reason, counter, new, previous)])
GOLDEN = [
    ("sustained", 0, [(6, 10), (30, 10), (30, 10), (30, 10), (30, 10)], [
        (0, P.STABLE, 0, None, None), (0, P.EVALUATING, 1, None, None), (0, P.EVALUATING, 2, None, None),
        (0, P.SUSTAINED, 0, 1, 0), (1, P.STABLE, 0, None, None)]),
    ("counter grows under margin", 0, [(12, 10), (12, 10), (12, 10), (30, 10)], [
        (0, P.INSUFFICIENT_MARGIN, 1, None, None), (0, P.INSUFFICIENT_MARGIN, 2, None, None),
        (0, P.INSUFFICIENT_MARGIN, 3, None, None), (0, P.SUSTAINED, 0, 1, 0)]),
    ("loss at limit", 0, [((5, 20), 6)], [(0, P.CRITICAL_LOSS, 0, 1, 0)]),
    ("loss below limit", 0, [((5, 19.9), 6)] * 3, [
        (0, P.EVALUATING, 1, None, None), (0, P.EVALUATING, 2, None, None), (0, P.SUSTAINED, 0, 1, 0)]),
    ("total outage", 0, [(FAIL, FAIL)] * 2, [(0, P.STABLE, 0, None, None)] * 2),
    ("total outage, second current", 1, [(FAIL, FAIL)] * 2, [
        (1, P.INSUFFICIENT_MARGIN, 1, None, None), (1, P.INSUFFICIENT_MARGIN, 2, None, None)]),
    ("back and forth", 0, [((5, 20), 6), (5, (6, 20)), (5, (6, 20)), (5, (6, 20))], [
        (0, P.CRITICAL_LOSS, 0, 1, 0), (1, P.INSUFFICIENT_MARGIN, 1, None, None),
        (1, P.CRITICAL_LOSS, 0, 0, 0), (0, P.STABLE, 0, None, None)]),
    ("outage, then equal", 0, [(FAIL, 10), (10, 10), (10, 10), (10, 10)], [
        (0, P.CRITICAL_LOSS, 0, 1, 0), (1, P.STABLE, 0, None, None), (1, P.STABLE, 0, None, None),
        (1, P.INSUFFICIENT_MARGIN, 1, None, None)]),
]


def collected(decisions, providers=PROVIDERS):
    index = {p: i for i, p in enumerate(providers)} | {None: None}
    out = {}
    for r in decisions.orderBy("site_id", "cycle").collect():
        out.setdefault(r.site_id, []).append(
            (index[r.current_provider], r.reason, r.counter, index[r.new_provider])
        )
    return out


def test_golden_vectors(spark):
    """All vectors at once, one site each, for both start providers."""
    for initial in (0, 1):
        chosen = [(i, v) for i, v in enumerate(GOLDEN) if v[1] == initial]
        data = [r for i, v in chosen for r in rows(v[2], site_id=i)]
        params = FailoverParams(initial=initial)
        decisions = failover.fold(frame(spark, data), PROVIDERS, params, chunk=2)
        got = collected(decisions)
        assert got == {i: [g[:4] for g in v[3]] for i, v in chosen}
        changes = failover.previous_provider(decisions, PROVIDERS[initial])
        previous = {(r.site_id, r.cycle): r.previous_provider for r in changes.collect()}
        want = {(i, c): PROVIDERS[g[4]] for i, v in chosen for c, g in enumerate(v[3]) if g[3] is not None}
        assert previous == want


def random_cycles(n, providers, seed):
    rng = random.Random(seed)
    levels = [8.0] * providers
    out = []
    for _ in range(n):
        levels = [max(1.0, x + rng.choice([-6, -2, 0, 0, 2, 6])) for x in levels]
        out.append(tuple(
            None if rng.random() < 0.03 else (x, 25.0) if rng.random() < 0.04 else x for x in levels
        ))
    return out


@pytest.mark.parametrize("count,chunk", [(2, 7), (3, 16), (4, 5)])
def test_parallel_fold_equals_direct_fold(spark, count, chunk):
    """A hot site with most of the cycles, and sites that fill part of a chunk."""
    names = [f"P{i}" for i in range(count)]
    sites = {0: random_cycles(900, count, 1), 1: random_cycles(37, count, 2), 2: random_cycles(1, count, 3)}
    data = [r for s, cycles in sites.items() for r in rows(cycles, s, names)]
    got = collected(failover.fold(frame(spark, data), names, chunk=chunk), names)
    assert got == {s: [d[:4] for d in naive_fold(c)] for s, c in sites.items()}


def test_sites_with_their_own_providers(spark, tmp_path):
    """One to four providers, in their own order, with rows of others beside them."""
    sets = {0: ["B", "A"], 1: ["A", "B", "C"], 2: ["C"], 3: ["D", "C", "B", "A"], 4: ["B", "C", "A"]}
    cycles = {s: random_cycles(60 if s else 400, len(names), s + 40) for s, names in sets.items()}
    data = [r for s, names in sets.items() for r in rows(cycles[s], s, names)]
    stray = rows(random_cycles(5, 1, 9), 2, ["A"]) + rows(random_cycles(4, 1, 8), 9, ["A"])
    listed = [(s, p, 3 * i - 7) for s, names in sets.items() for i, p in enumerate(names)] + [(None, "A", 0), (0, None, 1), (0, "A", 50)]
    spark.createDataFrame(listed, "site_id bigint, provider string, provider_ord int").write.parquet(str(tmp_path / "d"))
    dimension = providers.read_dimension(spark, str(tmp_path / "d"))
    measured = frame(spark, data + stray)
    got = failover.fold_by_site(measured, dimension, chunk=16).collect()
    for s, names in sets.items():
        mine = sorted((r for r in got if r.site_id == s), key=lambda r: r.cycle)
        index = {p: i for i, p in enumerate(names)} | {None: None}
        assert [(index[r.current_provider], r.reason, r.counter, index[r.new_provider]) for r in mine] == [
            d[:4] for d in naive_fold(cycles[s])
        ]
    assert {r.site_id for r in got} == set(sets)
    assert {tuple(r) for r in failover.unlisted_by_site(measured, dimension).collect()} == {(2, "A", 5), (9, "A", 4)}
    with pytest.raises(ValueError):
        failover.fold_by_site(measured, dimension, FailoverParams(initial=1))
    assert failover.fold_by_site(measured, dimension.where("false")).count() == 0


def test_long_streak_keeps_its_count_over_chunks(spark):
    cycles = [(12, 10)] * 100 + [(30, 10)]
    got = collected(failover.fold(frame(spark, rows(cycles)), PROVIDERS, chunk=8))[0]
    assert [g[2] for g in got] == [*range(1, 101), 0]
    assert got[-1][1] == P.SUSTAINED


def test_missing_provider_row_counts_as_failed(spark):
    data = [r for r in rows([(6, 10), (6, 10)]) if not (r[1] == 1 and r[2] == "P1")]
    got = collected(failover.fold(frame(spark, data), PROVIDERS))[0]
    assert got == [d[:4] for d in naive_fold([(6, 10), (None, 10)])]


def test_fold_goes_on_from_final_states(spark):
    cycles = random_cycles(120, 2, 9)
    first = failover.fold(frame(spark, rows(cycles)), PROVIDERS, chunk=16)
    states = failover.final_states(first.where("cycle < 64"), PROVIDERS)
    # The history before the cut still counts, so whole chunks are re-read but only later ones reported.
    n = len(PROVIDERS)
    params = FailoverParams()
    wide = failover.smoothed_cycles(frame(spark, rows(cycles)), PROVIDERS, params, chunk=16).where("cycle >= 64")
    later = failover.decision_columns(wide, n, params)
    chunks = failover.chunk_tables(later, n, params)
    starts = failover.start_states(chunks, n, params, states)
    got = {(r.cycle, r.current, failover.REASONS[r.reason]) for r in failover.replay(chunks, starts, params).collect()}
    want = {(c, d[0], d[1]) for c, d in enumerate(naive_fold(cycles)) if c >= 64}
    assert got == want


packed = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 7), st.integers(0, 7)), max_size=40)


@settings(max_examples=150, deadline=None)
@given(packed, packed, st.sampled_from(["sustained", "margin", "warning"]))
def test_tables_compose_like_steps(first, second, mode):
    params = FailoverParams(mode=mode)
    states = steps.all_states(3, params)
    index = steps.state_index(states, params.sustain)
    for start in states:
        state = start
        for cycle in first + second:
            state, _ = steps.step(state, *cycle, params)
        via = start
        for part in (first, second):
            via = steps.apply_table(steps.transition_table(part, states, params), via, index, params.sustain)
        assert via == state


@settings(max_examples=100, deadline=None)
@given(packed)
def test_counter_stays_below_sustain_when_margin_is_always_met(cycles):
    params = FailoverParams()
    state = steps.initial_state(params)
    for best, _, bad in cycles:
        before = state[0]
        state, reason = steps.step(state, best, 7, bad, params)
        assert state[2] <= params.sustain
        assert (reason in (P.SUSTAINED, P.CRITICAL_LOSS)) == (state[0] != before)


def test_margin_and_warning_modes(spark):
    data = frame(spark, rows([(6, 10), (30, 10), (30, 10), (30, 50), (30, 60)]))
    margin = collected(failover.fold(data, PROVIDERS, FailoverParams(mode="margin", margin=3.0)))[0]
    # Smoothed: 6/10, 18/10, 22/10, 30/23.3, 30/40.
    assert [(g[0], g[3]) for g in margin] == [(0, None), (0, 1), (1, None), (1, None), (1, 0)]
    warning = collected(failover.fold(data, PROVIDERS, FailoverParams(mode="warning", history=5, warning=20.0)))[0]
    # Smoothed: 6/10, 18/10, 22/10, 24/20, 25.2/28.
    assert [(g[0], g[3]) for g in warning] == [(0, None), (0, None), (0, 1), (1, None), (1, 0)]


def test_unlisted_rows_are_counted(spark):
    df = spark.createDataFrame(
        [(0, "P0"), (0, "P1"), (0, "P2"), (1, "P2"), (1, "P2"), (1, None)], "site_id bigint, provider string"
    )
    got = {tuple(r) for r in failover.unlisted_rows(df, ["P0", "P1"]).collect()}
    assert got == {(0, "P2", 1), (1, "P2", 2), (1, None, 1)}


def test_fold_over_gaps_does_not_show_the_chunk(spark):
    cycles = random_cycles(120, 2, 9)
    data = rows(cycles, 0)
    df = frame(spark, data).where("cycle % 13 < 8 and cycle % 50 < 30")
    got = {chunk: collected(failover.fold(df, PROVIDERS, chunk=chunk)) for chunk in (4, 2048)}
    assert got[4] == got[2048]


def test_short_chunks_need_no_group_of_their_own(spark):
    """A task steps through many chunks; neither chunks nor their order depend on where Arrow batches end."""
    sites = {s: random_cycles(50, 2, 60 + s) for s in range(3)}
    data = [r for s, c in sites.items() for r in rows(c, s)]
    key, kept = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, 7)
    try:
        for chunk in (4, 20):
            decisions = failover.fold(frame(spark, data), PROVIDERS, chunk=chunk)
            plan = decisions._jdf.queryExecution().toString()
            assert "MapInArrow" in plan and "InPandas " not in plan.replace("MapInPandas ", "")
            assert collected(decisions) == {s: [w[:4] for w in naive_fold(c)] for s, c in sites.items()}
    finally:
        spark.conf.set(key, kept)
