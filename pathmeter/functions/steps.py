"""The decision step and its transition tables, in plain Python.

Small helpers for the tasks of the batch fold and of the stream; nothing here
touches Spark.
"""

from __future__ import annotations

from collections.abc import Iterable

from pathmeter import params as P
from pathmeter.params import FailoverParams

State = tuple[int, int, int]  # current provider, candidate (-1: none), counter


def initial_state(params: FailoverParams) -> State:
    return (params.initial, -1, 0)


def step(state: State, best: int, over: int, bad: int, params: FailoverParams) -> tuple[State, str]:
    """One cycle: the state after it and the decision code.

    Shared by the batch fold and the stream.
    """
    current, candidate, count = state
    if params.mode == "margin":
        if (over >> current) & 1:
            return (best, -1, 0), P.UNHEALTHY if (bad >> current) & 1 else P.MARGIN
        return state, P.STABLE
    if params.mode == "warning":
        if (over >> current) & 1:
            return (best, -1, 0), P.WARNING
        return state, P.STABLE
    if best == current:
        return (current, -1, 0), P.STABLE
    # The counter grows even while the margin is not met.
    count = count + 1 if candidate == best else 1
    if not (over >> current) & 1:
        return (current, best, count), P.INSUFFICIENT_MARGIN
    if (bad >> current) & 1:
        return (best, -1, 0), P.CRITICAL_LOSS
    if count >= params.sustain:
        return (best, -1, 0), P.SUSTAINED
    return (current, best, count), P.EVALUATING


def penalty_score() -> float:
    p = P.PENALTY
    return (
        (p["peer_avg"] * P.PEER_WEIGHT + p["dns_avg"] * P.DNS_WEIGHT)
        + (p["peer_loss"] + p["dns_loss"]) * P.LOSS_WEIGHT
        + (p["peer_stddev"] + p["dns_stddev"]) * P.JITTER_WEIGHT
    )


def mean_in_order(values: list[float]) -> float:
    """Plain left-to-right mean, as Spark's window computes it."""
    total = 0.0
    for v in values:
        total += v
    return total / len(values)


def pack_cycle(
    averages: list[float], figures: list[dict], params: FailoverParams, margin: float
) -> tuple[int, int, int]:
    """Best provider and the two bit sets of one cycle."""
    n = len(averages)
    best = min(range(n), key=lambda i: (averages[i], i))
    low = averages[best]
    over = bad = 0
    for i in range(n):
        if params.mode == "margin":
            enough = low < averages[i] - margin
            sick = not (
                figures[i]["peer_loss"] == 0.0
                and figures[i]["dns_loss"] == 0.0
                and figures[i]["peer_avg"] < params.thresholds.peer_critical
                and figures[i]["dns_avg"] < params.thresholds.dns_critical
            )
        elif params.mode == "warning":
            enough = low < averages[i] and averages[i] > params.warning
            sick = False
        else:
            enough = averages[i] - low > margin
            sick = not (figures[i]["peer_loss"] < params.loss_limit and figures[i]["dns_loss"] < params.loss_limit)
        over |= int(enough) << i
        bad |= int(sick) << i
    return best, over, bad


def all_states(n: int, params: FailoverParams) -> list[State]:
    """Every start state a chunk can meet; the last counter stands for "or more"."""
    out: list[State] = []
    for current in range(n):
        out.append((current, -1, 0))
        if params.mode == "sustained":
            for candidate in range(n):
                if candidate != current:
                    out.extend((current, candidate, k) for k in range(1, params.sustain + 1))
    return out


def state_index(states: list[State], sustain: int):
    where = {s: i for i, s in enumerate(states)}
    return lambda s: where[(s[0], s[1], min(s[2], sustain))]


def transition_table(
    cycles: Iterable[tuple[int, int, int]], states: list[State], params: FailoverParams
) -> list[tuple[State, bool]]:
    """End state for each start state, and whether its streak never broke.

    Different starts soon meet in one state, so each distinct state is stepped
    once for all starts that are in it.
    """
    members = {s: [i] for i, s in enumerate(states)}
    unbroken = [s[1] >= 0 for s in states]
    for best, over, bad in cycles:
        moved: dict[State, list[int]] = {}
        for now, starts in members.items():
            nxt, _ = step(now, best, over, bad, params)
            if nxt[1] != now[1] or nxt[2] != now[2] + 1:
                for i in starts:
                    unbroken[i] = False
            if nxt in moved:
                moved[nxt] = moved[nxt] + starts
            else:
                moved[nxt] = starts
        members = moved
    ends = {i: s for s, starts in members.items() for i in starts}
    return [(ends[i], unbroken[i]) for i in range(len(states))]


def apply_table(table: list[tuple[State, bool]], state: State, index, sustain: int) -> State:
    """Take one state through a table; an unbroken streak keeps its true length."""
    (current, candidate, count), unbroken = table[index(state)]
    if unbroken and state[2] > sustain:
        count += state[2] - sustain
    return (current, candidate, count)
