"""Provider selection: which upstream a site should use, cycle by cycle.

The decision is path dependent, so it is a fold in cycle order. What depends
on a cycle alone is computed by Spark in columns and packed into three numbers:

``best``  index of the provider with the lowest smoothed score,
``over``  bit p: if p were current, the best would beat it by enough,
``bad``   bit p: p is unhealthy in this cycle.

The fold then only steps over these. Its state is small and finite, so long
histories are folded in parallel: every (site, chunk) first yields its whole
transition table (end state for each possible start state), the tables are
composed in blocks to give each chunk its true start state, and the chunks are
replayed from there. No task ever holds all cycles of a site, and the
measurements are read and shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathmeter import params as P
from pathmeter import session
from pathmeter.functions import scoring, text
from pathmeter.functions.steps import (
    State,
    all_states,
    apply_table,
    initial_state,
    penalty_score,
    state_index,
    step,
    transition_table,
)
from pathmeter.operators import ordered
from pathmeter.params import CHUNK, FailoverParams

# ------------------------------------------------------------- columns per cycle


def wide_cycles(
    measurements: DataFrame,
    providers: list[str],
    values: dict[str, Column],
    missing: dict[str, object],
    smooth: str,
    rows: int,
    chunk: int = CHUNK,
    extra: list[Column] | None = None,
) -> DataFrame:
    """One row per site and cycle, provider ``i``'s values as ``<name>_<i>``.

    ``avg_<i>`` is the mean of value ``smooth`` over the last ``rows`` cycles
    that occur. A provider without a row in a cycle takes the ``missing`` values:
    it counts as failed; a cycle without any row is skipped. ``extra`` are
    further aggregates of the cycle. All of it costs one shuffle of the
    measurements, on (site, chunk).
    """
    others = [c for c in measurements.columns if c not in values and c != "provider"]
    flat = measurements.where(F.col("provider").isin(providers)).select(
        "provider", *others, *[v.alias(name) for name, v in values.items()]
    )
    if rows > 1:
        placed = ordered.add_halo(flat, ["site_id"], "cycle", rows - 1, chunk)
    else:
        placed = flat.withColumn("_chunk", ordered.whole_div("cycle", chunk)).withColumn("_halo", F.lit(False))

    def of(i: int, name: str) -> Column:
        value = F.max(F.when(F.col("provider") == providers[i], F.col(name)))
        return F.coalesce(value, F.lit(missing[name])).alias(f"{name}_{i}")

    indexes = range(len(providers))
    per_cycle = (
        placed.repartition("site_id", "_chunk")
        .groupBy("site_id", "_chunk", "cycle", "_halo")
        .agg(*(extra or []), *[of(i, name) for i in indexes for name in values])
    )
    window = Window.partitionBy("site_id", "_chunk").orderBy("cycle").rowsBetween(-(rows - 1), 0)
    means = {f"avg_{i}": F.avg(f"{smooth}_{i}").over(window) for i in indexes}
    return per_cycle.withColumns(means).where(~F.col("_halo")).drop("_halo")


def smoothed_cycles(
    measurements: DataFrame, providers: list[str], params: FailoverParams, chunk: int = CHUNK
) -> DataFrame:
    """Smoothed score ``avg_<i>`` and health ``loss_bad_<i>``, ``strict_bad_<i>`` per cycle.

    Measurements may bring the ``switch_margin`` of their site.
    """
    t = params.thresholds
    pings = params.mode == "warning"
    values = {
        "value": F.col("peer_avg") if pings else scoring.quality_score(),
        "loss_bad": ~scoring.is_healthy(params.loss_limit),
        "strict_bad": ~scoring.is_strictly_healthy(F.lit(t.peer_critical), F.lit(t.dns_critical)),
    }
    missing = {"value": float("inf") if pings else penalty_score(), "loss_bad": True, "strict_bad": True}
    own_margin = ["switch_margin"] if "switch_margin" in measurements.columns else []
    needed = measurements.select("site_id", "cycle", "provider", *own_margin, *P.METRICS)
    extra = [F.max(m).alias(m) for m in own_margin]
    return wide_cycles(needed, providers, values, missing, "value", params.history, chunk, extra)


def decision_columns(cycles: DataFrame, n: int, params: FailoverParams) -> DataFrame:
    """Add ``best``, ``over`` and ``bad`` to :func:`smoothed_cycles` rows."""
    avgs = [F.col(f"avg_{i}") for i in range(n)]
    # Lowest smoothed score; on ties the first provider in order.
    lowest = F.array_min(F.array(*[F.struct(a.alias("a"), F.lit(i).alias("i")) for i, a in enumerate(avgs)]))
    best_avg = F.col("_lowest.a")
    margin = F.lit(params.margin)
    if "switch_margin" in cycles.columns:
        margin = F.coalesce("switch_margin", margin)

    def beaten(i: int) -> Column:
        if params.mode == "margin":
            enough = best_avg < avgs[i] - margin
        elif params.mode == "warning":
            enough = (best_avg < avgs[i]) & (avgs[i] > params.warning)
        else:
            # inf - inf is NaN, which Spark would order above any margin.
            gap = avgs[i] - best_avg
            enough = ~F.isnan(gap) & (gap > margin)
        return F.when(enough, F.lit(1 << i)).otherwise(F.lit(0))

    flag = "strict_bad" if params.mode == "margin" else "loss_bad"

    def unhealthy(i: int) -> Column:
        return F.when(F.col(f"{flag}_{i}"), F.lit(1 << i)).otherwise(F.lit(0))

    def total(parts: list[Column]) -> Column:
        out = parts[0]
        for part in parts[1:]:
            out = out + part
        return out

    return (
        cycles.withColumn("_lowest", lowest)
        .withColumn("best", F.col("_lowest.i"))
        .withColumn("over", total([beaten(i) for i in range(n)]))
        .withColumn("bad", total([unhealthy(i) for i in range(n)]))
        .drop("_lowest")
    )


# --------------------------------------------------------------- parallel folding


TABLE = "current array<int>, candidate array<int>, count array<bigint>, unbroken array<boolean>"


def _pack(table: list[tuple[State, bool]]) -> dict:
    return {
        "current": [s[0] for s, _ in table],
        "candidate": [s[1] for s, _ in table],
        "count": [s[2] for s, _ in table],
        "unbroken": [u for _, u in table],
    }


def _unpack(row) -> list[tuple[State, bool]]:
    return [
        ((int(a), int(b), int(c)), bool(u))
        for a, b, c, u in zip(row.current, row.candidate, row.count_, row.unbroken)
    ]


CYCLES = "cycle array<bigint>, best array<int>, over array<bigint>, bad array<bigint>"
CHUNK_ROW = pa.schema(
    [("site_id", pa.int64()), ("pos", pa.int64())]
    + [("current", pa.list_(pa.int32())), ("candidate", pa.list_(pa.int32()))]
    + [("count", pa.list_(pa.int64())), ("unbroken", pa.list_(pa.bool_()))]
    + [(c, pa.list_(pa.int32() if c == "best" else pa.int64())) for c in ("cycle", "best", "over", "bad")]
)


def chunk_tables(cycles: DataFrame, n: int, params: FailoverParams) -> DataFrame:
    """One row per (site, chunk): its transition table and its packed cycles.

    A task steps through the rows of many chunks, so chunks may be short.
    """
    states = all_states(n, params)
    packed = ("cycle", "best", "over", "bad")

    def table_of(site: int | None, pos: int, columns: list[list]) -> dict:
        table = transition_table(zip(*columns[1:]), states, params)
        return {"site_id": site, "pos": pos, **_pack(table), **dict(zip(packed, columns))}

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            sites, chunks, firsts = (batch.column(c).to_pylist() for c in ("site_id", "_chunk", "_first"))
            columns = [batch.column(c).to_pylist() for c in packed]
            done, begin = [], 0
            for at in [*(i for i, first in enumerate(firsts) if first), len(firsts)]:
                if at > begin:
                    held = [old + new[begin:at] for old, new in zip(held, columns)]
                if at < len(firsts):
                    if key is not None:
                        done.append(table_of(*key, held))
                    key, held = (sites[at], chunks[at]), [[] for _ in packed]
                begin = at
            if done:
                yield pa.RecordBatch.from_pylist(done, CHUNK_ROW)
        if key is not None:
            yield pa.RecordBatch.from_pylist([table_of(*key, held)], CHUNK_ROW)

    # The rows of a chunk are already together; the window puts them in order and marks where a chunk begins.
    order = Window.partitionBy("site_id", "_chunk").orderBy("cycle")
    marked = cycles.select(
        "site_id", "_chunk", "cycle", "best", "over", "bad", (F.row_number().over(order) == 1).alias("_first")
    )
    return marked.mapInArrow(tables, f"site_id bigint, pos bigint, {TABLE}, {CYCLES}")


def start_states(
    tables: DataFrame,
    n: int,
    params: FailoverParams,
    starts: DataFrame | None = None,
    block: int = CHUNK,
    levels: int = 2,
) -> DataFrame:
    """The state each table starts from: (site_id, pos, start_*).

    ``starts`` optionally gives a state per site to begin with. Tables of a block
    are composed first, then blocks are walked, then the tables inside each.
    """
    if levels <= 1:
        begin = None
        if starts is not None:
            begin = starts.select("site_id", *[F.col(c).alias(f"start_{c}") for c in ("current", "candidate", "count")])
        return _walk(tables, ["site_id"], begin, n, params)
    blocked = tables.withColumn("_block", ordered.whole_div("pos", block))
    composed = _compose(blocked, n, params)
    begin = start_states(composed, n, params, starts, block, levels - 1).withColumnRenamed("pos", "_block")
    return _walk(blocked, ["site_id", "_block"], begin, n, params)


def _in_runs(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a key together and in order, so that a task can step through
    many keys without a group of its own for each."""
    return df.repartition(*keys).sortWithinPartitions(*keys, "pos")


def _compose(blocked: DataFrame, n: int, params: FailoverParams) -> DataFrame:
    """One table per (site, block) that does what its tables do in turn."""
    states = all_states(n, params)
    index = state_index(states, params.sustain)

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ends, unbroken = None, [], []
        for pdf in batches:
            done = []
            for row in pdf.rename(columns={"count": "count_", "_block": "block"}).itertuples(index=False):
                if key != (row.site_id, row.block):
                    if key is not None:
                        done.append({"site_id": key[0], "pos": key[1], **_pack(list(zip(ends, unbroken)))})
                    key, ends, unbroken = (row.site_id, row.block), list(states), [s[1] >= 0 for s in states]
                table = _unpack(row)
                for i, state in enumerate(ends):
                    unbroken[i] = unbroken[i] and table[index(state)][1]
                    ends[i] = apply_table(table, state, index, params.sustain)
            if done:
                yield pd.DataFrame(done)
        if key is not None:
            yield pd.DataFrame([{"site_id": key[0], "pos": key[1], **_pack(list(zip(ends, unbroken)))}])

    runs = _in_runs(blocked, ["site_id", "_block"])
    return runs.mapInPandas(compose, f"site_id bigint, pos bigint, {TABLE}")


def _walk(tables: DataFrame, keys: list[str], begin: DataFrame | None, n: int, params: FailoverParams) -> DataFrame:
    """Step through the tables of each key from its begin state, or a fresh one."""
    index = state_index(all_states(n, params), params.sustain)
    fresh = initial_state(params)
    names = ["site_id", "pos", "start_current", "start_candidate", "start_count"]
    given_begin = begin is not None

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, fresh
        for pdf in batches:
            out = []
            begins = zip(*[pdf[c].tolist() for c in names[2:]]) if given_begin else None
            owners = zip(*[pdf[k].tolist() for k in keys])
            for row, owner in zip(pdf.rename(columns={"count": "count_"}).itertuples(index=False), owners):
                given = next(begins) if begins is not None else None
                if owner != key:
                    known = given is not None and pd.notna(given[0])
                    key, state = owner, tuple(int(x) for x in given) if known else fresh
                out.append((row.site_id, row.pos, *state))
                state = apply_table(_unpack(row), state, index, params.sustain)
            yield pd.DataFrame(out, columns=names)

    joined = tables if begin is None else tables.join(begin, keys, "left")
    return _in_runs(joined, keys).mapInPandas(
        walk, "site_id bigint, pos bigint, start_current int, start_candidate int, start_count bigint"
    )


REASONS = [
    P.STABLE,
    P.INSUFFICIENT_MARGIN,
    P.EVALUATING,
    P.SUSTAINED,
    P.CRITICAL_LOSS,
    P.UNHEALTHY,
    P.MARGIN,
    P.WARNING,
]
# Numbers only: names and codes are put in by Spark.
DECISION = "site_id bigint, cycle bigint, current int, reason int, counter bigint, new int, after_candidate int"


def replay(chunks: DataFrame, starts: DataFrame, params: FailoverParams) -> DataFrame:
    """Fold every chunk from its start state; one row per cycle.

    The state before the switch is reported; ``new`` is -1 without a switch and
    ``reason`` an index into ``REASONS``.
    """
    codes = {reason: i for i, reason in enumerate(REASONS)}
    begin = ("start_current", "start_candidate", "start_count")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = initial_state(params)
        for batch in batches:
            current, reason, count, new, candidate = [], [], [], [], []
            for at, best, over, bad, *first in zip(*[batch.column(c).to_pylist() for c in ("_at", "best", "over", "bad", *begin)]):
                if at == 0:
                    state = tuple(first)
                before = state[0]
                state, why = step(state, best, over, bad, params)
                current.append(before)
                reason.append(codes[why])
                count.append(state[2])
                new.append(state[0] if state[0] != before else -1)
                candidate.append(state[1])
            ints, longs = pa.int32(), pa.int64()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("site_id"),
                    batch.column("cycle"),
                    pa.array(current, ints),
                    pa.array(reason, ints),
                    pa.array(count, longs),
                    pa.array(new, ints),
                    pa.array(candidate, ints),
                ],
                ["site_id", "cycle", "current", "reason", "counter", "new", "after_candidate"],
            )

    packed = chunks.select("site_id", "pos", F.arrays_zip("cycle", "best", "over", "bad").alias("_cycles"))
    first = starts.select(F.col("site_id").alias("_site"), F.col("pos").alias("_pos"), *begin)
    joined = packed.join(first, F.col("site_id").eqNullSafe(F.col("_site")) & (F.col("pos") == F.col("_pos")), "left")
    # A chunk is one row up to here, so its cycles come together and in order. One without
    # a start state is not dropped: its step fails.
    rows = joined.select("site_id", *begin, F.posexplode("_cycles").alias("_at", "_c"))
    return rows.select("site_id", "_at", "_c.*", *begin).mapInArrow(run, DECISION)


def fold(
    measurements: DataFrame,
    providers: list[str],
    params: FailoverParams = FailoverParams(),
    starts: DataFrame | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Decision per site and cycle over imputed measurements.

    The margin is that of ``params``, or the site's where the measurements have
    a ``switch_margin``: join calibrated thresholds to them first, while the
    rows of a site can still be split. Columns: ``site_id, cycle, current_provider, reason, counter,
    provider_changed, new_provider, candidate``.
    """
    n = len(providers)
    cycles = decision_columns(smoothed_cycles(measurements, providers, params, chunk), n, params)
    # Stored once for its two uses: a few small numbers per cycle, against the
    # full measurements that went in.
    chunks = session.materialize(chunk_tables(cycles, n, params), "chunks")
    tables = chunks.select("site_id", "pos", "current", "candidate", "count", "unbroken")
    decided = replay(chunks, start_states(tables, n, params, starts), params)
    return decided.select(
        "site_id",
        "cycle",
        provider_name("current", providers).alias("current_provider"),
        F.get(F.array(*[F.lit(r) for r in REASONS]), F.col("reason")).alias("reason"),
        "counter",
        (F.col("new") >= 0).alias("provider_changed"),
        provider_name("new", providers).alias("new_provider"),
        provider_name("after_candidate", providers).alias("candidate"),
    )


def fold_by_site(
    measurements: DataFrame, dimension: DataFrame, params: FailoverParams = FailoverParams(), chunk: int = CHUNK
) -> DataFrame:
    """:func:`fold` where every site has its own providers.

    ``dimension`` holds (site_id, provider, provider_ord), numbered from 0 per
    site, as :func:`pathmeter.sources.providers.read_dimension` gives it. Sites
    with equally many providers are folded together, so a table of states is as
    large as the site's own set asks for; there is one fold for each such
    number. A listed provider without a row in a cycle counts as failed. Rows of
    providers that the site does not list are left out;
    :func:`unlisted_by_site` counts them. ``params.initial`` must be a provider
    number that every site has.
    """
    listed = dimension.select("site_id", "provider", F.col("provider_ord").alias("_ord"))
    sets = listed.groupBy("site_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_ord", "provider"))), lambda x: x["provider"]).alias("_names")
    )
    sets = session.materialize(sets.withColumn("_n", F.size("_names")), "provider-sets")
    # One number per size of a set, not per site.
    sizes = sorted(r["_n"] for r in sets.select("_n").distinct().collect())
    if sizes and params.initial >= sizes[0]:
        raise ValueError(f"a site has {sizes[0]} providers only, none numbered {params.initial}")
    numbers = sets.select("site_id", "_n", F.posexplode("_names").alias("_ord", "provider"))
    known = measurements.join(numbers, ["site_id", "provider"])
    known = session.materialize(known.withColumn("provider", F.col("_ord").cast("string")).drop("_ord"), "listed", by="_n")
    folds = [
        fold(known.where(F.col("_n") == n).drop("_n"), [str(i) for i in range(n)], params, chunk=chunk) for n in sizes or [1]
    ]
    out = folds[0]
    for other in folds[1:]:
        out = out.unionByName(other)
    named = {c: F.get("_names", F.col(c).cast("int")) for c in ("current_provider", "new_provider", "candidate")}
    columns = out.columns
    return out.join(sets.drop("_n"), "site_id").withColumns(named).select(*columns)


def unlisted_by_site(measurements: DataFrame, dimension: DataFrame) -> DataFrame:
    """(site_id, provider, rows): what :func:`fold_by_site` leaves out; rows without
    a site or a provider are among them.

    Rows are counted before the look-up, so no hot site is joined row by row.
    """
    counted = measurements.groupBy("site_id", "provider").agg(F.count(F.lit(1)).alias("rows"))
    return counted.join(dimension.select("site_id", "provider"), ["site_id", "provider"], "left_anti")


def unlisted_rows(measurements: DataFrame, providers: list[str]) -> DataFrame:
    """(site_id, provider, rows): what :func:`fold` leaves out, as its provider is
    not listed; a null provider counts as one of them."""
    listed = F.coalesce(F.col("provider").isin(providers), F.lit(False))
    return measurements.where(~listed).groupBy("site_id", "provider").agg(F.count(F.lit(1)).alias("rows"))


def provider_name(index: str, providers: list[str]) -> Column:
    names = F.array(*[F.lit(p) for p in providers])
    return F.when(F.col(index) >= 0, F.get(names, F.col(index)))


def final_states(decisions: DataFrame, providers: list[str]) -> DataFrame:
    """State of each site after its last cycle, to start a stream or a later fold."""
    last = F.max_by(
        F.struct("current_provider", "new_provider", "candidate", "counter", "cycle"), "cycle"
    )
    order = F.array(*[F.lit(p) for p in providers])

    def index(name: Column) -> Column:
        return F.when(name.isNull(), F.lit(-1)).otherwise(F.array_position(order, name).cast("int") - 1)

    return decisions.groupBy("site_id").agg(last.alias("s")).select(
        "site_id",
        F.col("s.cycle").alias("cycle"),
        index(F.coalesce("s.new_provider", "s.current_provider")).alias("current"),
        index(F.col("s.candidate")).alias("candidate"),
        F.col("s.counter").alias("count"),
    )


# -------------------------------------------------------------- after the decision


def previous_provider(decisions: DataFrame, initial: str) -> DataFrame:
    """Add the emitted and the corrected previous provider to change events.

    The emitted field lags: at change k it names the primary before change k-1,
    and the initial primary at the first change.
    """
    changes = decisions.where("provider_changed").withColumn(
        "_seen", F.struct("cycle", "current_provider")
    )
    return (
        ordered.prefix_scan(changes, ["site_id"], "cycle", "_seen", "max", "_before")
        .withColumn("previous_provider", F.coalesce("_before.current_provider", F.lit(initial)))
        .withColumn("previous_corrected", F.col("current_provider"))
        .drop("_seen", "_before")
    )


def policy_actions(
    changes: DataFrame,
    providers: DataFrame,
    rules: DataFrame,
    prepend: int = 3,
    preferred: str = "200",
    backup: str = "100",
) -> DataFrame:
    """Rule updates that make ``new_provider`` primary, one row per rule.

    The new primary gets prepend 0 and the preferred local preference, every
    other provider of the site the backup values. Providers lacking one of
    their two rules are left out; :func:`unconfigured_providers` reports them.
    """
    pairs = configured_rules(providers, rules)
    joined = changes.select("site_id", "cycle", "new_provider").join(pairs, "site_id")
    primary = F.col("provider") == F.col("new_provider")
    updates = F.array(
        F.struct(
            F.col("export_rule_id").alias("rule_id"),
            F.lit("as_path_prepend_count").alias("field"),
            F.when(primary, F.lit("0")).otherwise(F.lit(str(prepend))).alias("value"),
        ),
        F.struct(
            F.col("pref_rule_id").alias("rule_id"),
            F.lit("local_preference").alias("field"),
            F.when(primary, F.lit(preferred)).otherwise(F.lit(backup)).alias("value"),
        ),
    )
    return joined.select("site_id", "cycle", "provider", F.inline(updates))


def merged_rules(actions: DataFrame, rules: DataFrame) -> DataFrame:
    """The whole rule each action of :func:`policy_actions` asks for.

    ``rules`` holds (site_id, rule_id, routing_policy, index, action,
    custom_fields). All existing fields stay, the new one on top of them; a rule
    without fields, or with a null map, gets the new one alone. The prepend
    count is a whole number (null if it does not read as one), the preference
    a text. An action whose rule is not listed comes out with ``found`` false.
    """
    listed = rules.select(
        "site_id", "rule_id", "routing_policy", "index", "action", "custom_fields", F.lit(True).alias("found")
    )
    fields = text.merge_fields("custom_fields", F.create_map("field", "value"))
    merged = actions.join(listed, ["site_id", "rule_id"], "left").withColumn("custom_fields", fields)
    return merged.select(
        *actions.columns,
        F.coalesce("found", F.lit(False)).alias("found"),
        "routing_policy",
        "index",
        "action",
        "custom_fields",
        F.try_element_at("custom_fields", F.lit("as_path_prepend_count")).try_cast("int").alias("as_path_prepend_count"),
        F.try_element_at("custom_fields", F.lit("local_preference")).alias("local_preference"),
    )


def _rule_names(providers: DataFrame) -> DataFrame:
    key = scoring.provider_key("provider")
    return providers.select(
        "site_id",
        "provider",
        F.concat(F.lit("EXPORT-TO-"), key).alias("export_key"),
        F.concat(F.lit("SET-LOCAL-PREF-"), key).alias("pref_key"),
    )


def configured_rules(providers: DataFrame, rules: DataFrame) -> DataFrame:
    """Providers whose export and preference rule both exist.

    ``rules`` holds (site_id, rule_name, rule_id).
    """
    export = rules.select("site_id", F.col("rule_name").alias("export_key"), F.col("rule_id").alias("export_rule_id"))
    pref = rules.select("site_id", F.col("rule_name").alias("pref_key"), F.col("rule_id").alias("pref_rule_id"))
    return (
        _rule_names(providers)
        .join(export, ["site_id", "export_key"])
        .join(pref, ["site_id", "pref_key"])
        .select("site_id", "provider", "export_rule_id", "pref_rule_id")
    )


def unconfigured_providers(providers: DataFrame, rules: DataFrame) -> DataFrame:
    """Providers that cannot be switched to because a rule is missing."""
    return providers.select("site_id", "provider").join(
        configured_rules(providers, rules), ["site_id", "provider"], "left_anti"
    )
