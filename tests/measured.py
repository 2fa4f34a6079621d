"""Small measurement tables for the tests."""

from datetime import datetime, timedelta

from pathmeter import params as P
from pathmeter import schemas

PROVIDERS = ["P1", "P2"]
START = datetime(2024, 1, 1)


def metrics(value):
    """``x``: both latencies x; ``(x, l)``: with loss l; None: failed."""
    if value is None:
        return True, dict(P.PENALTY)
    x, loss = value if isinstance(value, tuple) else (value, 0.0)
    return False, {
        "peer_avg": float(x), "peer_loss": float(loss), "dns_avg": float(x), "dns_loss": float(loss),
        "peer_stddev": 0.0, "dns_stddev": 0.0,
    }


def rows(cycles, site_id=0, providers=PROVIDERS, first=0):
    out = []
    for cycle, values in enumerate(cycles, first):
        ts = START + timedelta(seconds=30 * cycle)
        for order, (provider, value) in enumerate(zip(providers, values)):
            failed, m = metrics(value)
            out.append((site_id, cycle, provider, order, ts, failed, *[m[k] for k in P.METRICS]))
    return out


def frame(spark, data):
    schema = schemas.MEASUREMENT
    names = [f.name for f in schema.fields]
    order = names[:6] + P.METRICS
    df = spark.createDataFrame(data, _reordered(schema, order))
    return df.select(*names)


def _reordered(schema, order):
    from pyspark.sql import types as T

    return T.StructType([schema[name] for name in order])


def score(m):
    return (m["peer_avg"] * 0.7 + m["dns_avg"] * 0.3) + (m["peer_loss"] + m["dns_loss"]) * 100.0 + (
        m["peer_stddev"] + m["dns_stddev"]
    ) * 0.5


def naive_fold(cycles, margin=5.0, sustain=3, limit=20.0, history=3, initial=0):
    """The rules written out directly, for one site."""
    current, candidate, count, kept, out = initial, None, 0, [], []
    last = initial
    for values in cycles:
        ms = [metrics(v)[1] for v in values]
        kept.append([score(m) for m in ms])
        kept = kept[-history:]
        avg = []
        for i in range(len(values)):
            total = 0.0
            for k in kept:
                total += k[i]
            avg.append(total / len(kept))
        best = min(range(len(values)), key=lambda i: (avg[i], i))
        new = None
        if best == current:
            candidate, count, reason = None, 0, P.STABLE
        else:
            count = count + 1 if candidate == best else 1
            candidate = best
            if not avg[current] - avg[best] > margin:
                reason = P.INSUFFICIENT_MARGIN
            elif ms[current]["peer_loss"] >= limit or ms[current]["dns_loss"] >= limit:
                reason, new = P.CRITICAL_LOSS, best
            elif count >= sustain:
                reason, new = P.SUSTAINED, best
            else:
                reason = P.EVALUATING
        if new is not None:
            candidate, count = None, 0
        out.append((current, reason, count, new, last if new is not None else None))
        if new is not None:
            last, current = current, new
    return out
