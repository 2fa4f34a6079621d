"""Parameters and fixed values shared by the whole package."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values -----------------------------------------------------------
# Score weights: lower score is better.
PEER_WEIGHT = 0.7
DNS_WEIGHT = 0.3
LOSS_WEIGHT = 100.0
JITTER_WEIGHT = 0.5

# A failed measurement counts as this row (score 20999).
PENALTY = {
    "peer_avg": 999.0,
    "peer_loss": 100.0,
    "dns_avg": 999.0,
    "dns_loss": 100.0,
    "peer_stddev": 0.0,
    "dns_stddev": 0.0,
}
METRICS = list(PENALTY)

# Default providers: (name, order, destination, peer address, address family).
DEFAULT_PROVIDERS = [
    ("PROVIDER1", 0, "2001:db8:8888::100", "2001:db8:ffaa::255", "6"),
    ("PROVIDER2", 1, "2001:db8:4444::100", "2001:db8:ffac::255", "6"),
]

# Policy names whose rules are rendered.
RENDERED_POLICIES = [
    "EXPORT-TO-IXA",
    "EXPORT-TO-UFINET",
    "SET-LOCAL-PREF-IXA",
    "SET-LOCAL-PREF-UFINET",
]

# Panel bands: (panel, lower bound, colour); the first band has no lower bound.
BANDS = [
    ("score", None, "green"),
    ("score", 30.0, "amber"),
    ("score", 50.0, "red"),
    ("latency", None, "green"),
    ("latency", 40.0, "amber"),
    ("latency", 80.0, "red"),
    ("table", None, "green"),
    ("table", 80.0, "red"),
]

# Headings of the change-history table.
CHANGE_HEADINGS = {
    "ts": "Time",
    "change_reason": "Causa",
    "current_provider": "Actual",
    "cycle": "Ciclo",
    "new_provider": "Próximo",
    "previous_provider": "Anterior",
}

# Per-provider columns of the cycle document, in order.
DOCUMENT_FIELDS = [
    "score",
    "is_healthy",
    "is_primary",
    "peer_latency_ms",
    "peer_jitter_ms",
    "peer_loss_pct",
    "dns_latency_ms",
    "dns_jitter_ms",
    "dns_loss_pct",
    "ip_version",
    "has_latency_warning",
    "has_latency_critical",
    "has_packet_loss",
]

# Decision codes of the failover fold.
STABLE = "STABLE"
INSUFFICIENT_MARGIN = "INSUFFICIENT_MARGIN"
CRITICAL_LOSS = "CRITICAL_LOSS"
SUSTAINED = "SUSTAINED"
EVALUATING = "EVALUATING"
UNHEALTHY = "UNHEALTHY"
MARGIN = "MARGIN"
WARNING = "WARNING"
# -----------------------------------------------------------------------------

# Rows of one (key, chunk) group in position-ordered work. Bounds the largest
# group any task has to sort, however many rows a key has.
CHUNK = 2048


@dataclass(frozen=True)
class Thresholds:
    """Latency thresholds in ms; the defaults are the live engine's."""

    peer_warning: float = 12.0
    peer_critical: float = 25.0
    dns_warning: float = 15.0
    dns_critical: float = 30.0
    switch_margin: float = 5.0


@dataclass(frozen=True)
class FailoverParams:
    """Rules of the provider-selection fold.

    mode ``sustained``  switch on critical loss at once, else after ``sustain``
                        cycles with the same better provider over the margin;
    mode ``margin``     switch at once when another provider is better by more
                        than the margin;
    mode ``warning``    switch at once when another provider is better and the
                        current one is above ``warning``.
    """

    mode: str = "sustained"
    margin: float = 5.0
    sustain: int = 3
    loss_limit: float = 20.0
    history: int = 3
    warning: float = 20.0
    initial: int = 0
    thresholds: Thresholds = Thresholds()
