"""The scan of a case: all rules and all applicable operators over one event table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlog.operators import chains, cross, host, web
from quernlog.operators.review import findings_to_hits
from quernlog.operators.rules import event_rule_hits

Detector = Callable[..., DataFrame]

# operator id -> (family, severity, function, parameters, domain (log types, artifact kinds))
OPERATORS: dict[str, tuple[str, str, Detector, dict, tuple[list[str], list[str]]]] = {
    "web-bruteforce-chain": ("web", "high", chains.bruteforce_chain, {}, (["web_access"], [])),
    "web-sequence-chain": ("web", "high", chains.sequence_chain, {}, (["web_access"], [])),
    "web-beacon-periodicity": ("web", "medium", web.beacon_periodicity, {}, (["web_access"], [])),
    "web-ip-rate-spike": ("web", "medium", web.ip_rate_spike, {}, (["web_access"], [])),
    "web-key-divergence": ("web", "low", web.key_divergence, {"diverge_field": "method"}, (["web_access"], [])),
    "web-cross-key-same-value": ("web", "low", web.cross_key_same_value, {}, (["web_access"], [])),
    "web-outlier": (
        "web", "low", web.size_outlier, {"key_fields": ["path", "method", "status"], "min_samples": 20}, (["web_access"], []),
    ),
    "host-auth-chain": ("host", "high", chains.auth_chain, {}, (["windows_event_log"], [])),
    "host-persistence-task": ("host", "medium", host.persistence_task, {}, (["windows_event_log"], [])),
    "host-service-install": ("host", "high", host.service_install, {}, (["windows_event_log"], [])),
    "host-process-tree": ("host", "medium", host.process_tree, {}, (["windows_event_log"], [])),
    "host-credential-face": ("host", "high", host.credential_face, {}, (["windows_event_log"], [])),
    "host-time-cluster": ("host", "high", host.time_cluster, {}, (["usn_journal"], [])),
    "cross-entity-multi-source": (
        "cross", "high", cross.cross_entity_multi_source, {}, (["web_access", "windows_event_log"], []),
    ),
    "cross-host-entity": ("cross", "high", cross.cross_host_entity, {}, (["web_access", "windows_event_log"], [])),
}
DOMAINS = {op: spec[4] for op, spec in OPERATORS.items()}
SEVERITIES = {op: spec[1] for op, spec in OPERATORS.items()}


def register_operator(
    op_id: str, *, severity: str = "medium", family: str = "custom", log_types: tuple[str, ...] = (), **params: object
) -> Callable[[Detector], Detector]:
    """Add a detector of one's own: a function (events, sources, **params) returning findings."""

    def add(fn: Detector) -> Detector:
        OPERATORS[op_id] = (family, severity, fn, params, (list(log_types), []))
        return fn

    return add


def run_operators(
    events: DataFrame, sources: DataFrame | None = None, *, families: tuple[str, ...] | None = None,
    only: tuple[str, ...] | None = None,
) -> list[DataFrame]:
    """Findings of each operator; the operators are independent jobs over the same columns."""
    return [
        fn(events, sources, **params)
        for op_id, (family, _, fn, params, _) in OPERATORS.items()
        if (families is None or family in families) and (only is None or op_id in only)
    ]


def scan_case(
    events: DataFrame, sources: DataFrame | None = None, *, families: tuple[str, ...] | None = None,
    only: tuple[str, ...] | None = None,
) -> DataFrame:
    """All candidates of an event table: signature rules and operators in one layout."""
    ruled = event_rule_hits(events).withColumn("detail", F.lit("{}"))
    found = [findings_to_hits(f, SEVERITIES) for f in run_operators(events, sources, families=families, only=only)]
    return reduce(lambda a, b: a.unionByName(b), found, ruled)
