"""Metrics by id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from assayer.operators.addresses import protocol_validity, reserved_addresses
from assayer.operators.base import Metric
from assayer.operators.columns import column_quality, pearson
from assayer.operators.flows import flow_durations, handshakes, packet_bytes, tcp_flags
from assayer.operators.ports import port_ranges, service_ports
from assayer.operators.slices import consistent_slices, valid_slices
from assayer.operators.timestamps import timestamp_coherence

METRICS: dict[str, Callable[[DataFrame, dict], Metric]] = {}


def register_metric(metric_id: str):
    """Add a builder ``(df, spec) -> Metric`` under an id; use as a decorator or a call."""

    def add(build):
        METRICS[metric_id] = build
        return build

    return add


for _id, _build in (
    ("column_quality_profile", column_quality),
    ("pearson_correlation_profile", pearson),
    ("timestamp_coherence_profile", timestamp_coherence),
    ("protocol_validity_profile", protocol_validity),
    ("reserved_ip_address_profile", reserved_addresses),
    ("valid_port_range_profile", port_ranges),
    ("service_port_consistency_profile", service_ports),
    ("tcp_flag_consistency_profile", tcp_flags),
    ("handshake_plausibility_profile", handshakes),
    ("flow_duration_consistency_profile", flow_durations),
    ("packet_byte_consistency_profile", packet_bytes),
    ("valid_slice_identifier_profile", valid_slices),
    ("slice_identifier_consistency_profile", consistent_slices),
):
    register_metric(_id)(_build)


def build_metric(df: DataFrame, spec: dict) -> Metric:
    """The metric a spec names; ValueError for unknown ids, Rejected if it can't run on these columns."""
    build = METRICS.get(spec["metric_id"])
    if build is None:
        raise ValueError(f"Unsupported metric_id: {spec['metric_id']}")
    return build(df, spec)
