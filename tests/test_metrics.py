import math

import pytest

from assayer.operators.base import Rejected
from assayer.plans.registry import METRICS, build_metric
from assayer.plans.runner import finish_metric, fused_counts


def run(df, metric_id, needs=None, params=None):
    metric = build_metric(df, {"metric_id": metric_id, "input_requirements": needs or {}, "calculation": {"method": "m", "parameters": params or {}}})
    return finish_metric(df, metric, fused_counts(df, [metric])[0])


def frame(spark, columns, rows):
    names = [f"`{c}` string" for c in columns] + ["row_index long"]
    return spark.createDataFrame([(*[None if v is None else str(v) for v in r], i) for i, r in enumerate(rows)], ", ".join(names))


def test_registry():
    assert len(METRICS) == 13
    with pytest.raises(ValueError):
        build_metric(None, {"metric_id": "nothing"})


def test_column_quality(spark):
    df = frame(spark, ["a", "b", "c", "d", "e"], [(1, "x", None, 5, 7), (2, "y", None, 5, None), (2, 3, None, 5, None), (None, None, None, 5, None)])
    got = run(df, "column_quality_profile", {"candidate_fields": ["a", "b", "c", "d", "e", "gone"]})
    by = {f["field"]: f for f in got["fields"]}
    assert [by[f]["reason"] for f in ("a", "b", "c", "d", "e", "gone")] == ["usable", "insufficient_numeric_values", "empty_column", "constant_column", "insufficient_numeric_values", "missing_column"]
    assert by["a"]["non_null_ratio"] == 0.75 and by["a"]["unique_ratio"] == round(2 / 3, 6) and by["e"]["constant_column"] and by["d"]["constant_column"]
    assert got["summary"]["field_count"] == 6 and got["summary"]["quality_score"] == round(1 / 6, 6) and got["summary"]["missing_field_count"] == 1
    empty = run(df, "column_quality_profile", {"candidate_fields": []})
    assert empty["summary"]["quality_score"] is None
    with pytest.raises(Rejected):
        run(df, "column_quality_profile")


def test_quality_of_text_column_is_non_numeric(spark):
    df = frame(spark, ["a"], [("x",), ("y",)])
    assert run(df, "column_quality_profile", {"candidate_fields": ["a"]})["fields"][0]["reason"] == "non_numeric"


def test_pearson(spark):
    df = frame(spark, ["a", "b", "c", "k"], [(1, 2, "inf", 1), (2, 4, 1, 1), (3, 6, 0, 1), (4, None, -1, 1)])
    got = run(df, "pearson_correlation_profile", {"candidate_fields": ["a", "b", "c", "k"], "minimum_runnable_fields": 2})
    assert got["fields"] == ["a", "b", "c"]
    pairs = {tuple(p["fields"]): p for p in got["summary"]["pairs"]}
    assert pairs["a", "b"]["value"] == 1.0 and pairs["a", "b"]["overlap_non_null_count"] == 3
    assert pairs["a", "c"]["value"] == -1.0 and pairs["a", "c"]["overlap_non_null_count"] == 4
    assert got["matrix"]["b"]["a"] == 1.0 and got["summary"]["mean_absolute_correlation"] == 1.0
    with pytest.raises(Rejected) as e:
        run(df, "pearson_correlation_profile", {"candidate_fields": ["a", "k", "no"], "minimum_runnable_fields": 2})
    assert [v["reason"] for v in e.value.payload["column_validation"]] == ["usable", "constant_column", "missing_column"]


def test_pearson_without_overlap_is_nan(spark):
    df = frame(spark, ["a", "b"], [(1, None), (2, None), (None, 1), (None, 2)])
    got = run(df, "pearson_correlation_profile", {"candidate_fields": ["a", "b"], "minimum_runnable_fields": 2})
    assert math.isnan(got["summary"]["pairs"][0]["value"]) and got["summary"]["mean_absolute_correlation"] is None


def packets(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "packet_index long, ts double, wire_len int, ip_version int, src string, dst string")


def test_timestamps(spark):
    df = packets(spark, [(t, 60, None, None, None) for t in (10.0, 10.0, 10.5, 12.0, 11.0, 13.0)])
    got = run(df, "timestamp_coherence_profile")
    assert got == {"packet_count": 6, "first_timestamp": 10.0, "last_timestamp": 13.0, "capture_duration_seconds": 3.0, "backwards_jump_count": 1, "zero_delta_count": 1, "large_gap_count": 2, "large_gap_threshold_seconds": 1.0, "gap_count": 4, "mean_gap_seconds": 1.0, "max_gap_seconds": 2.0, "status": "warn"}
    assert run(packets(spark, [(5.0, 60, None, None, None)]), "timestamp_coherence_profile")["mean_gap_seconds"] is None
    with pytest.raises(Rejected):
        run(packets(spark, []), "timestamp_coherence_profile")


def test_timestamp_chunks_agree(spark):
    from assayer.operators.timestamps import gap_facts

    df = spark.range(1000).selectExpr("id as packet_index", "cast(id * 7 % 31 as double) as ts")
    assert gap_facts(df, chunk=7).first() == gap_facts(df).first() == gap_facts(df, chunk=1).first()


def test_protocol_validity(spark):
    df = packets(spark, [(1.0, 60, 4, "1.1.1.1", "8.8.8.8"), (2.0, 60, 6, "::1", "x"), (3.0, 60, None, None, None), (4.0, 0, None, None, None), (5.0, 60, 4, "1.1.1.1", "")])
    got = run(df, "protocol_validity_profile")
    assert (got["packet_count"], got["valid_packet_count"], got["zero_length_packet_count"], got["checked_row_count"], got["invalid_row_count"]) == (5, 3, 1, 3, 1)
    assert got["address_family_counts"] == {"ipv4": 3, "ipv6": 1, "unknown": 2} and got["field_counts"]["destination_ip"] == {"checked": 3, "invalid": 1, "missing": 1}
    assert got["status"] == "fail"


def test_reserved(spark):
    df = frame(spark, ["Src IP", "Dst IP"], [("10.0.0.1", "8.8.8.8"), ("8.8.4.4", "bad"), (None, "::1"), ("1.1.1.1", "203.0.113.1")])
    got = run(df, "reserved_ip_address_profile")
    assert (got["checked_address_count"], got["valid_address_count"], got["invalid_address_count"], got["missing_address_count"], got["reserved_address_count"], got["reserved_row_count"]) == (8, 6, 1, 1, 3, 3)
    assert got["reserved_category_counts"]["private"] == 3 and got["reserved_category_counts"]["documentation"] == 1 and got["ip_version_counts"] == {"ipv4": 5, "ipv6": 1}
    assert [e["row_index"] for e in got["reserved_examples"]] == [0, 2, 3] and got["invalid_examples"] == [{"row_index": 1, "field": "Dst IP", "value": "bad"}]
    assert got["missing_fields"] == ["Source IP", "Destination IP"] and got["status"] == "fail"
    with pytest.raises(Rejected):
        run(frame(spark, ["x"], [(1,)]), "reserved_ip_address_profile")


def test_port_ranges(spark):
    df = frame(spark, ["Src Port", "Dst Port"], [("0", "53"), ("80.5", "70000"), (None, "50000"), ("2000", "443")])
    got = run(df, "valid_port_range_profile", {"candidate_fields": ["Src Port", "Dst Port", "no"]})
    assert (got["checked_port_count"], got["valid_port_count"], got["invalid_port_count"], got["missing_port_count"], got["non_integer_port_count"], got["out_of_range_port_count"], got["zero_port_count"], got["invalid_row_count"]) == (7, 5, 2, 1, 1, 1, 1, 1)
    assert got["range_counts"] == {"well_known": 3, "registered": 1, "dynamic_private": 1}
    assert [(e["row_index"], e["field"], e["reason"]) for e in got["invalid_examples"]] == [(1, "Src Port", "non_integer"), (1, "Dst Port", "out_of_range")]
    assert got["status"] == "fail" and got["field_summaries"][0]["invalid_port_ratio"] == round(1 / 3, 6)
    empty = run(frame(spark, ["Src Port"], [(None,)]), "valid_port_range_profile", {"candidate_fields": ["Src Port"]})
    assert empty["valid_port_range_ratio"] is None and empty["status"] == "pass"
    for needs in ({}, {"candidate_fields": ["no"]}):
        with pytest.raises(Rejected):
            run(df, "valid_port_range_profile", needs)


SERVICE = {"service_name": "dns", "expected_ports": [53, "5353"]}


@pytest.mark.parametrize("mode, matched", [("any_port", 2), ("destination_only", 2), ("source_only", 1), ("both_ports", 1)])
def test_service_ports(spark, mode, matched):
    df = frame(spark, ["Src Port", "Dst Port"], [("1000", "53"), ("53", "5353"), ("1", "2"), (None, None), ("x", "53"), (None, "7")])
    got = run(df, "service_port_consistency_profile", {"port_fields": ["Src Port", "Dst Port"]}, SERVICE | {"match_mode": mode})
    assert (got["checked_row_count"], got["matching_row_count"], got["mismatching_row_count"], got["missing_port_row_count"], got["invalid_port_row_count"]) == (4, matched, 4 - matched, 1, 1)
    assert (got["checked_port_count"], got["valid_port_count"], got["invalid_port_count"], got["missing_port_count"]) == (9, 8, 1, 3)
    assert got["invalid_port_examples"] == [{"row_index": 4, "field": "Src Port", "value": "x", "reason": "non_integer"}]
    assert got["mismatch_examples"][-1] == {"row_index": 5, "ports": {"Dst Port": 7}, "reason": "expected_service_port_not_found"}


def test_service_demotes_a_pass(spark):
    df = frame(spark, ["Dst Port"], [("53",), ("x",)])
    assert run(df, "service_port_consistency_profile", {"port_fields": ["Dst Port"]}, SERVICE)["status"] == "warn"


@pytest.mark.parametrize("needs, params", [({}, SERVICE), ({"port_fields": ["Dst Port"]}, {}), ({"port_fields": ["Dst Port"]}, {"service_name": "x"}), ({"port_fields": ["Dst Port"]}, SERVICE | {"expected_ports": ["q"]}), ({"port_fields": ["Dst Port"]}, SERVICE | {"match_mode": "no"}), ({"port_fields": ["no"]}, SERVICE), ({"port_fields": ["Dst Port"]}, SERVICE | {"match_mode": "source_only"}), ({"port_fields": ["Dst Port"]}, SERVICE | {"match_mode": "both_ports"}), ({"port_fields": ["Src Port"]}, SERVICE | {"match_mode": "destination_only"})])
def test_service_rejections(spark, needs, params):
    with pytest.raises(Rejected):
        run(frame(spark, ["Dst Port", "Src Port"], [("53", "1")]), "service_port_consistency_profile", needs, params)


FLOW = ["protocol", "total_fwd_packets", "total_bwd_packets", "fin_flag_count", "syn_flag_count", "rst_flag_count", "ack_flag_count"]
MAP = {"field_map": {k: k for k in FLOW}}


def test_tcp_flags(spark):
    df = frame(spark, FLOW, [("6", 2, 1, 0, 1, 0, 2), ("17", 2, 0, 0, 0, 0, 0), ("17", 2, 0, 0, 1, 0, 0), ("6.0", 1, 0, 0, 5, 0, 0), ("tcp", 1, 1, -1, 0, 0, 0), ("6", "x", 1, 0, 0, 0, 0), ("6", 1, 1, 0, "x", 0, 0)])
    got = run(df, "tcp_flag_consistency_profile", MAP)
    assert {k: got[k] for k in ("checked_row_count", "inconsistent_row_count", "tcp_row_count", "non_tcp_row_count", "negative_flag_count", "flag_exceeds_packet_count", "non_tcp_with_tcp_flags_count", "invalid_numeric_row_count")} == {"checked_row_count": 6, "inconsistent_row_count": 4, "tcp_row_count": 5, "non_tcp_row_count": 2, "negative_flag_count": 1, "flag_exceeds_packet_count": 1, "non_tcp_with_tcp_flags_count": 1, "invalid_numeric_row_count": 2}
    assert [(e["row_index"], e["reason"]) for e in got["examples"]] == [(2, "non_tcp_with_tcp_flags"), (3, "invalid_or_out_of_bounds_flags"), (4, "invalid_or_out_of_bounds_flags"), (6, "invalid_or_out_of_bounds_flags")]
    assert run(df, "tcp_flag_consistency_profile", MAP, {"max_examples": 0})["examples"] == []
    with pytest.raises(Rejected):
        run(frame(spark, FLOW, [("6", "x", 1, 0, 0, 0, 0)]), "tcp_flag_consistency_profile", MAP)
    with pytest.raises(Rejected):
        run(df, "tcp_flag_consistency_profile", {"field_map": {"protocol": "protocol"}})


def test_handshakes(spark):
    rows = [("6", 2, 1, 0, 1, 0, 1), ("6", 2, 1, 0, 0, 1, 0), ("6", 1, 0, 0, 1, 0, 0), ("6", 1, 1, 0, 0, 0, 1), ("6", 2, 2, 0, 0, 0, 0), ("6", 1, 0, 0, 0, 0, 0), ("17", 1, 0, 0, 0, 0, 0), ("6", None, 0, 0, 0, 0, 0)]
    df = frame(spark, FLOW, rows)
    got = run(df, "handshake_plausibility_profile", MAP)
    assert (got["tcp_row_count"], got["checked_tcp_row_count"], got["plausible_tcp_row_count"], got["suspicious_tcp_row_count"], got["uncertain_tcp_row_count"]) == (7, 6, 2, 3, 1)
    assert [e["reason"] for e in got["examples"]] == ["syn_only", "ack_without_syn", "no_syn_no_ack_multi_packet"]
    allowed = run(df, "handshake_plausibility_profile", MAP, {"allow_syn_only": True, "allow_rst_flows": False})
    assert (allowed["plausible_tcp_row_count"], allowed["syn_only_count"], allowed["rst_flow_count"]) == (2, 1, 0)
    assert run(frame(spark, FLOW, rows[6:7]), "handshake_plausibility_profile", MAP)["status"] == "not_applicable"


def test_durations(spark):
    fields = ["flow_duration", "flow_iat_mean", "flow_iat_max", "flow_iat_min", "flow_iat_std", "fwd_iat_total"]
    df = frame(spark, fields, [(10, 2, 3, 1, 0, 5), (-1, 2, 3, 1, 0, None), (10, 2, 3, 1, -1, 5), (10, 5, 3, 1, 0, 5), (2, 2, 3, 1, 0, 5), (10, 2, 3, 1, 0, 11), ("x", 1, 1, 1, 1, 1)])
    got = run(df, "flow_duration_consistency_profile", {"field_map": {k: k for k in fields}})
    assert {k: got[k] for k in got if k.endswith("_count")} == {"row_count": 7, "checked_row_count": 6, "consistent_row_count": 1, "inconsistent_row_count": 5, "negative_duration_count": 1, "negative_iat_count": 1, "iat_order_violation_count": 1, "iat_exceeds_duration_count": 2, "direction_iat_exceeds_duration_count": 2, "invalid_numeric_row_count": 1}


def test_bytes(spark):
    from assayer.operators.flows import BYTE_FIELDS, SPREAD_FIELDS

    fields = [*BYTE_FIELDS, *SPREAD_FIELDS]
    good = [2, 1, 100, 50, 20, 50, 60, 40, 50, 60, 2, 4]
    rows = [good, [-1, *good[1:]], [*good[:2], -5, *good[3:]], [*good[:5], 10, *good[6:]], [0, *good[1:]], [*good[:2], 1000, *good[3:]], [*good[:11], 9], [*good[:10], None, 9], [None, *good[1:]]]
    got = run(frame(spark, fields, rows), "packet_byte_consistency_profile", {"field_map": {k: k for k in fields}})
    assert {k: got[k] for k in got if k.endswith("_count")} == {"row_count": 9, "checked_row_count": 8, "consistent_row_count": 2, "inconsistent_row_count": 6, "negative_packet_count": 1, "negative_byte_count": 1, "length_order_violation_count": 1, "zero_packet_nonzero_byte_count": 1, "byte_total_exceeds_max_possible_count": 1, "variance_std_mismatch_count": 1, "invalid_numeric_row_count": 1}


def test_valid_slices(spark):
    df = frame(spark, ["s"], [("Slice1",), (" slice2 ",), ("3",), (None,), ("1.0",), ("other",)])
    params = {"allowed_slice_ids": ["slice1", "slice2", 1], "slice_aliases": {"other": "slice1"}}
    got = run(df, "valid_slice_identifier_profile", {"slice_field": "s"}, params)
    assert (got["checked_slice_count"], got["valid_slice_count"], got["invalid_slice_count"], got["missing_slice_count"]) == (6, 4, 2, 1)
    assert got["observed_slice_ids"] == ["1.0", "3", "slice1", "slice2"] and got["allowed_slice_ids"] == ["1", "slice1", "slice2"]
    assert [(e["row_index"], e["value"], e["reason"]) for e in got["invalid_examples"]] == [(2, "3", "slice_id_not_allowed"), (3, None, "missing_slice_id")]
    skip = run(df, "valid_slice_identifier_profile", {"slice_field": "s"}, params | {"missing_policy": "ignore"})
    assert (skip["checked_slice_count"], len(skip["invalid_examples"])) == (5, 1)
    for needs, p in (({}, params), ({"slice_field": "s"}, {}), ({"slice_field": "no"}, params)):
        with pytest.raises(Rejected):
            run(df, "valid_slice_identifier_profile", needs, p)
    with pytest.raises(Rejected):
        run(frame(spark, ["s"], [(None,)]), "valid_slice_identifier_profile", {"slice_field": "s"}, params | {"missing_policy": "ignore"})


def test_slice_context(spark):
    df = frame(spark, ["s", "f"], [("slice1", "A_slice1"), ("slice2", "A_slice1"), (None, "A_slice1"), ("slice1", "other"), ("slice2", "b"), ("slice9", "b")])
    rules = [{"when_field": "f", "operator": "contains", "value": "SLICE1", "expected_slice_ids": ["slice1"]}, {"when_field": "f", "operator": "in", "value": ["b", "c"], "expected_slice_ids": ["slice2"]}, {"when_field": "no", "operator": "equals", "value": "x", "expected_slice_ids": []}, {"when_field": "f", "operator": "odd", "value": "x", "expected_slice_ids": ["q"]}]
    got = run(df, "slice_identifier_consistency_profile", {"slice_field": "s", "context_fields": ["f", "gone"]}, {"rules": rules})
    assert (got["checked_row_count"], got["consistent_row_count"], got["inconsistent_row_count"], got["missing_slice_count"], got["unmatched_context_row_count"], got["rule_application_count"], got["rule_unavailable_count"]) == (5, 2, 3, 1, 1, 5, 1)
    assert [(r["rule_index"], r["application_count"], r["consistent_count"], r["inconsistent_count"]) for r in got["rules_applied_summary"]] == [(2, 0, 0, 0), (0, 3, 1, 1), (1, 2, 1, 1), (3, 0, 0, 0)]
    assert got["examples"][0] == {"row_index": 1, "observed_slice_id": "slice2", "expected_slice_ids": ["slice1"], "matched_rules": [0], "context": {"f": "A_slice1"}, "reason": "slice_id_does_not_match_expected_context"}
    lone = run(df, "slice_identifier_consistency_profile", {"slice_field": "s"}, {"rules": rules[2:3]})
    assert lone["status"] == "not_applicable" and lone["unmatched_context_row_count"] == 6
