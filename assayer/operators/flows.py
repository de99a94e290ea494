"""Consistency of flow records: TCP flags, handshakes, durations, packets and bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.values import all_of, any_of, canonical_code, holds, is_numeric, number, quoted
from assayer.operators.base import Metric, Rejected, count_if, first_rows, mapped_fields, parameters, ratio, rows, verdict

# Logical field names of the metrics' field maps, and protocol codes taken as TCP.
FLAGS = ("fin_flag_count", "syn_flag_count", "rst_flag_count", "ack_flag_count", "psh_flag_count", "urg_flag_count", "cwe_flag_count", "ece_flag_count")
FLAG_FIELDS = ("protocol", "total_fwd_packets", "total_bwd_packets", "fin_flag_count", "syn_flag_count", "rst_flag_count", "ack_flag_count")
HANDSHAKE_FIELDS = ("protocol", "total_fwd_packets", "total_bwd_packets", "syn_flag_count", "ack_flag_count", "rst_flag_count", "fin_flag_count")
DURATION_FIELDS = ("flow_duration", "flow_iat_mean", "flow_iat_max", "flow_iat_min")
DURATION_OPTIONAL = ("flow_iat_std", "fwd_iat_total", "bwd_iat_total")
BYTE_FIELDS = ("total_fwd_packets", "total_bwd_packets", "total_len_fwd_packets", "total_len_bwd_packets", "fwd_pkt_len_min", "fwd_pkt_len_mean", "fwd_pkt_len_max", "bwd_pkt_len_min", "bwd_pkt_len_mean", "bwd_pkt_len_max")
SPREAD_FIELDS = ("packet_length_std", "packet_length_variance")
TCP_CODES = (6, "6", "TCP", "tcp")
# End of fixed values.


def _numbers(prefix: str, fields: dict[str, str]):
    """Derived numeric columns <prefix><key>, and how to name them."""

    def derive(d: DataFrame) -> DataFrame:
        return d.withColumns({f"{prefix}{k}": number(quoted(c), is_numeric(d, c)) for k, c in fields.items()})

    return derive, lambda k: F.col(f"{prefix}{k}")


def _optional(df: DataFrame, fields: dict[str, str], keys) -> dict[str, str]:
    return {k: fields[k] for k in keys if k in fields and fields[k] in df.columns}


def _tcp(fields: dict[str, str], p: dict) -> Column:
    codes = sorted({str(v).lower() for v in p.get("tcp_protocol_values", TCP_CODES)})
    return holds(canonical_code(quoted(fields["protocol"])).isin(codes))


def tcp_flags(df: DataFrame, spec: dict) -> Metric:
    """Flags are no more than packets, not negative, and none without TCP. Rows whose packets are numbers are checked."""
    fields, p = mapped_fields(df, spec, list(FLAG_FIELDS)), parameters(spec)
    flags = _optional(df, fields, FLAGS)
    derive, num = _numbers("__tf_", flags | {k: fields[k] for k in ("total_fwd_packets", "total_bwd_packets")})
    packets = num("total_fwd_packets") + num("total_bwd_packets")
    tcp, checked = _tcp(fields, p), packets.isNotNull()
    negative = any_of(num(k) < 0 for k in flags)
    exceeds = any_of(num(k) > packets for k in flags)
    unread = any_of(num(k).isNull() for k in flags)
    bad = negative | exceeds | unread
    stray = ~tcp & any_of(num(k) > 0 for k in flags) & F.lit(bool(p.get("non_tcp_flags_must_be_zero", True))) & ~bad & checked
    wrong = (bad & checked) | stray
    counters = {
        "row_count": rows(), "checked_row_count": count_if(checked), "inconsistent_row_count": count_if(wrong), "tcp_row_count": count_if(tcp), "negative_flag_count": count_if(negative),
        "flag_exceeds_packet_count": count_if(exceeds), "non_tcp_with_tcp_flags_count": count_if(stray), "invalid_numeric_row_count": count_if(~checked | unread),
    }

    def finish(c, tables, examples):
        n = c["checked_row_count"]
        if not n:
            raise Rejected("No rows could be checked for tcp_flag_consistency_profile.")
        good = n - c["inconsistent_row_count"]
        value = ratio(good, n)
        return {
            "row_count": c["row_count"], "checked_row_count": n, "consistent_row_count": good, "inconsistent_row_count": c["inconsistent_row_count"],
            "tcp_row_count": c["tcp_row_count"], "non_tcp_row_count": c["row_count"] - c["tcp_row_count"], "tcp_flag_consistency_ratio": value,
            "negative_flag_count": c["negative_flag_count"], "flag_exceeds_packet_count": c["flag_exceeds_packet_count"],
            "non_tcp_with_tcp_flags_count": c["non_tcp_with_tcp_flags_count"], "invalid_numeric_row_count": c["invalid_numeric_row_count"],
            "examples": examples["examples"], "status": verdict(value, 0.99, 0.95),
        }

    reason = F.when(stray, "non_tcp_with_tcp_flags").otherwise("invalid_or_out_of_bounds_flags")
    return _row_metric(spec, counters, finish, derive, wrong, reason, p)


def _row_metric(spec: dict, counters: dict, finish, derive, mask: Column, reason: Column, p: dict, counter: str = "inconsistent_row_count") -> Metric:
    examples = {"examples": first_rows(mask, reason, int(p.get("max_examples", 10)))}
    return Metric(spec["metric_id"], counters, finish, derive, examples=examples, wanted={"examples": (counter,)}, row_index=True)


def handshake_class(num, allow_rst: bool) -> Column:
    """rst_flow, syn_ack, syn_only, ack_without_syn, no_syn_no_ack_multi_packet or uncertain; the first that applies."""
    syn, ack, rst = num("syn_flag_count"), num("ack_flag_count"), num("rst_flag_count")
    packets = num("total_fwd_packets") + num("total_bwd_packets")
    return (
        F.when(F.lit(allow_rst) & (rst > 0), "rst_flow")
        .when((syn > 0) & (ack > 0), "syn_ack")
        .when((syn > 0) & (ack == 0), "syn_only")
        .when((ack > 0) & (syn == 0), "ack_without_syn")
        .when((packets > 1) & (syn == 0) & (ack == 0), "no_syn_no_ack_multi_packet")
        .otherwise("uncertain")
    )


def handshakes(df: DataFrame, spec: dict) -> Metric:
    """TCP rows whose six numbers can be read are classed as plausible, suspicious or uncertain."""
    fields, p = mapped_fields(df, spec, list(HANDSHAKE_FIELDS)), parameters(spec)
    keys = [k for k in HANDSHAKE_FIELDS if k != "protocol"]
    allow_syn = bool(p.get("allow_syn_only", False))
    derive, num = _numbers("__hp_", {k: fields[k] for k in keys})
    tcp = _tcp(fields, p)
    checked = tcp & all_of(num(k).isNotNull() for k in keys)
    kind = F.when(checked, handshake_class(num, bool(p.get("allow_rst_flows", True))))
    plausible = ("rst_flow", "syn_ack", *["syn_only"] * allow_syn)
    suspicious = (*["syn_only"] * (not allow_syn), "ack_without_syn", "no_syn_no_ack_multi_packet")
    counters = {
        "row_count": rows(), "tcp_row_count": count_if(tcp), "checked_tcp_row_count": count_if(checked), "plausible_tcp_row_count": count_if(kind.isin(*plausible)),
        "suspicious_tcp_row_count": count_if(kind.isin(*suspicious)), "uncertain_tcp_row_count": count_if(kind == "uncertain"), "syn_only_count": count_if(kind == "syn_only"),
        "syn_ack_like_count": count_if(kind == "syn_ack"), "ack_without_syn_count": count_if(kind == "ack_without_syn"), "rst_flow_count": count_if(kind == "rst_flow"),
    }

    def finish(c, tables, examples):
        value = ratio(c["plausible_tcp_row_count"], c["checked_tcp_row_count"])
        state = verdict(value, 0.95, 0.80) if c["tcp_row_count"] else "not_applicable"
        return {k: c[k] for k in counters} | {"handshake_plausibility_ratio": value, "examples": examples["examples"], "status": state}

    return _row_metric(spec, counters, finish, derive, holds(kind.isin(*suspicious)), kind, p, "suspicious_tcp_row_count")


def flow_durations(df: DataFrame, spec: dict) -> Metric:
    """Durations and inter-arrival times agree. Rows whose four required numbers can be read are checked."""
    fields, p = mapped_fields(df, spec, list(DURATION_FIELDS)), parameters(spec)
    extra = _optional(df, fields, DURATION_OPTIONAL)
    derive, num = _numbers("__fd_", {k: fields[k] for k in DURATION_FIELDS} | extra)
    slack = F.lit(float(p.get("tolerance", 1e-6)))
    duration, mean, most, least = (num(k) for k in DURATION_FIELDS)
    checked = all_of(num(k).isNotNull() for k in DURATION_FIELDS)
    times = [least, mean, most, *[num(k) for k in extra if k == "flow_iat_std"]]
    kinds = {
        "negative_duration_count": checked & holds(duration < 0),
        "negative_iat_count": checked & any_of(t < 0 for t in times),
        "iat_order_violation_count": checked & ~holds((least <= mean) & (mean <= most)),
        "iat_exceeds_duration_count": checked & holds(most > duration + slack),
        "direction_iat_exceeds_duration_count": checked & any_of(num(k) > duration + slack for k in extra if k != "flow_iat_std"),
    }
    return _violations(spec, derive, checked, kinds, "flow_duration_consistency_ratio", "duration_iat_violation", p)


def _violations(spec: dict, derive, checked: Column, kinds: dict[str, Column], name: str, reason: str, p: dict) -> Metric:
    wrong = any_of(kinds.values())
    counters = {"row_count": rows(), "checked_row_count": count_if(checked), "inconsistent_row_count": count_if(wrong)} | {k: count_if(m) for k, m in kinds.items()}

    def finish(c, tables, examples):
        n = c["checked_row_count"]
        good = n - c["inconsistent_row_count"]
        value = ratio(good, n)
        return {
            "row_count": c["row_count"], "checked_row_count": n, "consistent_row_count": good, "inconsistent_row_count": c["inconsistent_row_count"],
            **{k: c[k] for k in kinds}, "invalid_numeric_row_count": c["row_count"] - n, name: value, "examples": examples["examples"], "status": verdict(value, 0.99, 0.95),
        }

    return _row_metric(spec, counters, finish, derive, wrong, F.lit(reason), p)


def packet_bytes(df: DataFrame, spec: dict) -> Metric:
    """Packet counts, byte totals, length orders and variances agree. Rows whose ten required numbers can be read are checked."""
    fields, p = mapped_fields(df, spec, list(BYTE_FIELDS)), parameters(spec)
    spread = _optional(df, fields, SPREAD_FIELDS)
    derive, num = _numbers("__pb_", {k: fields[k] for k in BYTE_FIELDS} | spread)
    slack, spread_slack = F.lit(float(p.get("tolerance", 1e-6))), F.lit(float(p.get("variance_tolerance", 1e-3)))
    checked = all_of(num(k).isNotNull() for k in BYTE_FIELDS)
    ways = [tuple(num(k.format(d)) for k in ("total_{}_packets", "total_len_{}_packets", "{}_pkt_len_min", "{}_pkt_len_mean", "{}_pkt_len_max")) for d in ("fwd", "bwd")]
    kinds = {
        "negative_packet_count": checked & any_of(w[0] < 0 for w in ways),
        "negative_byte_count": checked & any_of(x < 0 for w in ways for x in w[1:]),
        "length_order_violation_count": checked & any_of(~holds((w[2] <= w[3]) & (w[3] <= w[4])) for w in ways),
        "zero_packet_nonzero_byte_count": checked & any_of((w[0] == 0) & (w[1] > 0) for w in ways),
        "byte_total_exceeds_max_possible_count": checked & any_of((w[0] > 0) & (w[1] > w[0] * w[4] + slack) for w in ways),
    }
    if len(spread) == 2:
        std, variance = num("packet_length_std"), num("packet_length_variance")
        off = F.abs(variance - std * std) > F.greatest(spread_slack, F.abs(variance) * spread_slack)
        kinds["variance_std_mismatch_count"] = checked & holds(off)
    else:
        kinds["variance_std_mismatch_count"] = F.lit(False)
    return _violations(spec, derive, checked, kinds, "packet_byte_consistency_ratio", "packet_byte_inconsistency", p)
