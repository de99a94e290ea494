"""Protocol validity of packets and reserved addresses of flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.addresses import CATEGORIES, category_names, in_category, with_addresses
from assayer.functions.values import any_of, quoted
from assayer.operators.base import Metric, Rejected, count_if, ratio, requirements, rows, total, verdict
from assayer.sources.tabular import ROW_INDEX

# The address columns looked for if a plan names none.
DEFAULT_FIELDS = ("Source IP", "Destination IP", "Src IP", "Dst IP")
EXAMPLES = 20


def protocol_validity(df: DataFrame, spec: dict, src: str = "src", dst: str = "dst", length: str | None = "wire_len", version: str | None = "ip_version") -> Metric:
    """Over packets, or over any frame with two address columns; a packet without IP layer is valid and unchecked."""
    if not {src, dst} <= set(df.columns):
        raise Rejected("Failed to scan PCAP protocol validity: not a packet capture")
    fields = {"source_ip": ("__pv_src", src), "destination_ip": ("__pv_dst", dst)}

    def derive(d):
        return with_addresses(d, {name: quoted(column) for name, column in fields.values()})

    checked = F.col(version).isNotNull() if version else F.lit(True)
    kind = {f: F.col(f"{name}.class") for f, (name, _) in fields.items()}
    empty = F.coalesce(quoted(length) <= 0, F.lit(True)) if length else F.lit(False)
    bad = any_of(checked & (k == "invalid") for k in kind.values())
    counters: dict[str, Column] = {"packet_count": rows(), "zero_length_packet_count": count_if(empty), "valid_packet_count": count_if(~empty & ~bad), "checked_row_count": count_if(checked), "invalid_row_count": count_if(bad)}
    for f, k in kind.items():
        counters |= {f"{f}_{c}": count_if(checked & (k == c)) for c in ("missing", "ipv4", "ipv6", "invalid")}

    def finish(c, tables, examples):
        if not c["packet_count"]:
            raise Rejected("PCAP contains no packets.")
        over = lambda what: sum(c[f"{f}_{what}"] for f in fields)
        n = 2 * c["checked_row_count"]
        valid = ratio(c["valid_packet_count"], c["packet_count"])
        return {
            "packet_count": c["packet_count"], "valid_packet_count": c["valid_packet_count"], "protocol_validity_ratio": valid,
            "invalid_ip_count": over("invalid"), "invalid_port_count": 0, "protocol_mismatch_count": 0,
            "zero_length_packet_count": c["zero_length_packet_count"], "suspicious_tcp_flag_count": 0,
            "checked_row_count": c["checked_row_count"], "checked_address_count": n, "invalid_address_count": over("invalid"),
            "invalid_row_count": c["invalid_row_count"], "invalid_address_ratio": ratio(over("invalid"), n),
            "invalid_row_ratio": ratio(c["invalid_row_count"], c["checked_row_count"]), "missing_address_count": over("missing"),
            "field_counts": {f: {"checked": c["checked_row_count"], "invalid": c[f"{f}_invalid"], "missing": c[f"{f}_missing"]} for f in fields},
            "address_family_counts": {"ipv4": over("ipv4"), "ipv6": over("ipv6"), "unknown": over("missing") + over("invalid")},
            "status": verdict(valid, 0.99, 0.95),
        }

    return Metric(spec["metric_id"], counters, finish, derive)


def reserved_addresses(df: DataFrame, spec: dict) -> Metric:
    """Missing cells count as checked. A row is reserved if any of its addresses is."""
    wanted = requirements(spec).get("candidate_fields") or list(DEFAULT_FIELDS)
    fields = [f for f in wanted if f in df.columns]
    if not fields:
        raise Rejected("No candidate IP fields found in dataset columns.")
    names = [f"__ra_{i}" for i in range(len(fields))]

    def derive(d):
        return with_addresses(d, {name: quoted(f) for name, f in zip(names, fields)})

    kind = [F.col(f"{n}.class") for n in names]
    reserved = [F.coalesce(F.col(f"{n}.mask") > 0, F.lit(False)) for n in names]
    counters: dict[str, Column] = {"row_count": rows(), "reserved_row_count": count_if(any_of(reserved))}
    for i in range(len(fields)):
        counters |= {f"missing_{i}": count_if(kind[i] == "missing"), f"invalid_{i}": count_if(kind[i] == "invalid"), f"ipv4_{i}": count_if(kind[i] == "ipv4"), f"ipv6_{i}": count_if(kind[i] == "ipv6"), f"reserved_{i}": count_if(reserved[i])}
    for c in CATEGORIES:
        counters[f"category_{c}"] = total([count_if(in_category(F.col(f"{n}.mask"), c)) for n in names])

    def cells(d, keep):
        each = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(f).alias("field"), F.col(f"{n}.text").alias("value"), F.col(f"{n}.class").alias("class"), F.col(f"{n}.version").alias("version"), F.col(f"{n}.mask").alias("mask")) for i, (n, f) in enumerate(zip(names, fields))])
        return d.select(ROW_INDEX, F.explode(each).alias("c")).select(ROW_INDEX, "c.*").filter(keep).orderBy(ROW_INDEX, "pos").limit(EXAMPLES).withColumn("categories", category_names(F.col("mask"))).drop("mask")

    def finish(c, tables, examples):
        n, k = c["row_count"], len(fields)
        over = lambda what: sum(c[f"{what}_{i}"] for i in range(k))
        checked = n * k
        summaries = []
        for i, f in enumerate(fields):
            summaries.append({
                "field": f, "exists": True, "checked_address_count": n, "valid_address_count": c[f"ipv4_{i}"] + c[f"ipv6_{i}"],
                "invalid_address_count": c[f"invalid_{i}"], "missing_address_count": c[f"missing_{i}"], "reserved_address_count": c[f"reserved_{i}"],
                "reserved_address_ratio": ratio(c[f"reserved_{i}"], n), "invalid_address_ratio": ratio(c[f"invalid_{i}"], n),
            })
        bad = ratio(over("invalid"), checked)
        return {
            "row_count": n, "checked_fields": fields, "missing_fields": [f for f in wanted if f not in fields],
            "checked_address_count": checked, "valid_address_count": over("ipv4") + over("ipv6"), "invalid_address_count": over("invalid"),
            "missing_address_count": over("missing"), "reserved_address_count": over("reserved"), "reserved_row_count": c["reserved_row_count"],
            "invalid_address_ratio": bad, "reserved_address_ratio": ratio(over("reserved"), checked), "reserved_row_ratio": ratio(c["reserved_row_count"], n),
            "ip_version_counts": {"ipv4": over("ipv4"), "ipv6": over("ipv6")},
            "reserved_category_counts": {x: c[f"category_{x}"] for x in CATEGORIES}, "field_summaries": summaries,
            "reserved_examples": [{"row_index": r[ROW_INDEX], "field": r["field"], "value": r["value"], "version": r["version"], "categories": r["categories"]} for r in examples["reserved"]],
            "invalid_examples": [{"row_index": r[ROW_INDEX], "field": r["field"], "value": r["value"]} for r in examples["invalid"]],
            "status": "fail" if bad > 0.01 else "warn" if over("reserved") or over("invalid") else "pass",
        }

    return Metric(
        spec["metric_id"], counters, finish, derive, row_index=True, extra={"fields": fields},
        examples={"reserved": lambda d: cells(d, F.col("mask") > 0), "invalid": lambda d: cells(d, F.col("class") == "invalid")},
        wanted={"reserved": tuple(f"reserved_{i}" for i in range(len(fields))), "invalid": tuple(f"invalid_{i}" for i in range(len(fields)))},
    )
