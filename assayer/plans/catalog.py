"""Queries over the driver's tables and the DuckDB SQL that must give the same rows.

Flow queries run on a view that derives flow records, texts included, from ``events``; the same SQL
makes it in both engines. Counters are integers; ratios are left to the metrics' finish.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.addresses import CATEGORIES, IPV4_BLOCKS, IPV4_EXCEPTIONS, IPV4_PATTERN
from assayer.functions.values import number, port_class, port_status, port_value
from assayer.operators.base import Metric
from assayer.operators.columns import field_facts, pearson_pairs, quality_fields
from assayer.operators.flows import FLAGS
from assayer.operators.timestamps import gap_facts
from assayer.plans import export
from assayer.plans.registry import build_metric
from assayer.sources.tabular import ROW_INDEX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

FLOWS = """
SELECT event_id AS row_index,
  CASE event_id % 18 WHEN 0 THEN concat('10.0.', user_id % 256, '.', event_id % 256) WHEN 1 THEN '8.8.8.8'
    WHEN 2 THEN '192.0.2.7' WHEN 3 THEN '100.64.0.1' WHEN 4 THEN '198.18.0.1' WHEN 5 THEN '127.0.0.1'
    WHEN 6 THEN '169.254.1.1' WHEN 7 THEN '224.0.0.1' WHEN 8 THEN '240.0.0.1' WHEN 9 THEN '0.0.0.0'
    WHEN 10 THEN '256.1.1.1' WHEN 11 THEN '' WHEN 12 THEN NULL WHEN 13 THEN '01.2.3.4'
    WHEN 14 THEN ' 172.16.5.4 ' WHEN 15 THEN '1.1.1' WHEN 16 THEN '2600::1' ELSE ' ::1 ' END AS src_ip,
  CASE event_id % 17 WHEN 0 THEN '8.8.4.4' WHEN 1 THEN '192.168.1.1' WHEN 2 THEN '203.0.113.9' WHEN 3 THEN '192.0.0.9' WHEN 4 THEN '::1' WHEN 5 THEN ' fe80::1%eth0'
    WHEN 6 THEN '::ffff:10.0.0.1' WHEN 7 THEN '::ffff:8.8.8.8' WHEN 8 THEN 'fd00::1' WHEN 9 THEN '2001:db8::1' WHEN 10 THEN 'ff02::1' WHEN 11 THEN '2600::1' WHEN 12 THEN '::'
    WHEN 13 THEN '3fff::1' WHEN 14 THEN 'gggg::1' WHEN 15 THEN NULL ELSE '198.51.100.3' END AS dst_ip,
  CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'abc' WHEN 3 THEN '80.5' WHEN 4 THEN '70000' WHEN 5 THEN '-1' WHEN 6 THEN '80.0' WHEN 7 THEN '1e3' WHEN 8 THEN '0' ELSE CAST(event_id * 7919 % 65536 AS STRING) END AS src_port,
  CASE event_id % 13 WHEN 0 THEN NULL WHEN 1 THEN '53' WHEN 2 THEN ' 53 ' WHEN 3 THEN '443' WHEN 4 THEN '0' WHEN 5 THEN '8080' WHEN 6 THEN 'x' WHEN 7 THEN '99999' ELSE CAST(49152 + event_id % 1000 AS STRING) END AS dst_port,
  CASE event_id % 4 WHEN 0 THEN '17' WHEN 1 THEN 'TCP' ELSE '6' END AS protocol,
  CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 101 = 0 THEN '-2' ELSE CAST(event_id % 6 AS STRING) END AS total_fwd_packets,
  CAST(user_id % 4 AS STRING) AS total_bwd_packets,
  CASE WHEN event_id % 29 = 0 THEN 'x' WHEN event_id % 31 = 0 THEN '-1' ELSE CAST((event_id + 1) % 3 AS STRING) END AS syn_flag_count,
  CAST(event_id % 2 AS STRING) AS ack_flag_count,
  CASE WHEN event_id % 13 = 0 THEN '1' ELSE '0' END AS rst_flag_count,
  CASE WHEN event_id % 17 = 0 THEN '1' ELSE '0' END AS fin_flag_count,
  CASE WHEN event_id % 67 = 0 THEN '9' ELSE '0' END AS psh_flag_count,
  CASE WHEN event_id % 71 = 0 THEN '-1' ELSE '0' END AS urg_flag_count,
  CASE WHEN event_id % 73 = 0 THEN NULL ELSE '0' END AS cwe_flag_count,
  CASE WHEN event_id % 19 = 0 THEN ' 1 ' ELSE '0' END AS ece_flag_count,
  CASE WHEN event_id % 97 = 0 THEN -1.0e0 ELSE value * 10 END AS flow_duration,
  CASE WHEN event_id % 79 = 0 THEN NULL ELSE value END AS flow_iat_mean,
  CASE WHEN event_id % 41 = 0 THEN value * 11 ELSE value * 2 END AS flow_iat_max,
  CASE WHEN event_id % 43 = 0 THEN value * 3 WHEN event_id % 89 = 0 THEN -1.0e0 ELSE CAST(0 AS DOUBLE) END AS flow_iat_min,
  CASE WHEN event_id % 103 = 0 THEN -1.0e0 WHEN event_id % 107 = 0 THEN NULL ELSE value END AS flow_iat_std,
  CASE WHEN event_id % 83 = 0 THEN value * 20 ELSE value END AS fwd_iat_total,
  CASE WHEN event_id % 109 = 0 THEN value * 30 WHEN event_id % 113 = 0 THEN NULL ELSE value END AS bwd_iat_total,
  CASE event_id % 9 WHEN 0 THEN 'Slice1' WHEN 1 THEN ' slice2 ' WHEN 2 THEN 'slice3' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN '1.0' WHEN 6 THEN '1' ELSE 'slice2' END AS slice,
  CASE user_id % 4 WHEN 0 THEN 'cap_slice1.csv' WHEN 1 THEN 'CAP_SLICE2.csv' WHEN 2 THEN ' Other.csv ' ELSE 'nothing' END AS source_file,
  CASE WHEN event_id % 37 = 0 THEN 1.0e6 WHEN event_id % 53 = 0 THEN -1.0e0 ELSE CAST((event_id % 6) * 50 AS DOUBLE) END AS total_len_fwd_packets,
  CASE WHEN user_id % 4 = 0 AND event_id % 19 <> 0 THEN CAST(0 AS DOUBLE) ELSE CAST(40 AS DOUBLE) END AS total_len_bwd_packets,
  CAST(20 AS DOUBLE) AS fwd_pkt_len_min,
  CASE WHEN event_id % 47 = 0 THEN 1.0e1 ELSE 5.0e1 END AS fwd_pkt_len_mean,
  CAST(100 AS DOUBLE) AS fwd_pkt_len_max,
  CAST(0 AS DOUBLE) AS bwd_pkt_len_min, CAST(30 AS DOUBLE) AS bwd_pkt_len_mean, CAST(60 AS DOUBLE) AS bwd_pkt_len_max,
  CASE WHEN event_id % 59 = 0 THEN NULL ELSE 1.0e1 END AS packet_length_std,
  CASE WHEN event_id % 61 = 0 THEN 1.1e2 ELSE 1.0e2 END AS packet_length_variance
FROM events
"""
QUALITY_FIELDS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "no_such_column"]
PAIR_FIELDS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SPECS = {
    "protocol_validity_profile": {},
    "reserved_ip_address_profile": {"input_requirements": {"candidate_fields": ["src_ip", "dst_ip", "gone_ip"]}},
    "valid_port_range_profile": {"input_requirements": {"candidate_fields": ["src_port", "dst_port", "gone_port"]}},
    "tcp_flag_consistency_profile": {"input_requirements": {"field_map": {k: k for k in ("protocol", "total_fwd_packets", "total_bwd_packets", *FLAGS)}}},
    "handshake_plausibility_profile": {"input_requirements": {"field_map": {k: k for k in ("protocol", "total_fwd_packets", "total_bwd_packets", "fin_flag_count", "syn_flag_count", "rst_flag_count", "ack_flag_count")}}},
    "flow_duration_consistency_profile": {"input_requirements": {"field_map": {k: k for k in ("flow_duration", "flow_iat_mean", "flow_iat_max", "flow_iat_min", "flow_iat_std", "fwd_iat_total", "bwd_iat_total")}}},
    "packet_byte_consistency_profile": {"input_requirements": {"field_map": {k: k for k in ("total_fwd_packets", "total_bwd_packets", "total_len_fwd_packets", "total_len_bwd_packets", "fwd_pkt_len_min", "fwd_pkt_len_mean", "fwd_pkt_len_max", "bwd_pkt_len_min", "bwd_pkt_len_mean", "bwd_pkt_len_max", "packet_length_std", "packet_length_variance")}}},
    "valid_slice_identifier_profile": {"input_requirements": {"slice_field": "slice"}, "calculation": {"parameters": {"allowed_slice_ids": ["slice1", "slice2", 1]}}},
    "slice_identifier_consistency_profile": {
        "input_requirements": {"slice_field": "slice", "context_fields": ["source_file"]},
        "calculation": {"parameters": {"rules": [
            {"when_field": "source_file", "operator": "contains", "value": "slice1", "expected_slice_ids": ["slice1", "1"]},
            {"when_field": "source_file", "operator": "starts_with", "value": "cap_slice2", "expected_slice_ids": ["slice2"]},
            {"when_field": "no_field", "operator": "equals", "value": "x", "expected_slice_ids": ["slice1"]},
            {"when_field": "source_file", "operator": "equals", "value": "OTHER.csv", "expected_slice_ids": ["slice3", "Slice2"]},
            {"when_field": "source_file", "operator": "ends_with", "value": "2.CSV", "expected_slice_ids": ["slice2", "1.0"]},
            {"when_field": "protocol", "operator": "in", "value": ["udp", 17], "expected_slice_ids": ["slice2"]},
        ]}},
    },
}


def service_spec(mode: str) -> dict:
    return {"metric_id": "service_port_consistency_profile", "input_requirements": {"port_fields": ["src_port", "dst_port"]}, "calculation": {"parameters": {"service_name": "dns", "expected_ports": [53, 80], "match_mode": mode}}}


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FLOWS.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def flow_metric(spark: SparkSession, sf_dir: str, metric_id: str) -> tuple[DataFrame, Metric]:
    df = flows(spark, sf_dir)
    return df, build_metric(df, {"metric_id": metric_id} | SPECS[metric_id])


def _counts_as_bigint(sql: str) -> str:
    """``count_if`` has a wider type in DuckDB than a count has: write it as a filtered count."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + len('count_if('):end - 1]}){sql[end:]}"
    return sql


def query(name: str, sql: str | None = None):
    """Register a query and its SQL; ``flows`` in the SQL stands for the flow view."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            text = _counts_as_bigint(sql)
            ORACLE_SQL[name] = f"WITH flows AS ({FLOWS}){',' if text.lstrip().startswith('+') else ''}\n{text.lstrip().removeprefix('+')}" if "flows" in text else text
        return fn

    return add


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


# Values and their aggregates


_QUALITY = " UNION ALL ".join(
    f"SELECT {i} AS pos, '{f}' AS field, {'true' if f != 'no_such_column' else 'false'} AS \"exists\", count(*) AS row_count, "
    + ("CAST(0 AS BIGINT) AS non_null_count, CAST(0 AS BIGINT) AS numeric_non_null_count, CAST(0 AS BIGINT) AS unique_count" if f == "no_such_column" else f"count({f}) AS non_null_count, count(try_cast({f} AS DOUBLE)) AS numeric_non_null_count, count(DISTINCT try_cast({f} AS DOUBLE)) AS unique_count")
    + " FROM lineitem"
    for i, f in enumerate(QUALITY_FIELDS)
)
_QUALITY_FLAGS = f"""SELECT CAST(pos AS INTEGER) AS pos, * EXCLUDE (pos),
  numeric_non_null_count > 0 AND unique_count < 2 AS constant_column, numeric_non_null_count >= 2 AND unique_count >= 2 AS usable_for_analysis,
  CASE WHEN NOT "exists" THEN 'missing_column' WHEN non_null_count = 0 THEN 'empty_column' WHEN numeric_non_null_count = 0 THEN 'non_numeric'
    WHEN numeric_non_null_count < 2 THEN 'insufficient_numeric_values' WHEN unique_count < 2 THEN 'constant_column' ELSE 'usable' END AS reason
FROM ({_QUALITY})"""


@query("column_quality_fields", _QUALITY_FLAGS)
def column_quality_fields(spark, sf_dir):
    return quality_fields(lineitem(spark, sf_dir), QUALITY_FIELDS)


@query("column_quality_summary", f"SELECT count(*) AS field_count, count_if(usable_for_analysis) AS usable_field_count, count_if(constant_column) AS constant_field_count, count_if(NOT \"exists\") AS missing_field_count FROM ({_QUALITY_FLAGS})")
def column_quality_summary(spark, sf_dir):
    f = quality_fields(lineitem(spark, sf_dir), QUALITY_FIELDS)
    return f.agg(F.count(F.lit(1)).alias("field_count"), F.count_if("usable_for_analysis").alias("usable_field_count"), F.count_if("constant_column").alias("constant_field_count"), F.count_if(~F.col("exists")).alias("missing_field_count"))


def _count_query(name: str, sql: str, column) -> None:
    @query(name, f"SELECT {sql} AS n FROM lineitem")
    def fn(spark, sf_dir):
        return lineitem(spark, sf_dir).agg(F.count(column()).alias("n"))


_count_query("agg_row_count", "count(*)", lambda: F.lit(1))
_count_query("agg_non_null", "count(l_returnflag)", lambda: F.col("l_returnflag"))


@query("agg_numeric_non_null", "SELECT count(try_cast(trim(src_port) AS DOUBLE)) AS n FROM flows")
def agg_numeric_non_null(spark, sf_dir):
    return flows(spark, sf_dir).agg(F.count(number(F.col("src_port"))).alias("n"))


@query("agg_numeric_distinct", "SELECT 'l_quantity' AS field, count(DISTINCT l_quantity) AS unique_count FROM lineitem UNION ALL SELECT 'l_discount', count(DISTINCT l_discount) FROM lineitem")
def agg_numeric_distinct(spark, sf_dir):
    return field_facts(lineitem(spark, sf_dir), ["l_quantity", "l_discount"]).select("field", "unique_count")


_PAIRS = [(a, b) for i, a in enumerate(PAIR_FIELDS) for b in PAIR_FIELDS[i + 1 :]]


@query("pearson_pairs", " UNION ALL ".join(f"SELECT '{a}' AS field_a, '{b}' AS field_b, round(corr({a}, {b}), 6) AS value, count_if({a} IS NOT NULL AND {b} IS NOT NULL) AS overlap_non_null_count FROM lineitem" for a, b in _PAIRS))
def pearson_pairs_query(spark, sf_dir):
    return pearson_pairs(lineitem(spark, sf_dir), PAIR_FIELDS).withColumn("value", F.round("value", 6))


@query("pearson_summary", "SELECT count(*) AS pair_count, round(avg(abs(v)), 5) AS mean_absolute_correlation FROM (" + " UNION ALL ".join(f"SELECT round(corr({a}, {b}), 6) AS v FROM lineitem" for a, b in _PAIRS) + ")")
def pearson_summary(spark, sf_dir):
    return pearson_pairs(lineitem(spark, sf_dir), PAIR_FIELDS).agg(F.count(F.lit(1)).alias("pair_count"), F.round(F.avg(F.abs(F.round("value", 6))), 5).alias("mean_absolute_correlation"))


@query("pearson_validation", f"SELECT field, \"exists\", numeric_non_null_count, unique_count AS numeric_unique_count, usable_for_analysis AS usable_for_pearson, CASE WHEN reason = 'empty_column' THEN 'non_numeric' ELSE reason END AS reason FROM ({_QUALITY_FLAGS})")
def pearson_validation(spark, sf_dir):
    f = quality_fields(lineitem(spark, sf_dir), QUALITY_FIELDS)
    reason = F.when(F.col("reason") == "empty_column", "non_numeric").otherwise(F.col("reason"))
    return f.select("field", "exists", "numeric_non_null_count", F.col("unique_count").alias("numeric_unique_count"), F.col("usable_for_analysis").alias("usable_for_pearson"), reason.alias("reason"))


_CLOCK = "CASE WHEN event_id % 17 = 0 THEN {0} - 7200000000 ELSE {0} - {0} % 300000000 END"
_GAP = f"SELECT event_id, t, t - lag(t) OVER (ORDER BY event_id) AS d FROM (SELECT event_id, {_CLOCK.format('epoch_us(ts)')} AS t FROM events)"


@query("timestamp_coherence", f"""SELECT count(*) AS packet_count, arg_min(t, event_id) AS first_timestamp, arg_max(t, event_id) AS last_timestamp,
  count_if(d < 0) AS backwards_jump_count, count_if(d = 0) AS zero_delta_count, count_if(d > 3600000000) AS large_gap_count, count_if(d >= 0) AS gap_count,
  CAST(sum(CASE WHEN d >= 0 THEN d END) AS BIGINT) AS gap_sum, max(CASE WHEN d >= 0 THEN d END) AS gap_max FROM ({_GAP})""")
def timestamp_coherence(spark, sf_dir):
    """Whole microseconds, so that sums are exact; cut to five minutes, and two hours back now and then."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"{_CLOCK.format('unix_micros(CAST(ts AS TIMESTAMP))')} AS t")
    return gap_facts(events, "event_id", "t", 3_600_000_000, chunk=4096)


@query("num_coerce", """SELECT row_index, try_cast(trim(src_port) AS DOUBLE) AS src_number, try_cast(trim(syn_flag_count) AS DOUBLE) AS syn_number FROM flows""")
def num_coerce(spark, sf_dir):
    return flows(spark, sf_dir).select(ROW_INDEX, number(F.col("src_port")).alias("src_number"), number(F.col("syn_flag_count")).alias("syn_number"))


def _port_sql(c: str) -> tuple[str, str]:
    d = f"try_cast(trim({c}) AS DOUBLE)"
    status = f"CASE WHEN {c} IS NULL OR trim({c}) = '' OR lower(trim({c})) = 'nan' THEN 'missing' WHEN {d} IS NULL OR floor({d}) <> {d} THEN 'non_integer' WHEN {d} BETWEEN 0 AND 65535 THEN 'valid' ELSE 'out_of_range' END"
    return status, f"CASE WHEN {status} = 'valid' THEN CAST({d} AS INTEGER) END"


_SRC_S, _SRC_P = _port_sql("src_port")
_DST_S, _DST_P = _port_sql("dst_port")
_PORTS = f"+ports AS (SELECT *, {_SRC_S} AS ss, {_SRC_P} AS sp, {_DST_S} AS ds, {_DST_P} AS dp FROM flows)"


@query("port_parse", f"{_PORTS} SELECT row_index, ss AS src_status, sp AS src_value, ds AS dst_status, dp AS dst_value FROM ports")
def port_parse(spark, sf_dir):
    return flows(spark, sf_dir).select(ROW_INDEX, port_status(F.col("src_port")).alias("src_status"), port_value(F.col("src_port")).alias("src_value"), port_status(F.col("dst_port")).alias("dst_status"), port_value(F.col("dst_port")).alias("dst_value"))


@query("port_range_class", f"{_PORTS} SELECT CASE WHEN sp <= 1023 THEN 'well_known' WHEN sp <= 49151 THEN 'registered' WHEN sp IS NOT NULL THEN 'dynamic_private' END AS port_range, count(*) AS n FROM ports GROUP BY 1")
def port_range_class(spark, sf_dir):
    return flows(spark, sf_dir).groupBy(port_class(port_value(F.col("src_port"))).alias("port_range")).agg(F.count(F.lit(1)).alias("n"))


# Metrics on the flow view


def counters_query(name: str, metric_id: str, sql: str) -> None:
    def fn(spark, sf_dir):
        df, metric = flow_metric(spark, sf_dir, metric_id)
        return metric.counts(df)

    query(name, sql)(fn)


def example_query(name: str, metric_id: str, which: str, sql: str, shape: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    def fn(spark, sf_dir):
        df, metric = flow_metric(spark, sf_dir, metric_id)
        return shape(metric.example(df, which))

    query(name, sql)(fn)


_PORT_CLASSES = {"well_known": "BETWEEN 0 AND 1023", "registered": "BETWEEN 1024 AND 49151", "dynamic_private": "BETWEEN 49152 AND 65535"}
_PORT_COLUMNS = ", ".join(
    f"count_if({s} = '{x}') AS {x}_{i}" for i, s in enumerate(("ss", "ds")) for x in ("missing", "valid", "non_integer", "out_of_range")
) + ", " + ", ".join(f"count_if({p} = 0) AS zero_{i}" for i, p in enumerate(("sp", "dp"))) + ", " + ", ".join(f"count_if({p} {r}) AS {c}_{i}" for i, p in enumerate(("sp", "dp")) for c, r in _PORT_CLASSES.items())
_BAD = "ss IN ('non_integer', 'out_of_range')", "ds IN ('non_integer', 'out_of_range')"
counters_query("valid_port_range", "valid_port_range_profile", f"{_PORTS} SELECT count(*) AS row_count, count_if({_BAD[0]} OR {_BAD[1]}) AS invalid_row_count, {_PORT_COLUMNS} FROM ports")


@query("valid_port_range_fields", f"{_PORTS} " + " UNION ALL ".join(f"SELECT '{f}' AS field, count_if({s} <> 'missing') AS checked_port_count, count_if({s} = 'valid') AS valid_port_count, count_if({s} IN ('non_integer', 'out_of_range')) AS invalid_port_count, count_if({s} = 'missing') AS missing_port_count, count_if({p} = 0) AS zero_port_count FROM ports" for f, s, p in (("src_port", "ss", "sp"), ("dst_port", "ds", "dp"))))
def valid_port_range_fields(spark, sf_dir):
    df, metric = flow_metric(spark, sf_dir, "valid_port_range_profile")
    each = [
        F.struct(F.lit(f).alias("field"), *[c.alias(n) for n, c in {
            "checked_port_count": F.col(f"valid_{i}") + F.col(f"non_integer_{i}") + F.col(f"out_of_range_{i}"), "valid_port_count": F.col(f"valid_{i}"),
            "invalid_port_count": F.col(f"non_integer_{i}") + F.col(f"out_of_range_{i}"), "missing_port_count": F.col(f"missing_{i}"), "zero_port_count": F.col(f"zero_{i}"),
        }.items()])
        for i, f in enumerate(metric.extra["fields"])
    ]
    return metric.counts(df).select(F.inline(F.array(*each)))


_CELLS = "SELECT row_index, {0} AS pos, '{1}' AS field, trim({1}) AS value, {2} AS reason FROM ports WHERE {2} IN ('non_integer', 'out_of_range')"
_PORT_CELLS = " UNION ALL ".join(_CELLS.format(i, f, s) for i, (f, s) in enumerate((("src_port", "ss"), ("dst_port", "ds"))))
example_query("valid_port_range_examples", "valid_port_range_profile", "invalid", f"{_PORTS} SELECT row_index, field, value, reason FROM ({_PORT_CELLS}) ORDER BY pos, row_index LIMIT 10", lambda d: d.drop("pos"))

_NONE, _ANY_BAD = "(ss = 'missing' AND ds = 'missing')", f"({_BAD[0]} OR {_BAD[1]})"
_MATCH = {"any_port": "(coalesce(sp IN (53, 80), false) OR coalesce(dp IN (53, 80), false))", "destination_only": "coalesce(dp IN (53, 80), false)", "source_only": "coalesce(sp IN (53, 80), false)", "both_ports": "(coalesce(sp IN (53, 80), false) AND coalesce(dp IN (53, 80), false))"}
_CHECKED = f"(NOT {_NONE} AND NOT {_ANY_BAD})"


def _service(name: str, mode: str) -> None:
    m = _MATCH[mode]
    sql = f"""{_PORTS} SELECT count(*) AS row_count, count_if({_CHECKED}) AS checked_row_count, count_if({_CHECKED} AND {m}) AS matching_row_count,
      count_if({_CHECKED} AND NOT {m}) AS mismatching_row_count, count_if({_NONE}) AS missing_port_row_count, count_if(NOT {_NONE} AND {_ANY_BAD}) AS invalid_port_row_count,
      count_if(ss = 'missing') AS missing_0, count_if(ss = 'valid') AS valid_0, count_if(ds = 'missing') AS missing_1, count_if(ds = 'valid') AS valid_1 FROM ports"""

    @query(name, sql)
    def fn(spark, sf_dir):
        df = flows(spark, sf_dir)
        return build_metric(df, service_spec(mode)).counts(df)


for _name, _mode in (("service_port_any", "any_port"), ("service_port_destination", "destination_only"), ("service_port_source", "source_only"), ("service_port_both", "both_ports")):
    _service(_name, _mode)


@query("service_port_examples", f"""{_PORTS} SELECT row_index, CASE WHEN ss = 'valid' THEN sp END AS src_port, CASE WHEN ds = 'valid' THEN dp END AS dst_port
  FROM ports WHERE {_CHECKED} AND NOT {_MATCH['any_port']} ORDER BY row_index LIMIT 10""")
def service_port_examples(spark, sf_dir):
    """Ports of the first rows that don't match."""
    df = flows(spark, sf_dir)
    found = build_metric(df, service_spec("any_port")).example(df, "mismatch")
    at = lambda f: F.get(F.filter("ports", lambda p: p["field"] == f), F.lit(0))["port"].alias(f)
    return found.select(ROW_INDEX, at("src_port"), at("dst_port"))


@query("service_port_invalid_examples", f"""{_PORTS}, f AS (SELECT * FROM ports WHERE NOT {_NONE} AND {_ANY_BAD} ORDER BY row_index LIMIT 10)
  SELECT row_index, field, value, reason FROM (""" + " UNION ALL ".join(f"SELECT row_index, {i} AS pos, '{f}' AS field, trim({f}) AS value, {c} AS reason FROM f WHERE {c} IN ('non_integer', 'out_of_range')" for i, (f, c) in enumerate((("src_port", "ss"), ("dst_port", "ds")))) + ") ORDER BY row_index, pos LIMIT 10")
def service_port_invalid_examples(spark, sf_dir):
    df = flows(spark, sf_dir)
    return build_metric(df, service_spec("any_port")).example(df, "invalid").select(ROW_INDEX, "field", "value", "reason")


def _n(c: str) -> str:
    return f"try_cast(trim(CAST({c} AS VARCHAR)) AS DOUBLE)"


_FLOW_NUMBERS = "+n AS (SELECT *, lower(trim(protocol)) IN ('6', 'tcp') AS tcp, " + ", ".join(f"{_n(c)} AS n_{c[:3]}" for c in FLAGS) + f", {_n('total_fwd_packets')} AS fwd, {_n('total_bwd_packets')} AS bwd, {_n('total_fwd_packets')} + {_n('total_bwd_packets')} AS packets FROM flows)"
_NEG = " OR ".join(f"coalesce(n_{f[:3]} < 0, false)" for f in FLAGS)
_EXC = " OR ".join(f"coalesce(n_{f[:3]} > packets, false)" for f in FLAGS)
_UNREAD = " OR ".join(f"n_{f[:3]} IS NULL" for f in FLAGS)
_POS = " OR ".join(f"coalesce(n_{f[:3]} > 0, false)" for f in FLAGS)
_FLAG_MASKS = f"{_FLOW_NUMBERS}, m AS (SELECT *, ({_NEG}) AS neg, ({_EXC}) AS exc, ({_UNREAD}) AS unread, ({_POS}) AS pos, packets IS NOT NULL AS checked FROM n), w AS (SELECT *, (NOT tcp AND pos AND NOT (neg OR exc OR unread) AND checked) AS stray, ((neg OR exc OR unread) AND checked) AS bad FROM m)"
counters_query("tcp_flag_consistency", "tcp_flag_consistency_profile", f"""{_FLAG_MASKS} SELECT count(*) AS row_count, count_if(checked) AS checked_row_count, count_if(bad OR stray) AS inconsistent_row_count, count_if(tcp) AS tcp_row_count,
  count_if(neg) AS negative_flag_count, count_if(exc) AS flag_exceeds_packet_count, count_if(stray) AS non_tcp_with_tcp_flags_count, count_if(NOT checked OR unread) AS invalid_numeric_row_count FROM w""")
example_query("tcp_flag_examples", "tcp_flag_consistency_profile", "examples", f"{_FLAG_MASKS} SELECT row_index, CASE WHEN stray THEN 'non_tcp_with_tcp_flags' ELSE 'invalid_or_out_of_bounds_flags' END AS reason FROM w WHERE bad OR stray ORDER BY row_index LIMIT 10")

_SHAKES = f"""{_FLOW_NUMBERS}, k AS (SELECT *, tcp AND fwd IS NOT NULL AND bwd IS NOT NULL AND n_fin IS NOT NULL AND n_syn IS NOT NULL AND n_rst IS NOT NULL AND n_ack IS NOT NULL AS checked FROM n),
c AS (SELECT *, CASE WHEN NOT checked THEN NULL WHEN n_rst > 0 THEN 'rst_flow' WHEN n_syn > 0 AND n_ack > 0 THEN 'syn_ack' WHEN n_syn > 0 AND n_ack = 0 THEN 'syn_only'
  WHEN n_ack > 0 AND n_syn = 0 THEN 'ack_without_syn' WHEN packets > 1 AND n_syn = 0 AND n_ack = 0 THEN 'no_syn_no_ack_multi_packet' ELSE 'uncertain' END AS kind FROM k)"""
_SUSPECT = "kind IN ('syn_only', 'ack_without_syn', 'no_syn_no_ack_multi_packet')"
counters_query("handshake_plausibility", "handshake_plausibility_profile", f"""{_SHAKES} SELECT count(*) AS row_count, count_if(tcp) AS tcp_row_count, count_if(checked) AS checked_tcp_row_count,
  count_if(kind IN ('rst_flow', 'syn_ack')) AS plausible_tcp_row_count, count_if({_SUSPECT}) AS suspicious_tcp_row_count, count_if(kind = 'uncertain') AS uncertain_tcp_row_count,
  count_if(kind = 'syn_only') AS syn_only_count, count_if(kind = 'syn_ack') AS syn_ack_like_count, count_if(kind = 'ack_without_syn') AS ack_without_syn_count, count_if(kind = 'rst_flow') AS rst_flow_count FROM c""")
example_query("handshake_examples", "handshake_plausibility_profile", "examples", f"{_SHAKES} SELECT row_index, kind AS reason FROM c WHERE {_SUSPECT} ORDER BY row_index LIMIT 10")



@query("handshake_other_policy", f"""{_SHAKES.replace("WHEN n_rst > 0 THEN 'rst_flow' ", "")} SELECT count(*) AS row_count, count_if(tcp) AS tcp_row_count, count_if(checked) AS checked_tcp_row_count,
  count_if(kind IN ('syn_only', 'syn_ack')) AS plausible_tcp_row_count, count_if(kind IN ('ack_without_syn', 'no_syn_no_ack_multi_packet')) AS suspicious_tcp_row_count, count_if(kind = 'uncertain') AS uncertain_tcp_row_count,
  count_if(kind = 'syn_only') AS syn_only_count, count_if(kind = 'syn_ack') AS syn_ack_like_count, count_if(kind = 'ack_without_syn') AS ack_without_syn_count, CAST(0 AS BIGINT) AS rst_flow_count FROM c""")
def handshake_other_policy(spark, sf_dir):
    """A lone SYN is plausible, a reset is nothing of its own."""
    df = flows(spark, sf_dir)
    spec = {"metric_id": "handshake_plausibility_profile", "calculation": {"parameters": {"allow_syn_only": True, "allow_rst_flows": False}}}
    return build_metric(df, spec | SPECS["handshake_plausibility_profile"]).counts(df)


_DURATIONS = """+v AS (SELECT *, flow_duration IS NOT NULL AND flow_iat_mean IS NOT NULL AND flow_iat_max IS NOT NULL AND flow_iat_min IS NOT NULL AS checked FROM flows),
w AS (SELECT *, checked AND flow_duration < 0 AS k0, checked AND (flow_iat_min < 0 OR flow_iat_mean < 0 OR flow_iat_max < 0 OR coalesce(flow_iat_std < 0, false)) AS k1,
  checked AND NOT (flow_iat_min <= flow_iat_mean AND flow_iat_mean <= flow_iat_max) AS k2, checked AND flow_iat_max > flow_duration + 1e-6 AS k3,
  checked AND (coalesce(fwd_iat_total > flow_duration + 1e-6, false) OR coalesce(bwd_iat_total > flow_duration + 1e-6, false)) AS k4 FROM v)"""
counters_query("flow_duration_consistency", "flow_duration_consistency_profile", f"""{_DURATIONS} SELECT count(*) AS row_count, count_if(checked) AS checked_row_count, count_if(k0 OR k1 OR k2 OR k3 OR k4) AS inconsistent_row_count, count_if(k0) AS negative_duration_count,
  count_if(k1) AS negative_iat_count, count_if(k2) AS iat_order_violation_count, count_if(k3) AS iat_exceeds_duration_count, count_if(k4) AS direction_iat_exceeds_duration_count FROM w""")
example_query("flow_duration_examples", "flow_duration_consistency_profile", "examples", f"{_DURATIONS} SELECT row_index, 'duration_iat_violation' AS reason FROM w WHERE k0 OR k1 OR k2 OR k3 OR k4 ORDER BY row_index LIMIT 10")

_BYTES = f"""+v AS (SELECT *, {_n('total_fwd_packets')} AS fp, {_n('total_bwd_packets')} AS bp FROM flows),
c AS (SELECT *, fp IS NOT NULL AND bp IS NOT NULL AS checked FROM v),
w AS (SELECT *, checked AND (fp < 0 OR bp < 0) AS k0,
  checked AND least(total_len_fwd_packets, total_len_bwd_packets, fwd_pkt_len_min, fwd_pkt_len_mean, fwd_pkt_len_max, bwd_pkt_len_min, bwd_pkt_len_mean, bwd_pkt_len_max) < 0 AS k1,
  checked AND (NOT (fwd_pkt_len_min <= fwd_pkt_len_mean AND fwd_pkt_len_mean <= fwd_pkt_len_max) OR NOT (bwd_pkt_len_min <= bwd_pkt_len_mean AND bwd_pkt_len_mean <= bwd_pkt_len_max)) AS k2,
  checked AND ((fp = 0 AND total_len_fwd_packets > 0) OR (bp = 0 AND total_len_bwd_packets > 0)) AS k3,
  checked AND ((fp > 0 AND total_len_fwd_packets > fp * fwd_pkt_len_max + 1e-6) OR (bp > 0 AND total_len_bwd_packets > bp * bwd_pkt_len_max + 1e-6)) AS k4,
  checked AND coalesce(abs(packet_length_variance - packet_length_std * packet_length_std) > greatest(1e-3, abs(packet_length_variance) * 1e-3), false) AS k5 FROM c)"""
counters_query("packet_byte_consistency", "packet_byte_consistency_profile", f"""{_BYTES} SELECT count(*) AS row_count, count_if(checked) AS checked_row_count, count_if(k0 OR k1 OR k2 OR k3 OR k4 OR k5) AS inconsistent_row_count, count_if(k0) AS negative_packet_count,
  count_if(k1) AS negative_byte_count, count_if(k2) AS length_order_violation_count, count_if(k3) AS zero_packet_nonzero_byte_count, count_if(k4) AS byte_total_exceeds_max_possible_count, count_if(k5) AS variance_std_mismatch_count FROM w""")
example_query("packet_byte_examples", "packet_byte_consistency_profile", "examples", f"{_BYTES} SELECT row_index, 'packet_byte_inconsistency' AS reason FROM w WHERE k0 OR k1 OR k2 OR k3 OR k4 OR k5 ORDER BY row_index LIMIT 10")

_SLICE = "nullif(lower(trim(slice)), '')"
_SLICES = f"+v AS (SELECT *, {_SLICE} AS id, CAST(trunc(try_cast({_SLICE} AS DOUBLE)) AS BIGINT) AS k FROM flows), w AS (SELECT *, coalesce(id IN ('slice1', 'slice2', '1'), false) OR coalesce(CAST(k AS VARCHAR) IN ('slice1', 'slice2', '1'), false) AS known FROM v)"
counters_query("valid_slice_identifier", "valid_slice_identifier_profile", f"{_SLICES} SELECT count(*) AS row_count, count_if(id IS NULL) AS missing_slice_count, count_if(known) AS valid_slice_count FROM w")
example_query("valid_slice_examples", "valid_slice_identifier_profile", "invalid", f"{_SLICES} SELECT row_index, CASE WHEN id IS NOT NULL THEN slice END AS value, CASE WHEN id IS NULL THEN 'missing_slice_id' ELSE 'slice_id_not_allowed' END AS reason FROM w WHERE NOT known ORDER BY row_index LIMIT 10")


@query("valid_slice_aliases", """+v AS (SELECT CASE nullif(trim(slice), '') WHEN 'slice3' THEN 'Slice1' WHEN '1.0' THEN 'none' ELSE nullif(trim(slice), '') END AS id FROM flows)
  SELECT count(*) AS row_count, count_if(id IS NULL) AS missing_slice_count, count_if(coalesce(id IN ('Slice1', '1'), false)) AS valid_slice_count FROM v""")
def valid_slice_aliases(spark, sf_dir):
    """Case counts, two identifiers have aliases, numbers have no equivalents."""
    df = flows(spark, sf_dir)
    p = {"allowed_slice_ids": ["Slice1", 1], "case_sensitive": True, "allow_numeric_equivalents": False, "slice_aliases": {"slice3": "Slice1", "1.0": "none"}}
    return build_metric(df, {"metric_id": "valid_slice_identifier_profile", "input_requirements": {"slice_field": "slice"}, "calculation": {"parameters": p}}).counts(df)


@query("valid_slice_observed", f"{_SLICES} SELECT DISTINCT id FROM w WHERE id IS NOT NULL")
def valid_slice_observed(spark, sf_dir):
    df, metric = flow_metric(spark, sf_dir, "valid_slice_identifier_profile")
    return metric.table(df, "observed")


_EXPECTED = {0: ("1", "slice1"), 1: ("slice2",), 3: ("slice2", "slice3"), 4: ("1.0", "slice2"), 5: ("slice2",)}
_HIT = " OR ".join(f"h{i}" for i in _EXPECTED)
_RULES = f"""+v AS (SELECT *, {_SLICE} AS id, contains(lower(source_file), 'slice1') AS h0, starts_with(lower(source_file), 'cap_slice2') AS h1, lower(trim(source_file)) = 'other.csv' AS h3,
  ends_with(lower(source_file), '2.csv') AS h4, lower(trim(protocol)) IN ('udp', '17') AS h5 FROM flows),
w AS (SELECT *, ({_HIT}) AND id IS NOT NULL AND ({" OR ".join(f"(h{i} AND id IN {str(e) if len(e) > 1 else str(e).replace(',', '')})" for i, e in _EXPECTED.items())}) AS agrees, ({_HIT}) AND id IS NOT NULL AS seen, ({_HIT}) AS matched FROM v)"""
_RULE_COLUMNS = ", ".join(f"count_if(h{i}) AS applied_{i}, count_if(h{i} AND agrees) AS agreed_{i}, count_if(h{i} AND seen AND NOT agrees) AS differed_{i}" for i in _EXPECTED)
counters_query("slice_identifier_consistency", "slice_identifier_consistency_profile", f"""{_RULES} SELECT count(*) AS row_count, count_if(agrees) AS consistent_row_count, count_if(seen AND NOT agrees) AS differing_row_count,
  count_if(matched AND id IS NULL) AS missing_slice_count, count_if(NOT matched) AS unmatched_context_row_count, {_RULE_COLUMNS} FROM w""")


@query("slice_identifier_consistency_rules", f"""{_RULES} """ + " UNION ALL ".join(f"SELECT {i} AS rule_index, count_if(h{i}) AS application_count, count_if(h{i} AND agrees) AS consistent_count, count_if(h{i} AND seen AND NOT agrees) AS inconsistent_count FROM w" for i in _EXPECTED) + " UNION ALL SELECT 2, 0, 0, 0")
def slice_identifier_consistency_rules(spark, sf_dir):
    df, metric = flow_metric(spark, sf_dir, "slice_identifier_consistency_profile")
    there = {r["rule_index"] for r in metric.extra["usable"]}
    each = [F.struct(F.lit(i).alias("rule_index"), *[(F.col(f"{c}_{i}") if i in there else F.lit(0).cast("long")).alias(n) for c, n in (("applied", "application_count"), ("agreed", "consistent_count"), ("differed", "inconsistent_count"))]) for i in range(len(metric.extra["rules"]))]
    return metric.counts(df).select(F.inline(F.array(*each)))


example_query(
    "slice_consistency_examples", "slice_identifier_consistency_profile", "examples",
    f"""{_RULES} SELECT row_index, id AS observed, array_to_string(list_sort(list_distinct(flatten([{", ".join(f"CASE WHEN h{i} THEN {list(e)} ELSE [] END" for i, e in _EXPECTED.items())}]))), '|') AS expected, trim(source_file) AS source_file FROM w WHERE seen AND NOT agrees ORDER BY row_index LIMIT 10""",
    lambda d: d.select(ROW_INDEX, "observed", F.concat_ws("|", "expected").alias("expected"), F.get("context", F.lit(0)).alias("source_file")),
)

# Addresses


def _net_sql(number: str, blocks: tuple[str, ...]) -> str:
    import ipaddress

    nets = [ipaddress.ip_network(b) for b in blocks]
    return "(" + " OR ".join(f"{number} BETWEEN {int(n[0])} AND {int(n[-1])}" for n in nets) + ")"


# The IPv6 texts of the flow view and their categories.
_IPV6 = {
    "::1": ("private", "loopback", "reserved"), "fe80::1%eth0": ("private", "link_local"), "::ffff:10.0.0.1": ("private", "reserved", "ipv4_mapped"), "::ffff:8.8.8.8": ("reserved", "ipv4_mapped"),
    "fd00::1": ("private", "unique_local"), "2001:db8::1": ("private", "documentation"), "ff02::1": ("multicast",), "2600::1": (), "::": ("private", "reserved", "unspecified"), "3fff::1": ("documentation",),
}
_FIELD = {"a0": "src_ip", "a1": "dst_ip"}


def _texts_sql(field: str, category: str | None = None) -> str:
    """Whether a field holds one of the IPv6 texts (of a category)."""
    listed = [t for t, c in _IPV6.items() if category is None or category in c]
    return f"coalesce(trim({field}) IN ({', '.join(map(repr, listed))}), false)" if listed else "false"


def _category_sql(number: str, category: str) -> str:
    six = _texts_sql(_FIELD[number], category)
    if not IPV4_BLOCKS[category]:
        return f"({six})"
    less = f" AND NOT {_net_sql(number, IPV4_EXCEPTIONS[category])}" if category in IPV4_EXCEPTIONS else ""
    return f"(coalesce({_net_sql(number, IPV4_BLOCKS[category])}{less}, false) OR {six})"


def _address_sql(c: str, k: int) -> str:
    four = f"regexp_matches(trim({c}), '{IPV4_PATTERN}')"
    parts = " + ".join(f"CAST(split_part(trim({c}), '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4))
    return f"CASE WHEN {c} IS NULL OR trim({c}) = '' THEN 'missing' WHEN {four} THEN 'ipv4' WHEN {_texts_sql(c)} THEN 'ipv6' ELSE 'invalid' END AS c{k}, CASE WHEN coalesce({four}, false) THEN {parts} END AS a{k}"


_ADDRESSES = f"+v AS (SELECT *, {_address_sql('src_ip', 0)}, {_address_sql('dst_ip', 1)} FROM flows), w AS (SELECT *, " + ", ".join("(" + " OR ".join(_category_sql(f"a{k}", c) for c in CATEGORIES) + f") AS r{k}" for k in (0, 1)) + " FROM v)"
counters_query("reserved_ip_summary", "reserved_ip_address_profile", f"{_ADDRESSES} SELECT count(*) AS row_count, count_if(r0 OR r1) AS reserved_row_count, " + ", ".join(f"count_if(c{k} = 'missing') AS missing_{k}, count_if(c{k} = 'invalid') AS invalid_{k}, count_if(c{k} = 'ipv4') AS ipv4_{k}, count_if(c{k} = 'ipv6') AS ipv6_{k}, count_if(r{k}) AS reserved_{k}" for k in (0, 1)) + ", " + ", ".join(f"count_if({_category_sql('a0', c)}) + count_if({_category_sql('a1', c)}) AS category_{c}" for c in CATEGORIES) + " FROM w")


@query("reserved_ip_categories", f"{_ADDRESSES} " + " UNION ALL ".join(f"SELECT '{c}' AS category, count_if({_category_sql('a0', c)}) + count_if({_category_sql('a1', c)}) AS n FROM w" for c in CATEGORIES))
def reserved_ip_categories(spark, sf_dir):
    df, metric = flow_metric(spark, sf_dir, "reserved_ip_address_profile")
    return metric.counts(df).select(F.inline(F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"category_{c}").alias("n")) for c in CATEGORIES])))


@query("reserved_ip_fields", f"{_ADDRESSES} " + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS checked_address_count, count_if(c{k} IN ('ipv4', 'ipv6')) AS valid_address_count, count_if(c{k} = 'invalid') AS invalid_address_count, count_if(c{k} = 'missing') AS missing_address_count, count_if(r{k}) AS reserved_address_count FROM w" for k, f in enumerate(("src_ip", "dst_ip"))))
def reserved_ip_fields(spark, sf_dir):
    df, metric = flow_metric(spark, sf_dir, "reserved_ip_address_profile")
    each = [F.struct(F.lit(f).alias("field"), F.col("row_count").alias("checked_address_count"), (F.col(f"ipv4_{i}") + F.col(f"ipv6_{i}")).alias("valid_address_count"), F.col(f"invalid_{i}").alias("invalid_address_count"), F.col(f"missing_{i}").alias("missing_address_count"), F.col(f"reserved_{i}").alias("reserved_address_count")) for i, f in enumerate(metric.extra["fields"])]
    return metric.counts(df).select(F.inline(F.array(*each)))


_LISTED = {a: "concat_ws('|', " + ", ".join(f"CASE WHEN {_category_sql(a, c)} THEN '{c}' END" for c in CATEGORIES) + ")" for a in _FIELD}
_IP_CELLS = " UNION ALL ".join(f"SELECT row_index, {k} AS pos, '{f}' AS field, trim({f}) AS value, {_LISTED[f'a{k}']} AS categories FROM w WHERE r{k}" for k, f in enumerate(("src_ip", "dst_ip")))
example_query("reserved_ip_examples", "reserved_ip_address_profile", "reserved", f"{_ADDRESSES} SELECT row_index, field, value, categories FROM ({_IP_CELLS}) ORDER BY row_index, pos LIMIT 20", lambda d: d.select(ROW_INDEX, "field", "value", F.concat_ws("|", "categories").alias("categories")))


_BAD_CELLS = " UNION ALL ".join(f"SELECT row_index, {k} AS pos, '{f}' AS field, trim({f}) AS value FROM w WHERE c{k} = 'invalid'" for k, f in enumerate(("src_ip", "dst_ip")))
example_query("invalid_ip_examples", "reserved_ip_address_profile", "invalid", f"{_ADDRESSES} SELECT row_index, field, value FROM ({_BAD_CELLS}) ORDER BY row_index, pos LIMIT 20", lambda d: d.select(ROW_INDEX, "field", "value"))


@query("protocol_validity", f"""{_ADDRESSES} SELECT count(*) AS packet_count, CAST(0 AS BIGINT) AS zero_length_packet_count, count_if(c0 <> 'invalid' AND c1 <> 'invalid') AS valid_packet_count, count(*) AS checked_row_count,
  count_if(c0 = 'invalid' OR c1 = 'invalid') AS invalid_row_count, """ + ", ".join(f"count_if(c{k} = '{c}') AS {f}_{c}" for k, f in enumerate(("source_ip", "destination_ip")) for c in ("missing", "ipv4", "ipv6", "invalid")) + " FROM w")
def protocol_validity_query(spark, sf_dir):
    from assayer.operators.addresses import protocol_validity

    df = flows(spark, sf_dir)
    return protocol_validity(df, {"metric_id": "protocol_validity_profile"}, "src_ip", "dst_ip", None, None).counts(df)


# Sources: all events are written as files, by Spark and its executors, then read with the library's readers.


def _shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, with its scheme; on a local master a temporary one."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="assayer-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}-{name}"


def write_events(spark: SparkSession, sf_dir: str, path: str, separator: str, kind: str) -> None:
    """All events as a folder of delimited files, in order of their ids, with padded headers, quoted cells and NA texts.

    ``kind`` is SQL for the cell of the event's type.
    """
    cells = ["concat(' ', CAST(event_id AS STRING)) AS ` event id `", f"{kind} AS ` type`", "CASE WHEN user_id % 7 = 0 THEN 'NA' ELSE CAST(user_id AS STRING) END AS `user_id `"]
    ordered = spark.read.parquet(f"{sf_dir}/events.parquet").repartitionByRange("event_id").sortWithinPartitions("event_id")
    writer = ordered.selectExpr(*cells).write.option("sep", separator).option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def _scan(name: str, suffix: str, separator: str, kind: str = "{0}event_type, '{1}x'{2}") -> None:
    spark_kind, sql_kind = kind.format("concat(", separator, ")"), kind.format("concat(", separator, ")").replace("'\\n", "chr(10) || '")

    @query(name, f"""SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_index, CAST(event_id AS VARCHAR) AS "event id", {sql_kind} AS "type", CASE WHEN user_id % 7 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS user_id FROM events""")
    def fn(spark, sf_dir):
        """All events as a folder of delimited files, read as one table with row numbers over files and splits."""
        from assayer.sources.tabular import read_tabular

        path = _shared(spark, f"events{suffix}")
        write_events(spark, sf_dir, path, separator, spark_kind)
        return read_tabular(spark, path, row_index=True)


_scan("scan_csv", ".csv", ",")
_scan("scan_tsv", ".tsv", "\t")
_scan("scan_csv_multiline", ".csv", ",", "{0}event_type, '\\nsecond, \"line\"'{2}")


@query("scan_parquet", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_index, event_id, user_id FROM events")
def scan_parquet(spark, sf_dir):
    """All events as a folder of Parquet files, read with row numbers over all files."""
    from assayer.sources.tabular import read_tabular

    path = _shared(spark, "events.parquet")
    spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id").repartitionByRange("event_id").sortWithinPartitions("event_id").write.parquet(path)
    return read_tabular(spark, path, row_index=True)


#: Of seven packets, one has no IP layer, one has no length, and two are IPv6.
_PACKET_KIND = "event_id % 7"
_PACKET_TIME = "CASE WHEN event_id % 31 = 0 THEN {0} - 7200 ELSE {0} - {0} % 60 END"


def write_captures(spark: SparkSession, sf_dir: str, path: str, block: int) -> None:
    """All events as packets: a capture for each ``block`` of ids, in order of the ids; executors write them to the shared folder."""
    import pandas as pd

    from assayer.sources.pcap import _remote

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        import os
        import struct

        def frame(user: int, kind: int) -> bytes:
            if kind == 0:
                return b""
            if kind == 1:
                return bytes(12) + b"\x08\x06" + bytes(20)
            if kind in (2, 3):
                return bytes(12) + b"\x86\xdd" + b"\x60\0\0\0\0\0\x3b\x40" + b"\x20\x01\x0d\xb8" + bytes(11) + bytes([user % 256]) + bytes(15) + b"\x01"
            return bytes(12) + b"\x08\x00" + struct.pack(">BBHHHBBH", 0x45, 0, 20, 0, 0, 64, 17, 0) + bytes([10, 0, user % 256, 1, 8, 8, 8, 8])

        rows = rows.sort_values("event_id")
        parts = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)]
        for t, u, k in zip(rows["seconds"].tolist(), rows["user_id"].tolist(), rows["kind"].tolist()):
            data = frame(u, k)
            parts.append(struct.pack("<IIII", t, 0, len(data), len(data)) + data)
        data = b"".join(parts)
        file = f"{path}/{int(rows['block'].iloc[0]):012d}.pcap"
        if remote := _remote(file):
            with remote[0].open_output_stream(remote[1]) as out:
                out.write(data)
        else:
            file = file.removeprefix("file://").removeprefix("file:")
            os.makedirs(os.path.dirname(file), exist_ok=True)
            with open(file, "wb") as out:
                out.write(data)
        return pd.DataFrame({"n": [len(rows)]})

    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    rows = events.selectExpr("event_id", f"{_PACKET_TIME.format('s')} AS seconds", "user_id", f"{_PACKET_KIND} AS kind", f"event_id div {block} AS block")
    rows.groupBy("block").applyInPandas(write, "n long").agg(F.sum("n")).collect()


_PACKETS = f"""SELECT row_number() OVER (ORDER BY event_id) - 1 AS packet_index, {_PACKET_TIME.format("s")} AS seconds, CASE WHEN k = 0 THEN 0 WHEN k IN (2, 3) THEN 54 ELSE 34 END AS wire_len,
  CASE WHEN k < 2 THEN NULL WHEN k IN (2, 3) THEN 6 ELSE 4 END AS ip_version, CASE WHEN k < 2 THEN NULL WHEN k IN (2, 3) THEN concat('2001:db8::', printf('%x', user_id % 256)) ELSE concat('10.0.', user_id % 256, '.1') END AS src,
  CASE WHEN k < 2 THEN NULL WHEN k IN (2, 3) THEN '::1' ELSE '8.8.8.8' END AS dst FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s, {_PACKET_KIND} AS k FROM events)"""


def captures(spark: SparkSession, sf_dir: str, columns: tuple[str, ...]) -> DataFrame:
    """All events as captures of 2,048 ids each, read as a folder, in ranges of 16 KB."""
    from assayer.sources.pcap import read_pcap

    path = _shared(spark, "captures")
    write_captures(spark, sf_dir, path, 2048)
    return read_pcap(spark, path, columns, 1 << 14)


@query("scan_pcap", _PACKETS.replace("concat('2001:db8::', printf('%x', user_id % 256))", "CASE WHEN user_id % 256 = 0 THEN '2001:db8::' ELSE concat('2001:db8::', printf('%x', user_id % 256)) END"))
def scan_pcap(spark, sf_dir):
    """Packets numbered over all captures of a folder."""
    return captures(spark, sf_dir, ("packet_index", "ts", "wire_len", "ip_version", "src", "dst")).withColumn("ts", F.floor("ts")).withColumnRenamed("ts", "seconds")


@query("timestamp_coherence_captures", f"""SELECT count(*) AS packet_count, arg_min(t, i) AS first_timestamp, arg_max(t, i) AS last_timestamp, count_if(d < 0) AS backwards_jump_count, count_if(d = 0) AS zero_delta_count,
  count_if(d > 600) AS large_gap_count, count_if(d >= 0) AS gap_count, CAST(sum(CASE WHEN d >= 0 THEN d END) AS BIGINT) AS gap_sum, max(CASE WHEN d >= 0 THEN d END) AS gap_max
  FROM (SELECT packet_index AS i, seconds AS t, seconds - lag(seconds) OVER (ORDER BY packet_index) AS d FROM ({_PACKETS}))""")
def timestamp_coherence_captures(spark, sf_dir):
    """Several captures as one sequence, with jumps back, repeats and gaps."""
    packets = captures(spark, sf_dir, ("packet_index", "ts")).withColumn("ts", F.floor("ts"))
    return gap_facts(packets, threshold=600, chunk=1000)


@query("protocol_validity_captures", f"""SELECT count(*) AS packet_count, count_if(wire_len = 0) AS zero_length_packet_count, count_if(wire_len > 0) AS valid_packet_count, count(ip_version) AS checked_row_count, CAST(0 AS BIGINT) AS invalid_row_count,
  {", ".join(f"CAST(0 AS BIGINT) AS {f}_missing, count_if(ip_version = 4) AS {f}_ipv4, count_if(ip_version = 6) AS {f}_ipv6, CAST(0 AS BIGINT) AS {f}_invalid" for f in ("source_ip", "destination_ip"))} FROM ({_PACKETS})""")
def protocol_validity_captures(spark, sf_dir):
    """Packets of both families, without IP layer and without length."""
    df = captures(spark, sf_dir, ("packet_index", "wire_len", "ip_version", "src", "dst"))
    return build_metric(df, {"metric_id": "protocol_validity_profile"}).counts(df)


# An outcome of each layout; one row each, so that SQL can state the flattened relations as literals.
OUTCOMES = {
    "a.json": {
        "status": "success", "case_id": "c1", "plan_id": "p1", "metric_ids": ["column_quality_profile", "pearson_correlation_profile"], "dataset_path": "d.csv",
        "metric_results": [{"metric_id": "column_quality_profile", "status": "success"}, {"metric_id": "pearson_correlation_profile", "status": "failed", "error": "why"}],
        "test_results": {
            "column_quality_profile": {"fields": [], "summary": {"field_count": 2, "usable_field_count": 1, "constant_field_count": 0, "missing_field_count": 1, "mean_non_null_ratio": 0.5, "mean_numeric_non_null_ratio": 0.5, "mean_unique_ratio": 0.25, "quality_score": 0.5}},
            "pearson_correlation_profile": {"summary": {"pair_count": 1, "mean_absolute_correlation": 0.5, "pairs": [{"fields": ["x", "y"], "value": -0.5, "overlap_non_null_count": 9}]}},
            "timestamp_coherence_profile": {"packet_count": 3, "capture_duration_seconds": 2.5, "backwards_jump_count": 0, "zero_delta_count": 1, "large_gap_count": 1, "large_gap_threshold_seconds": 1.0, "gap_count": 2, "mean_gap_seconds": 1.25, "max_gap_seconds": 2.5, "status": "pass"},
            "protocol_validity_profile": {"packet_count": 3, "valid_packet_count": 3, "protocol_validity_ratio": 1.0, "invalid_ip_count": 0, "invalid_port_count": 0, "protocol_mismatch_count": 0, "zero_length_packet_count": 0, "suspicious_tcp_flag_count": 0, "status": "pass"},
        },
    },
    "b.json": {"status": "failed", "case_id": "c2", "plan_id": "p2", "metric_id": "pearson_correlation_profile", "dataset_path": "e.csv", "error": "none"},
}
_A = "'a.json' AS file_name, 'c1' AS case_id, 'p1' AS plan_id, 'd.csv' AS dataset_path"
_B = "'b.json' AS file_name, 'c2' AS case_id, 'p2' AS plan_id, 'e.csv' AS dataset_path"


def _literals(values: dict) -> str:
    return ", ".join(f"'{v}' AS {k}" if isinstance(v, str) else f"CAST({v} AS {'DOUBLE' if isinstance(v, float) else 'BIGINT'}) AS {k}" for k, v in values.items())


_RESULTS = OUTCOMES["a.json"]["test_results"]
_EXPORTS = {
    "outcome_summary": f"SELECT {_A}, 'success' AS status, 'column_quality_profile|pearson_correlation_profile' AS metric_ids UNION ALL SELECT {_B}, 'failed', ''",
    "metric_results": f"SELECT {_A}, 'column_quality_profile' AS metric_id, 'success' AS metric_status, CAST(NULL AS VARCHAR) AS error UNION ALL SELECT {_A}, 'pearson_correlation_profile', 'failed', 'why'",
    "column_quality_summary": f"SELECT {_A}, {_literals(_RESULTS['column_quality_profile']['summary'])}",
    "pearson_summary": f"SELECT {_A}, CAST(1 AS BIGINT) AS pair_count, CAST(0.5 AS DOUBLE) AS mean_absolute_correlation",
    "pearson_pairs": f"SELECT {_A}, 'x' AS field_a, 'y' AS field_b, CAST(-0.5 AS DOUBLE) AS value, CAST(9 AS BIGINT) AS overlap_non_null_count",
    "timestamp_summary": f"SELECT {_A}, {_literals(_RESULTS['timestamp_coherence_profile'])}",
    "protocol_summary": f"SELECT {_A}, {_literals(_RESULTS['protocol_validity_profile'])}",
}


def _export(name: str, relation: str) -> None:
    @query(name, _EXPORTS[relation])
    def fn(spark, sf_dir):
        texts = spark.createDataFrame([(n, json.dumps(d)) for n, d in OUTCOMES.items()], "file_name string, value string")
        return export.RELATIONS[relation](export.parse_outcomes(texts))


for _name, _relation in (("export_outcome_summary", "outcome_summary"), ("export_metric_results", "metric_results"), ("export_column_quality", "column_quality_summary"), ("export_pearson_summary", "pearson_summary"), ("export_pearson_pairs", "pearson_pairs"), ("export_timestamp", "timestamp_summary"), ("export_protocol", "protocol_summary")):
    _export(_name, _relation)
