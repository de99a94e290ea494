"""Every query against its SQL on small tables, and no counter that the tables leave at zero."""

from collections import Counter

import duckdb
import pytest

from assayer.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
#: Counters that these queries hold at zero: packets read from captures have readable addresses, flows have no length, a policy without resets has none, and no lineitem column is constant.
ZERO = {"protocol_validity_captures": {"invalid_row_count", "source_ip_missing", "source_ip_invalid", "destination_ip_missing", "destination_ip_invalid"}, "handshake_other_policy": {"rst_flow_count"}, "column_quality_summary": {"constant_field_count"}, "protocol_validity": {"zero_length_packet_count"}}
COUNTERS = [
    "column_quality_summary", "timestamp_coherence", "timestamp_coherence_captures", "valid_port_range", "service_port_any", "service_port_destination", "service_port_source", "service_port_both", "tcp_flag_consistency",
    "handshake_plausibility", "handshake_other_policy", "flow_duration_consistency", "packet_byte_consistency", "valid_slice_identifier", "valid_slice_aliases", "slice_identifier_consistency", "reserved_ip_summary",
    "protocol_validity", "protocol_validity_captures",
]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, tables, name):
    found = tables.sql(ORACLE_SQL[name])
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    want = Counter(tuple(r[i] for i in order) for r in found.fetchall())
    df = QUERIES[name](spark, SF)
    got = Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    assert sorted(df.columns) == sorted(found.columns) and got == want and got
    if name in COUNTERS:
        (row,) = got
        zero = {c for c, v in zip(sorted(df.columns), row) if not v}
        assert zero == ZERO.get(name, set())
