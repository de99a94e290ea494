import pytest
from pyspark.sql import functions as F

from assayer.functions.addresses import category_names, classify_address, with_addresses, with_ipv6_digits
from assayer.functions.values import canonical_code, fold_identifier, fold_numeric, identifier, na_to_null, number, numeric_equivalent, port_class, port_status, port_value


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_number_takes_what_python_readers_take(spark):
    inf = float("inf")
    cases = {"1e3": 1000.0, " 12 ": 12.0, "+5": 5.0, ".5": 0.5, "5.": 5.0, "inf": inf, "Infinity": inf, "-inf": -inf, "0x10": None, "1_000": None, "1,000": None, "1d": None, "1f": None, "1.5D": None, "True": None, "": None, "nan": None, "0x1p3": None, None: None}
    assert column(spark, list(cases), number) == list(cases.values())


def test_numeric_column_drops_nan_only(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r[0] for r in df.select(number(F.col("v"), True)).collect()] == [1.5, None, float("inf"), None]


@pytest.mark.parametrize("value, status, port", [(None, "missing", None), ("", "missing", None), ("  ", "missing", None), ("NaN", "missing", None), ("abc", "non_integer", None), ("80.1", "non_integer", None), ("inf", "non_integer", None), ("70000", "out_of_range", None), ("-1", "out_of_range", None), ("53", "valid", 53), ("80.0", "valid", 80), ("1e3", "valid", 1000), ("0", "valid", 0), ("65535", "valid", 65535)])
def test_ports(spark, value, status, port):
    assert column(spark, [value], port_status) == [status]
    assert column(spark, [value], port_value) == [port]


def test_port_classes(spark):
    got = column(spark, ["0", "1023", "1024", "49151", "49152", "65535", None], lambda v: port_class(v.cast("int")))
    assert got == ["well_known", "well_known", "registered", "registered", "dynamic_private", "dynamic_private", None]


def test_identifiers(spark):
    values = [" Slice1 ", "", None, "\t", "eMBB"]
    assert column(spark, values, identifier) == ["slice1", None, None, None, "embb"]
    assert column(spark, values, lambda v: identifier(v, True)) == ["Slice1", None, None, None, "eMBB"]
    assert column(spark, values, lambda v: identifier(v, False, {"EMBB": "Slice1"})) == ["slice1", None, None, None, "slice1"]
    assert column(spark, ["1.9", "-0.5", "x", None, "inf", "7"], numeric_equivalent) == ["1", "0", None, None, None, "7"]
    assert fold_identifier(" A ") == "a" and fold_identifier(None) is None and fold_identifier(float("nan")) is None and fold_identifier("") is None
    assert fold_numeric("1.9") == "1" and fold_numeric("x") is None and fold_numeric("inf") is None


def test_codes_and_missing_texts(spark):
    assert column(spark, ["6.0", " TCP ", "6", "17.5"], canonical_code) == ["6", "tcp", "6", "17.5"]
    assert column(spark, ["NA", "null", "x", "", "None", "<NA>"], na_to_null) == [None, None, "x", None, None, None]


ADDRESSES = {
    "0.0.0.0": ("ipv4", ["private", "unspecified"]), "255.255.255.255": ("ipv4", ["private", "reserved"]), "203.0.113.5": ("ipv4", ["private", "documentation"]), "224.0.0.1": ("ipv4", ["multicast"]),
    "192.0.0.9": ("ipv4", []), "100.64.0.1": ("ipv4", ["shared_address_space"]), "8.8.8.8": ("ipv4", []), " 10.1.2.3 ": ("ipv4", ["private"]), "127.0.0.1": ("ipv4", ["private", "loopback"]),
    "169.254.1.1": ("ipv4", ["private", "link_local"]), "198.18.0.1": ("ipv4", ["private", "benchmarking"]),
    "256.1.1.1": ("invalid", None), "01.2.3.4": ("invalid", None), "1.1.1": ("invalid", None), "12345": ("invalid", None), "gggg::1": ("invalid", None), ":::": ("invalid", None),
    "": ("missing", None), "   ": ("missing", None),
    "2001:db8::1": ("ipv6", ["private", "documentation"]), "::1": ("ipv6", ["private", "loopback", "reserved"]), "::": ("ipv6", ["private", "reserved", "unspecified"]),
    "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff": ("ipv6", ["multicast"]), "fe80::1%eth0": ("ipv6", ["private", "link_local"]), "fd00::1": ("ipv6", ["private", "unique_local"]),
    "::ffff:10.0.0.1": ("ipv6", ["private", "reserved", "ipv4_mapped"]), "::ffff:8.8.8.8": ("ipv6", ["reserved", "ipv4_mapped"]), "2600::1": ("ipv6", []), "3fff::1": ("ipv6", ["documentation"]),
}


def test_addresses(spark):
    df = spark.createDataFrame([(a,) for a in ADDRESSES] + [(None,)], "v string")
    got = {r["v"]: (r["a"]["class"], r["c"]) for r in with_addresses(df, {"a": F.col("v")}).withColumn("c", category_names(F.col("a.mask"))).collect()}
    assert got.pop(None) == ("missing", None)
    assert got == ADDRESSES
    for a, (kind, _) in ADDRESSES.items():
        assert classify_address(a) == kind
    assert classify_address(None) == "missing"


def test_ipv6_agrees_with_a_parser(spark):
    """Texts put together from pieces of addresses, right and wrong, against the standard library."""
    import ipaddress
    import random

    rng = random.Random(4)
    pieces = ["0", "1", "ff", "abcd", "12345", "g", ":", "::", ":", "::", "1.2.3.4", "256.1.1.1", "%eth0", "%", "/64", "fe80", "A"]
    texts = {"".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(3000)}
    for _ in range(3000):
        groups = [f"{rng.getrandbits(rng.choice([1, 8, 16])):x}" for _ in range(rng.randint(6, 9))]
        at = rng.randint(0, len(groups))
        texts.add(":".join(groups))
        texts.add(":".join(groups[:at]) + "::" + ":".join(groups[at + rng.randint(0, 3) :]))
        texts.add(":".join(groups[:6]) + ":1.2.3.4")
        texts.add("::" + ":".join(groups[: rng.randint(0, 5)]) + ":8.8.4.4")

    def want(t):
        try:
            a = ipaddress.ip_address(t)
        except ValueError:
            return None
        return f"{int(ipaddress.IPv6Address(int(a))):032x}" if a.version == 6 else None

    df = spark.createDataFrame([(t,) for t in sorted(texts)], "v string")
    wrong = [(r["v"], r["d"], want(r["v"])) for r in with_ipv6_digits(df, {"d": F.col("v")}).collect() if r["d"] != want(r["v"])]
    assert not wrong, wrong[:10]


def test_addresses_without_python(spark):
    df = spark.createDataFrame([("8.8.8.8",), ("::1",)], "v string")
    plan = with_addresses(df, {"a": F.col("v")})
    assert [r["a"]["class"] for r in plan.collect()] == ["ipv4", "ipv6"]
    assert "ArrowEvalPython" not in plan._jdf.queryExecution().toString()
