"""IP address classes as Column expressions.

Both stay in the JVM: IPv4 by a strict pattern and integer ranges, IPv6 as 32 hexadecimal digits and
ranges of those.
"""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.values import holds, strip

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = rf"^({_OCTET}\.){{3}}{_OCTET}$"

# Address blocks by category, in the order in which categories are listed.
IPV4_BLOCKS = {
    "private": ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32"),
    "loopback": ("127.0.0.0/8",),
    "link_local": ("169.254.0.0/16",),
    "multicast": ("224.0.0.0/4",),
    "reserved": ("240.0.0.0/4",),
    "unspecified": ("0.0.0.0/32",),
    "documentation": ("192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24"),
    "shared_address_space": ("100.64.0.0/10",),
    "benchmarking": ("198.18.0.0/15",),
    "ipv4_mapped": (),
    "unique_local": (),
}
IPV4_EXCEPTIONS = {"private": ("192.0.0.9/32", "192.0.0.10/32")}
IPV6_BLOCKS = {
    "private": ("::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10"),
    "loopback": ("::1/128",),
    "link_local": ("fe80::/10",),
    "multicast": ("ff00::/8",),
    "reserved": ("::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9"),
    "unspecified": ("::/128",),
    "documentation": ("2001:db8::/32", "3fff::/20"),
    "shared_address_space": (),
    "benchmarking": (),
    "ipv4_mapped": ("::ffff:0:0/96",),
    "unique_local": ("fc00::/7",),
}
IPV6_EXCEPTIONS = {"private": ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")}
CATEGORIES = tuple(IPV4_BLOCKS)
# End of fixed values.


def ipv4_number(text: Column) -> Column:
    """The address as a long; only for text that matches the pattern."""
    parts = F.split(text, r"\.")
    return reduce(lambda a, b: a + b, [F.get(parts, i).try_cast("long") * 256 ** (3 - i) for i in range(4)])


def with_ipv6_digits(df: DataFrame, cells: dict[str, Column]) -> DataFrame:
    """For each name, the 32 lower-case hexadecimal digits of a cell's IPv6 address; NULL for what is none.

    Digits sort as addresses do. A scope behind ``%`` is cut off, an IPv4 tail becomes two groups, ``::``
    stands for one group at least. Each step is a column of its own, so that no expression repeats the
    ones below it.
    """
    t = {n: {k: f"__{n}_{k}" for k in ("plain", "tail", "four", "head", "left", "right")} for n in cells}
    df = df.withColumns({t[n]["plain"]: F.when(v.contains(":"), F.regexp_replace(v, "%[^%/]+$", "")) for n, v in cells.items()})
    df = df.withColumns({x["tail"]: F.regexp_extract(x["plain"], rf":(({_OCTET}\.){{3}}{_OCTET})$", 1) for x in t.values()})
    df = df.withColumns({x["four"]: F.when(F.col(x["tail"]) != "", F.lower(F.lpad(F.hex(ipv4_number(F.col(x["tail"]))), 8, "0"))) for x in t.values()})
    merged = lambda x: F.concat(F.substring(x["plain"], F.lit(1), F.length(x["plain"]) - F.length(x["tail"])), F.substring(x["four"], 1, 4), F.lit(":"), F.substring(x["four"], 5, 4))
    df = df.withColumns({x["head"]: F.when(F.col(x["four"]).isNull(), F.col(x["plain"])).otherwise(merged(x)) for x in t.values()})
    groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
    side = lambda x, i: groups(F.coalesce(F.get(F.split(F.col(x["head"]), "::", -1), F.lit(i)), F.lit("")))
    df = df.withColumns({x[k]: side(x, i) for x in t.values() for i, k in enumerate(("left", "right"))})

    def digits(x):
        head = F.col(x["head"])
        n = F.size(x["left"]) + F.size(x["right"])
        shape = head.rlike(r"^(?!:[^:])(?!.*::.*::)(?!.*:::)[0-9A-Fa-f]{0,4}(::?[0-9A-Fa-f]{1,4})*(::)?$")
        fits = F.when(head.contains("::"), n <= 7).otherwise(n == 8)
        padded = lambda c: F.array_join(F.transform(c, lambda g: F.lpad(g, 4, "0")), "")
        return F.when(holds(shape) & holds(fits), F.lower(F.concat(padded(x["left"]), F.repeat(F.lit("0000"), 8 - n), padded(x["right"]))))

    return df.withColumns({n: digits(x) for n, x in t.items()}).drop(*[c for x in t.values() for c in x.values()])


def _in_blocks(name: str, blocks: tuple[str, ...], less: tuple[str, ...], show) -> str:
    """SQL for a column within blocks and outside exceptions; ``show`` writes an address as the column holds it."""

    def inside(nets):
        pairs = [(ipaddress.ip_network(n)[0], ipaddress.ip_network(n)[-1]) for n in nets]
        return "(" + " OR ".join(f"{name} BETWEEN {show(a)} AND {show(b)}" for a, b in pairs) + ")"

    return f"({inside(blocks)} AND NOT {inside(less)})" if less else inside(blocks)


def _ipv4_in(name: str, category: str) -> str:
    return _in_blocks(name, IPV4_BLOCKS[category], IPV4_EXCEPTIONS.get(category, ()), lambda a: str(int(a)))


def _ipv6_in(name: str, category: str) -> str:
    return _in_blocks(name, IPV6_BLOCKS[category], IPV6_EXCEPTIONS.get(category, ()), lambda a: f"'{int(a):032x}'")


def _mask(conditions: dict[str, str]) -> Column:
    """An int with a bit for each category whose condition holds, by its place in CATEGORIES."""
    return F.expr(" + ".join(f"CASE WHEN {test} THEN {1 << CATEGORIES.index(c)} ELSE 0 END" for c, test in conditions.items()))


def in_category(mask: Column, category: str) -> Column:
    return mask.bitwiseAND(F.lit(1 << CATEGORIES.index(category))) != 0


def category_names(mask: Column) -> Column:
    """A mask's categories in their fixed order; NULL for no mask."""
    return F.when(mask.isNotNull(), F.array_compact(F.array(*[F.when(in_category(mask, c), c) for c in CATEGORIES])))


def ipv4_mask(name: str) -> Column:
    """The categories of a column of IPv4 numbers."""
    return _mask({c: _ipv4_in(name, c) for c in CATEGORIES if IPV4_BLOCKS[c]})


def ipv6_mask(digits: str, inner: str) -> Column:
    """The categories of a column of IPv6 digits.

    ``inner`` holds the embedded IPv4 number of mapped addresses, which are private or loopback as that is.
    """
    tests = {c: _ipv6_in(digits, c) for c in CATEGORIES if IPV6_BLOCKS[c]}
    for c in ("private", "loopback"):
        tests[c] = f"CASE WHEN {inner} IS NULL THEN {tests[c]} ELSE {_ipv4_in(inner, c)} END"
    return _mask(tests)


def with_addresses(df: DataFrame, cells: dict[str, Column]) -> DataFrame:
    """``df`` with a struct for each name: class (missing, ipv4, ipv6, invalid), text, version and mask (of categories) of a cell."""
    parts = {n: {k: f"__{n}_{k}" for k in ("text", "number", "six", "inner")} for n in cells}
    df = df.withColumns({parts[n]["text"]: strip(v) for n, v in cells.items()})
    df = df.withColumns({x["number"]: F.when(holds(F.col(x["text"]).rlike(IPV4_PATTERN)), ipv4_number(F.col(x["text"]))) for x in parts.values()})
    df = with_ipv6_digits(df, {x["six"]: F.col(x["text"]) for x in parts.values()})
    df = df.withColumns({x["inner"]: F.expr(f"CASE WHEN {_ipv6_in(x['six'], 'ipv4_mapped')} THEN CAST(conv(substring({x['six']}, 25, 8), 16, 10) AS BIGINT) END") for x in parts.values()})

    def struct(text, number, six, inner):
        kind = F.expr(f"CASE WHEN {text} IS NULL OR {text} = '' THEN 'missing' WHEN {number} IS NOT NULL THEN 'ipv4' WHEN {six} IS NOT NULL THEN 'ipv6' ELSE 'invalid' END")
        version = F.expr(f"CASE WHEN {number} IS NOT NULL THEN 4 WHEN {six} IS NOT NULL THEN 6 END")
        mask = F.when(F.col(number).isNotNull(), ipv4_mask(number)).when(F.col(six).isNotNull(), ipv6_mask(six, inner))
        return F.struct(kind.alias("class"), F.col(text).alias("text"), version.alias("version"), mask.alias("mask"))

    return df.withColumns({n: struct(**parts[n]) for n in cells}).drop(*[c for x in parts.values() for c in x.values()])


def classify_address(value: object) -> str:
    """missing, ipv4, ipv6 or invalid, for single values on the driver and in packet readers."""
    text = "" if value is None else str(value).strip()
    if not text:
        return "missing"
    try:
        return f"ipv{ipaddress.ip_address(text).version}"
    except ValueError:
        return "invalid"
