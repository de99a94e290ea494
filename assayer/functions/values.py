"""Value semantics: numbers, ports, identifiers and missing values, as Column expressions.

Columns arrive as text (or as numbers from typed files). Nothing here keeps a NaN: what isn't a
number is NULL, so that comparisons mean the same in a filter, a count and an oracle.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cell texts that tabular readers take as missing.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# The port classes and their bounds.
PORT_MAX = 65535
WELL_KNOWN_MAX = 1023
REGISTERED_MAX = 49151


#: Texts that are numbers, blanks around them taken off.
NUMBER_PATTERN = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"


def quoted(name: str) -> Column:
    """A column by its literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(df: DataFrame, name: str) -> bool:
    kind = {f.name: f.dataType.typeName() for f in df.schema.fields}[name]
    return kind in ("byte", "short", "integer", "long", "float", "double") or kind.startswith("decimal")


def strip(value: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(value.cast("string"), r"(?U)^\s+|\s+$", "")


def na_to_null(value: Column) -> Column:
    return F.when(~value.isin(*NA_TOKENS), value)


def number(value: Column, numeric: bool = False) -> Column:
    """A double, or NULL for what isn't a number. Infinities are numbers, NaN is not.

    ``numeric`` says that the column already has a numeric type. Text like ``1d`` or ``1f``, which a
    cast would take, is no number.
    """
    d = value.cast("double") if numeric else _text_number(value)
    return F.when(~F.isnan(d), d)


def _text_number(value: Column) -> Column:
    text = F.trim(value.cast("string"))
    # A cast would also take type suffixes and hexadecimal floats; and where it fails it is slow.
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def finite(value: Column) -> Column:
    """The double if it is finite, else NULL."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def holds(predicate: Column) -> Column:
    """The predicate with NULL as false."""
    return F.coalesce(predicate, F.lit(False))


def any_of(predicates: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, map(holds, predicates), F.lit(False))


def all_of(predicates: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, map(holds, predicates), F.lit(True))


def port_number(value: Column) -> Column:
    """The cell as a double if it is one, ports or not."""
    return _text_number(strip(value))


def port_status(value: Column) -> Column:
    """missing, non_integer, out_of_range or valid."""
    return status_of_port(strip(value), port_number(value))


def with_ports(df: DataFrame, cells: dict[str, Column]) -> DataFrame:
    """For each name, columns <name>_s (:func:`port_status`) and <name>_p (:func:`port_value`), made step by step."""
    df = df.withColumns({f"{n}_t": strip(v) for n, v in cells.items()})
    df = df.withColumns({f"{n}_d": _text_number(F.col(f"{n}_t")) for n in cells})
    df = df.withColumns({f"{n}_s": status_of_port(F.col(f"{n}_t"), F.col(f"{n}_d")) for n in cells})
    df = df.withColumns({f"{n}_p": F.when(F.col(f"{n}_s") == "valid", F.col(f"{n}_d").cast("int")) for n in cells})
    return df.drop(*[f"{n}_{k}" for n in cells for k in "td"])


def status_of_port(text: Column, d: Column) -> Column:
    whole = finite(d).isNotNull() & ~F.isnan(d) & (F.floor(d).cast("double") == d)
    return (
        F.when(text.isNull() | (text == "") | (F.lower(text) == "nan"), "missing")
        .when(~holds(whole), "non_integer")
        .when(d.between(0, PORT_MAX), "valid")
        .otherwise("out_of_range")
    )


def port_value(value: Column) -> Column:
    """The port of a valid cell as an int, else NULL."""
    return F.when(port_status(value) == "valid", port_number(value).cast("int"))


def port_class(port: Column) -> Column:
    """well_known, registered or dynamic_private; NULL for no port."""
    return F.when(port <= WELL_KNOWN_MAX, "well_known").when(port <= REGISTERED_MAX, "registered").when(port.isNotNull(), "dynamic_private")


def canonical_code(value: Column) -> Column:
    """A protocol code as lower-case text; integral numbers without a fraction (``6.0`` is ``6``)."""
    text = F.lower(strip(value))
    return F.when(text.rlike(r"^[0-9]+\.0+$"), F.regexp_extract(text, r"^([0-9]+)", 1)).otherwise(text)


def identifier(value: Column, case_sensitive: bool = False, aliases: dict[str, str] | None = None) -> Column:
    """A stripped, lower-cased identifier with aliases replaced; NULL if blank."""
    text = strip(value) if case_sensitive else F.lower(strip(value))
    text = F.when(text != "", text)
    if not aliases:
        return text
    fold = (lambda s: str(s).strip()) if case_sensitive else (lambda s: str(s).strip().lower())
    known = F.create_map(*[F.lit(x) for k, v in aliases.items() for x in (fold(k), fold(v))])
    mapped = F.coalesce(F.try_element_at(known, text), text)
    return F.when(mapped != "", mapped)


def numeric_equivalent(value: Column) -> Column:
    """A numeric identifier truncated to a whole number, as text; NULL for others."""
    d = finite(_text_number(value))
    return F.when(~F.isnan(d) & (F.abs(d) < 9e18), d.cast("long").cast("string"))


def fold_identifier(value: object, case_sensitive: bool = False, aliases: dict[str, str] | None = None) -> str | None:
    """:func:`identifier` of a configured value, on the driver."""
    if value is None or (isinstance(value, float) and value != value):
        return None
    fold = (lambda s: str(s).strip()) if case_sensitive else (lambda s: str(s).strip().lower())
    text = fold(value)
    text = {fold(k): fold(v) for k, v in (aliases or {}).items()}.get(text, text)
    return text or None


def fold_numeric(value: object) -> str | None:
    """:func:`numeric_equivalent` of a configured value, on the driver."""
    try:
        return str(int(float(str(value))))
    except (ValueError, OverflowError):
        return None
