"""What a metric is: columns to derive, counters to aggregate, small tables and bounded examples, and a finish.

A metric only declares. The runner puts the derived columns of all metrics on one frame and evaluates
all counters in one aggregation, so a plan of any number of metrics scans its dataset once for counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.sources.tabular import ROW_INDEX


class Rejected(Exception):
    """A metric that can't run on a dataset; ``payload`` is what the outcome records."""

    def __init__(self, error: str, **more) -> None:
        super().__init__(error)
        self.payload = {"error": error, **more}


@dataclass
class Metric:
    """One metric bound to a dataset's columns.

    ``derive`` adds columns named ``__<metric>_...``; ``counters`` are global aggregates over them;
    ``tables`` and ``examples`` build small DataFrames from the derived frame, which the runner
    collects (examples only if their ``wanted`` counters are above zero); ``finish`` turns it all
    into the result. ``finish`` may raise :class:`Rejected`.
    """

    metric_id: str
    counters: dict[str, Column]
    finish: Callable[[dict, dict[str, list], dict[str, list]], dict]
    derive: Callable[[DataFrame], DataFrame] = lambda df: df
    tables: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    examples: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    wanted: dict[str, tuple[str, ...]] = field(default_factory=dict)
    row_index: bool = False
    extra: dict = field(default_factory=dict)

    def counts(self, df: DataFrame) -> DataFrame:
        """One row with all counters."""
        return self.derive(df).agg(*[c.alias(n) for n, c in self.counters.items()])

    def table(self, df: DataFrame, name: str) -> DataFrame:
        return self.tables[name](self.derive(df))

    def example(self, df: DataFrame, name: str) -> DataFrame:
        return self.examples[name](self.derive(df))


def rows() -> Column:
    return F.count(F.lit(1))


def count_if(predicate: Column) -> Column:
    """Rows for which the predicate is true, as a long; 0 for no rows."""
    return F.count_if(predicate)


def total(columns: list[Column]) -> Column:
    """The sum of several counters."""
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def ratio(part: int, whole: int, empty: float | None = 0.0) -> float | None:
    """Rounded to six places as Python rounds; ``empty`` for a zero denominator."""
    return round(part / whole, 6) if whole else empty


def verdict(value: float, good: float, fair: float) -> str:
    return "pass" if value >= good else "warn" if value >= fair else "fail"


def first_rows(mask: Column, reason: Column, limit: int) -> Callable[[DataFrame], DataFrame]:
    """The first ``limit`` rows, in file order, for which ``mask`` holds, with a reason."""
    return lambda df: df.filter(mask).select(F.col(ROW_INDEX), reason.alias("reason")).orderBy(ROW_INDEX).limit(max(0, limit))


def parameters(spec: dict) -> dict:
    return spec.get("calculation", {}).get("parameters", {})


def requirements(spec: dict) -> dict:
    return spec.get("input_requirements", {})


def mapped_fields(df: DataFrame, spec: dict, required: list[str]) -> dict[str, str]:
    """The field map, after checking that required keys are mapped and their columns there."""
    fields = requirements(spec).get("field_map", {})
    error = f"Missing required fields for {spec['metric_id']}."
    if unmapped := [k for k in required if k not in fields]:
        raise Rejected(error, missing_fields=unmapped)
    if absent := [fields[k] for k in required if fields[k] not in df.columns]:
        raise Rejected(error, missing_fields=absent)
    return fields
