"""Timestamp coherence: differences of neighbouring timestamps in arrival order, without one global window.

Rows are cut into chunks by their order number; differences inside a chunk come from a window over the
chunk. Each chunk leaves one row, with its first and last timestamp; the differences between chunks come
from a window over those rows, one for about a million packets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.operators.base import Metric, Rejected, parameters, rows

#: Rows of a chunk, if order numbers are dense.
CHUNK = 1 << 20


def gap_facts(df: DataFrame, order: str | list[str] = "packet_index", ts: str = "ts", threshold=1.0, chunk: int = CHUNK) -> DataFrame:
    """One row: packet_count, first and last timestamp, backwards, zero and large counts, gap_count, gap_sum, gap_max.

    A negative difference is a backwards jump and no gap; a large gap is longer than ``threshold``. The
    numbers have the type of ``ts``. NULL timestamps are left out. ``order`` is a long, unique, or unique
    behind the columns named before it (a file, say), which then come first in the order.
    """
    *groups, last = [order] if isinstance(order, str) else order
    place = F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)], F.floor(F.col(last) / chunk).alias("c"))
    plain = df.select(F.col(last).alias("o"), F.col(ts).alias("t"), place.alias("c")).filter("t is not null")
    inner = plain.withColumn("d", F.col("t") - F.lag("t").over(W.partitionBy("c").orderBy("o")))

    def parts(d):
        gap = d >= 0
        return [
            F.count_if(d < 0).alias("backwards"), F.count_if(d == 0).alias("zero"), F.count_if(d > threshold).alias("large"),
            F.count_if(gap).alias("gaps"), F.sum(F.when(gap, d)).alias("total"), F.max(F.when(gap, d)).alias("longest"),
        ]

    chunks = inner.groupBy("c").agg(rows().alias("n"), F.min_by("t", "o").alias("first"), F.max_by("t", "o").alias("last"), *parts(F.col("d")))
    seams = chunks.withColumn("d", F.col("first") - F.lag("last").over(W.orderBy("c")))
    summed = seams.agg(
        F.sum("n").alias("n"), F.min_by("first", "c").alias("first"), F.max_by("last", "c").alias("last"),
        *[F.sum(x).alias(x) for x in ("backwards", "zero", "large", "gaps", "total")], F.max("longest").alias("longest"),
        *[p.alias(f"seam_{name}") for p, name in zip(parts(F.col("d")), ("backwards", "zero", "large", "gaps", "total", "longest"))],
    )
    both = lambda name: (F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(f"seam_{name}"), F.lit(0))).alias(name)
    merged = summed.select("n", "first", "last", *[both(x) for x in ("backwards", "zero", "large", "gaps", "total")], F.greatest("longest", "seam_longest").alias("longest"))
    return merged.select(
        F.coalesce("n", F.lit(0)).cast("long").alias("packet_count"), F.col("first").alias("first_timestamp"), F.col("last").alias("last_timestamp"),
        F.col("backwards").alias("backwards_jump_count"), F.col("zero").alias("zero_delta_count"), F.col("large").alias("large_gap_count"),
        F.col("gaps").alias("gap_count"), F.col("total").alias("gap_sum"), F.col("longest").alias("gap_max"),
    )


def gap_result(f: dict, threshold: float) -> dict:
    """The metric's result from the fold's numbers in seconds."""
    n = f["packet_count"]
    if not n:
        raise Rejected("PCAP contains no packets.")
    gaps = f["gap_count"]
    return {
        "packet_count": n, "first_timestamp": f["first_timestamp"], "last_timestamp": f["last_timestamp"],
        "capture_duration_seconds": round(f["last_timestamp"] - f["first_timestamp"], 6) if n > 1 else 0.0,
        "backwards_jump_count": f["backwards_jump_count"], "zero_delta_count": f["zero_delta_count"], "large_gap_count": f["large_gap_count"],
        "large_gap_threshold_seconds": threshold, "gap_count": gaps,
        "mean_gap_seconds": round(f["gap_sum"] / gaps, 6) if gaps else None, "max_gap_seconds": round(f["gap_max"], 6) if gaps else None,
        "status": "warn" if f["backwards_jump_count"] else "pass",
    }


def timestamp_coherence(df: DataFrame, spec: dict) -> Metric:
    """Over packets: columns packet_index and ts."""
    threshold = float(parameters(spec).get("large_gap_threshold_seconds", 1.0))
    if not {"packet_index", "ts"} <= set(df.columns):
        raise Rejected("Failed to scan PCAP timestamps: not a packet capture")
    return Metric(spec["metric_id"], {}, lambda c, tables, e: gap_result(tables["facts"][0], threshold), tables={"facts": lambda d: gap_facts(d, threshold=threshold)})
