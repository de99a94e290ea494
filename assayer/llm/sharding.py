"""Sharding by histogram sort: probe, count bytes exactly, refine, exchange once.

Rows are ordered by a composite key of fixed width, written as hexadecimal digits, so that a
candidate boundary is a digit prefix. Each round counts exact bytes and rows under every child
prefix of the prefixes that still hold a splitter; it ends when the splitters meet the tolerance.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.llm.common import few_files, literal_table, materialize

#: Digits of the first round and of each later round, and of the whole key (three 64-bit parts).
FIRST, STEP, WIDTH = 3, 2, 48
#: Most parts, and so most splitters held by the driver, however large the input.
MAX_PARTS = 16384
#: Beyond so many open prefixes a round takes a single digit, so that a round's counts stay under 16 * MAX_PARTS.
WIDE_STEP = 1024


@dataclass
class _Splitter:
    target: int
    prefix: str = ""
    below_bytes: int = 0
    below_rows: int = 0
    mass: int = 0
    cut: str | None = None


def _digits(part: Column) -> Column:
    """Sixteen hexadecimal digits that sort as the signed long does; null sorts first, with the least long."""
    return F.lpad(F.hex(F.coalesce(part, F.lit(-(2**63))).bitwiseXOR(F.lit(-(2**63)))), 16, "0")


def find_splitters(keyed: DataFrame, targets: list[int], total: int, tolerance: int) -> list[tuple[str, int, int]]:
    """Boundaries (key prefix, bytes below, rows below), one for each target of bytes below.

    ``keyed`` has ``__key`` (hex digits) and ``__bytes``. Each round is one aggregation with map-side
    partial sums; what reaches the driver is at most 16 counts a target, or WIDE_STEP * 256 (4,096 in the first).
    """
    marks = [_Splitter(t, mass=total) for t in targets]
    depth = 0
    open_marks = [m for m in marks if m.cut is None]
    while open_marks:
        open_prefixes = sorted({m.prefix for m in open_marks})
        width = FIRST if not depth else min(STEP if len(open_prefixes) <= WIDE_STEP else 1, WIDTH - depth)
        rows_in = keyed
        if depth:
            prefixes = literal_table(keyed.sparkSession, [{"__p": p} for p in open_prefixes], "__p: string")
            rows_in = keyed.withColumn("__p", F.substring("__key", 1, depth)).join(F.broadcast(prefixes), "__p", "left_semi")
        counted = rows_in.groupBy(F.substring("__key", 1, depth + width).alias("c")).agg(F.sum("__bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect()
        children: dict[str, list] = {}
        for r in sorted(counted):
            children.setdefault(r["c"][:depth], []).append(r)
        depth += width
        for m in open_marks:
            at_bytes, at_rows = m.below_bytes, m.below_rows
            last = None
            for r in children[m.prefix]:
                if at_bytes + r["b"] > m.target:
                    last = r
                    break
                at_bytes, at_rows = at_bytes + r["b"], at_rows + r["n"]
            if last is None:  # the target lies at the very end of this prefix
                m.cut, m.below_bytes, m.below_rows = m.prefix + "g", at_bytes, at_rows
                continue
            m.prefix, m.below_bytes, m.below_rows, m.mass = last["c"], at_bytes, at_rows, last["b"]
            after = at_bytes + last["b"] - m.target
            if min(m.target - at_bytes, after) <= tolerance or depth >= WIDTH or last["n"] == 1:
                low = m.target - at_bytes <= after
                m.cut = m.prefix if low else m.prefix + "g"  # "g" sorts behind every digit
                if not low:
                    m.below_bytes, m.below_rows = at_bytes + last["b"], at_rows + last["n"]
        open_marks = [m for m in marks if m.cut is None]
    out, floor = [], ("", 0, 0)
    for m in marks:
        floor = max(floor, (m.cut, m.below_bytes, m.below_rows), key=lambda x: x[2])
        out.append(floor)
    return out


def histogram_shards(
    df: DataFrame,
    n_shards: int,
    size: Column,
    keys: tuple[Column, Column],
    payload: list[Column],
    tolerance: float = 0.0005,
    part_bytes: int = 32 << 20,
) -> DataFrame:
    """Put all rows into ``n_shards`` shards of near-equal size, in the order of ``keys``.

    :param size: bytes of a row, a long; null counts as 0.
    :param keys: two long columns to sort by, nulls first; ties are parted by a row number, so even
        rows equal in everything spread over shards.
    :param payload: columns to carry through the exchange (whole rows, or just what the caller needs).
    :param tolerance: by how much of a shard's mean size a boundary may miss its place
        (one row's size may be missed in any case).
    :returns: the payload, ``shard`` int and ``slot`` long, the row's gapless place in its shard.
        Payload columns of those names are replaced. An empty table gives no rows.

    Shards are cut further into parts of about ``part_bytes`` (larger beyond 16,384 parts), so that no task holds a whole shard;
    a part's rows are numbered from the exact count of rows below its boundary.
    """
    spark = df.sparkSession
    named = df.select(*payload).drop("shard", "slot").columns
    keyed = materialize(
        df.select(*payload, F.coalesce(size, F.lit(0)).cast("long").alias("__bytes"), keys[0].alias("__k1"), keys[1].alias("__k2"), F.monotonically_increasing_id().alias("__k3")).select(*named, "__bytes", "__k1", "__k2", "__k3"),
        "keyed",
        spread=True,
    )
    total, rows = keyed.agg(F.coalesce(F.sum("__bytes"), F.lit(0)), F.count(F.lit(1))).first()
    keyed = keyed.withColumn("__key", F.concat(_digits(F.col("__k1")), _digits(F.col("__k2")), _digits(F.col("__k3"))))
    per_shard = max(1, min(-(-total // (n_shards * part_bytes)), MAX_PARTS // n_shards))
    n_parts = n_shards * per_shard
    targets = [total * i // n_parts for i in range(1, n_parts)]
    cuts = find_splitters(keyed, targets, total, int(total * tolerance / n_shards)) if rows else []
    first_row = [0, *(c[2] for c in cuts)] if rows else [0] * n_parts

    # A row's part is the number of cuts at or below its key. A table of the first digits gives the cuts
    # below the digits' range and lists those inside it: 4,096 rows, and all cuts once.
    names = sorted(c[0] for c in cuts)
    lookup = []
    for i in range(16**FIRST if cuts else 0):
        head = f"{i:0{FIRST}X}"
        low, high = bisect_right(names, head), bisect_left(names, head + "h")
        lookup.append({"__h": head, "__base": low, "__cuts": names[low:high]})
    parts = literal_table(spark, [{"__part": i, "__first": first_row[i] - first_row[i // per_shard * per_shard]} for i in range(n_parts)], "__part: int, __first: bigint")
    if cuts:
        table = literal_table(spark, lookup, "__h: string, __base: int, __cuts: array<string>")
        placed = keyed.withColumn("__h", F.substring("__key", 1, FIRST)).join(F.broadcast(table), "__h")
        placed = placed.withColumn("__part", F.col("__base") + F.size(F.filter("__cuts", lambda c: c <= F.col("__key"))))
    else:
        placed = keyed.withColumn("__part", F.lit(0))
    numbered = placed.withColumn("__row", F.row_number().over(W.partitionBy("__part").orderBy("__k1", "__k2", "__k3")))
    return numbered.join(F.broadcast(parts), "__part").select(
        *named,
        F.expr(f"__part div {per_shard}").cast("int").alias("shard"),
        (F.col("__first") + F.col("__row") - 1).alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the shards as Parquet folders ``shard=N``."""
    sharded.write.partitionBy("shard").parquet(path)


def op1_histogram_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards near equal in bytes, ordered by a hash of the text, then doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.col("text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    payload = [F.col("doc_id"), size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")]
    out = histogram_shards(docs, 24, size, (F.xxhash64(text), F.col("doc_id").cast("long")), payload)
    return few_files(out).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
