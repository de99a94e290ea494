"""SimHash near-dedup by deletion-variant signatures.

Fingerprints that differ in at most 2 of 64 bits have, of their two 32-bit segments, one that differs
in at most one bit. Each distinct fingerprint is indexed under one-wildcard variants of its segments and
under whole ones, each with as much of the other segment as must agree then; fingerprints that share an entry are
joined by equality and verified on all 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import UPPER, few_files, map_arrow, materialize, salted, slices, with_salt
from assayer.llm.components import connected_components

_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def bits_set(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (uint64) have each of the 64 bits set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """The bits that more than half of ``n`` hashes have set."""
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, width: int = 3) -> int:
    """The 64-bit SimHash of a text's ``width``-word shingles (all of them, repeats included).

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A text of fewer words has
    one shingle, all its words; a text without words has fingerprint 0. A bit is set if it is set in
    more than half of the shingles' XXH64 (seed 42).
    """
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    ends = starts[1:] - 1
    ends = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        ones += bits_set(np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + 65536].tolist(), ends[at : at + 65536].tolist())][: n - at], dtype="<u8"))
    return majority(ones, n)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id long and fp long (the fingerprint's bits as a signed long) of every row; null text is empty.

    Null ids and repeated rows are kept, an empty table gives no rows. A text's shingles are hashed 65,536
    at a time; beside them a long text takes some 100 bytes a word for its words and their places.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).cast(pa.binary())
                values = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", width) for x in texts]
                yield {"doc_id": part.column(0), "fp": pa.array(np.array(values, dtype="<u8").view("<i8"))}

    return map_arrow(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, fp long")


def index_slots(max_bits: int) -> list[tuple[int, int | None]]:
    """(kept bits, wildcard bit) of each entry that a fingerprint is indexed under.

    Of two segments, one differs in no bit or in exactly one. What the rest of the budget leaves to the other segment
    is asked of the entry as well: for up to 2 bits it keeps a half of that segment that agrees, or, where
    both halves differ in a bit, its first half with a second wildcard instead. For 3 bits the segment stands alone.
    """
    segments = (0xFFFFFFFF, 0xFFFFFFFF << 32)
    halves = ((0xFFFF, 0xFFFF << 16), (0xFFFF << 32, 0xFFFF << 48))
    if max_bits == 3:
        return [(seg, None) for seg in segments] + [(seg & ~(1 << p), p) for i, seg in enumerate(segments) for p in range(32 * i, 32 * i + 32)]
    slots: list[tuple[int, int | None]] = [(segments[i] | half, None) for i in (0, 1) for half in halves[1 - i]]
    if max_bits == 2:
        slots += [(segments[1 - i] | halves[i][0] & ~(1 << p), p) for i in (0, 1) for p in range(32 * i, 32 * i + 16)]
        slots += [(segments[0] & ~(1 << p) | half, p) for p in range(32) for half in halves[1]]
    return slots


def link_fingerprints(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``) that differ in 1 to ``max_bits`` bits.

    64 bits are cut into the fewest segments (2 for up to 3 bits) of which one must differ by one bit
    at most. Pairs that agree on all an entry keeps meet there; under a wildcard, one has the bit and the other
    not. For up to 2 bits an entry keeps 47 or 48 bits, so few unlike fingerprints meet, and each edge is found
    once: by a whole entry if one bit or half a segment differs, else by one wildcard. For 3 bits it keeps 31
    or 32, and an edge is found at most once per segment. An empty table gives no rows.
    """
    if not 1 <= max_bits <= 3:
        raise ValueError("max_bits must be 1 to 3: two segments")
    slots = [F.struct(F.lit(mask - (mask >> 63 << 64)).cast("long").alias("mask"), F.lit(-1 if bit is None else bit).alias("bit")) for mask, bit in index_slots(max_bits)]
    entry = distinct.select("fp", F.posexplode(F.array(*slots)).alias("slot", "s"))
    rest, side = F.col("fp").bitwiseAND(F.col("s.mask")), F.expr("(fp >> s.bit) & 1")
    wild = F.col("s.bit") >= 0
    # One long to shuffle and sort by: a hash of slot and kept bits whose last bit tells wildcards. All bits are verified.
    key = F.xxhash64("slot", rest).bitwiseAND(F.lit(-2)).bitwiseOR(wild.cast("long")).alias("key")
    left = entry.filter(~wild | (side == 0)).select(F.col("fp").alias("a"), key)
    right = entry.filter(~wild | (side == 1)).select(F.col("fp").alias("b"), key)
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    # Whole entries hold both sides; there the smaller fingerprint is a. A wildcard's pairs of one bit meet whole, too.
    near = F.when(F.col("key").bitwiseAND(F.lit(1)) == 1, (apart == 2) if max_bits == 2 else (apart <= max_bits)).otherwise((apart <= max_bits) & (F.col("a") < F.col("b")))
    # Merged by hint: Spark's estimate leaves out that a fingerprint has so many entries, and would broadcast millions of them.
    return left.join(right.hint("merge"), "key").filter(near).select("a", "b")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fp long and component_id: the smallest doc_id reachable over links of ``max_bits`` bits.

    One row per row of ``df``. Equal fingerprints are one node, so copies cost no pairs. Null ids
    keep their rows and are ignored as smallest id (a component of null ids only has a null id). Texts without
    words share fingerprint 0 and link like any other. An empty table gives no rows.
    """
    prints = materialize(fingerprints(df, id_col, text_col, width), "prints", spread=True)
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    edges = link_fingerprints(nodes.select("fp"), max_bits)
    parts = connected_components(edges)
    named = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("part"))
    named = materialize(named, "nodes")
    ids = named.groupBy("part").agg(F.min("first").alias("component_id"))
    classes = materialize(named.join(ids, "part").select("fp", "component_id"), "classes")
    joined = with_salt(prints, F.col("doc_id")).join(salted(classes).hint("merge"), ["fp", "__salt"])
    return joined.select("doc_id", "fp", "component_id")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles over all documents, linked at 2 or fewer differing bits."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return few_files(out).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
