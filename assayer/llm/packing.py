"""Best-two-fit packing of token sequences.

Which lengths share a bin depends on nothing but how many pieces of each length there are, at most
``capacity`` counts. The bins are planned on those counts: a plan step fills one bin greedily, then
replaces its smallest document with the two unpacked ones that fit the expanded gap more tightly, and
repeats that bin for as long as the greedy choice would be the same. Pieces then find their place by
their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import bucket_rank, few_files, hidden, map_arrow, materialize, shown, slices

#: The id that ends a document.
END = 2


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a bin in descending order, number of such bins), covering all counts exactly."""
    left = {k: v for k, v in counts.items() if v > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("lengths must be 1 to capacity")
    free = sorted(left)
    plan = []
    while free:
        used: Counter[int] = Counter()
        spent: list[int] = []  # lengths whose pieces are all in this bin

        def take(n: int) -> None:
            used[n] += 1
            if used[n] == left[n]:
                free.pop(bisect_right(free, n) - 1)
                spent.append(n)

        gap = capacity
        while gap and free and free[0] <= gap:
            n = free[bisect_right(free, gap) - 1]
            take(n)
            gap -= n
        while gap and sum(used.values()) > 1:
            least = min(used)
            room = gap + least
            best: tuple[int, int, int] | None = None
            for at in range(bisect_right(free, room) - 1, -1, -1):
                a = free[at]
                if best and 2 * a <= best[0]:
                    break
                low = bisect_right(free, min(room - a, a)) - 1
                if low < 0:
                    continue
                b = free[low]
                if b == a and left[a] - used[a] < 2:
                    if not low:
                        continue
                    b = free[low - 1]
                if a + b > (best[0] if best else least):
                    best = (a + b, a, b)
                    if best[0] == room:
                        break
            if not best:
                break
            take(best[1])
            take(best[2])
            used[least] -= 1
            if least in spent:
                spent.remove(least)
                insort(free, least)
            if not used[least]:
                del used[least]
            gap = room - best[0]
        times = min(left[n] // k for n, k in used.items())
        plan.append((tuple(sorted(used.elements(), reverse=True)), times))
        for n, k in used.items():
            left[n] -= k * times
            where = bisect_right(free, n) - 1
            there = where >= 0 and free[where] == n
            if left[n] and not there:
                insort(free, n)
            elif not left[n] and there:
                free.pop(where)
    return plan


class Places:
    """Turns (length, rank among its length) into (sequence, offset) under a plan."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]) -> None:
        segments: dict[int, list] = {}
        given: Counter[int] = Counter()
        base = 0
        for lengths, times in plan:
            offsets: dict[int, list[int]] = {}
            at = 0
            for n in lengths:
                offsets.setdefault(n, []).append(at)
                at += n
            for n, places in offsets.items():
                segments.setdefault(n, []).append((given[n], base, places))
                given[n] += times * len(places)
            base += times
        self.sequences = base
        self.tables = {}
        for n, found in segments.items():
            flat = [o for s in found for o in s[2]]
            uses = np.array([len(s[2]) for s in found])
            self.tables[n] = (np.array([s[0] for s in found]), np.array([s[1] for s in found]), uses, np.concatenate(([0], np.cumsum(uses)[:-1])), np.array(flat))

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for n in np.unique(lengths):
            rows = np.nonzero(lengths == n)[0]
            first, base, uses, start, flat = self.tables[int(n)]
            at = np.searchsorted(first, ranks[rows], "right") - 1
            k = ranks[rows] - first[at]
            sequence[rows] = base[at] + k // uses[at]
            offset[rows] = flat[start[at] + k % uses[at]]
        return sequence, offset


def pack(pieces: DataFrame, capacity: int = 1024, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """All rows of ``pieces`` with ``sequence_id`` and ``offset`` longs, packed by their ``length`` (1 to capacity).

    Columns of the new names are replaced. Equal rows and rows of null or repeated ids are packed one by one,
    told apart by a row number; an empty table gives no rows. The driver sees one count a length and the plan
    made from them.
    """
    named = pieces.drop("sequence_id", "offset")
    used = ("length", *order)
    pieces = named.select(*hidden(named, *used))
    kept = pieces.columns
    pieces = materialize(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces", spread=True)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = Places(plan_bins(counts, capacity))
    ranked = bucket_rank(pieces, ["length"], [*order, "__row"], sum(counts.values()), "__rank")

    def run(batches):
        for batch in batches:
            sequence, offset = places.find(batch.column("length").to_numpy(), batch.column("__rank").to_numpy())
            yield {c: batch.column(c) for c in kept} | {"sequence_id": sequence, "offset": offset}

    ddl = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes if c in kept)
    packed = map_arrow(ranked.select(*[f"`{c}`" for c in kept], "__rank"), run, f"{ddl}, sequence_id long, offset long")
    return packed.select(*shown(named, *used), "sequence_id", "offset")


@lru_cache(2)
def _encoder(path: str):
    """The ids of a byte-level BPE file. The merges become ranks, which give the same ids and faster."""
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import pre_tokenizers

    model = json.load(open(path, encoding="utf-8"))
    byte_of = _byte_letters()
    if model["model"]["type"] != "BPE" or set(pre_tokenizers.ByteLevel.alphabet()) != set(byte_of):
        raise ValueError("not a byte-level BPE")
    special = {t["content"] for t in model.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return out


def token_pieces(df: DataFrame, path: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ``ids``) of every document's pieces.

    A document is its text's ids (null: none) and the end id. Longer ones than ``capacity`` are cut;
    the first piece takes what doesn't fill a whole one. Texts of special tokens are ordinary text. Null ids
    and repeated rows are kept as they are; an empty table gives no rows. A long text takes some 40 bytes a
    token while it is cut.

    :param path: a byte-level BPE file of the tokenizers library that every executor has at that place.
    """

    def run(batches):
        encode = _encoder(path).encode_ordinary
        for batch in batches:
            for part in slices(batch, 1, 8 << 20):
                out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids)}
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.array([*encode(text or ""), END], dtype="<u4")
                    at, piece = 0, 0
                    while at < len(ids):
                        size = capacity if piece else (len(ids) - 1) % capacity + 1
                        cut = ids[at : at + size]
                        for name, value in zip(out, (doc, piece, at, size, zlib.crc32(cut.tobytes()), cut)):
                            out[name].append(value)
                        at, piece = at + size, piece + 1
                yield out

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_arrow(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, ddl)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """All documents as sequences of at most 1024 tokens."""
    import public_tokenizers

    pieces = token_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return few_files(pack(pieces))
