"""Near copies by exact Jaccard similarity of word shingles, with SimHash and, beyond its distance, MinHash bands to find candidates.

Texts of equal words are one node. SimHash is operator 7's, over the shingles used here: nodes whose fingerprints
differ in at most BITS bits are found by its index, and each is compared with the smallest of them. Its index can't
reach pairs of similarity 0.8 that are some 10 of 64 bits apart; for these a node has BANDS * ROWS least hashes, and
nodes that agree on all ROWS of a band share a bucket. Each bucket's members are compared with its smallest node. Then, in
rounds, tasks look in the buckets that hold several components for the nearest nodes of other components:
first by sketches of four bits a hash, then by the hashes of the shingles, all of them or, of long texts, the LEAST
smallest. What they find leaves the task as KEEP pairs a node at most and is compared on the shingles
themselves. Rounds take up where the last one stopped, with more pairs each, until none is found. So a
large group of near copies costs some pairs a member, and all other pairs are told apart inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import UPPER, collect_garbage, discard, map_arrow, materialize, salted, slices, with_salt
from assayer.llm.components import connected_components
from assayer.llm.simhash import bits_set, link_fingerprints, majority

WIDTH = 5
#: A pair is linked if its Jaccard similarity is 4/5 at least.
OVER, UNDER = 4, 5
#: Bits in which the SimHash fingerprints of a candidate may differ.
BITS = 2
#: A pair at 0.8 shares no bucket with probability (1 - 0.8 ** 5) ** 32 = 3e-6, a closer one with less.
BANDS, ROWS = 32, 5
HASHES, LONGS = BANDS * ROWS, BANDS * ROWS // 16
#: Pairs a node in the first round and by how much more in each later one; nodes and pairs of a tile's comparison.
KEEP, MORE = 8, 4
TILE, AREA = 4096, 1 << 18
#: Hashes of a text's shingles that tasks compare; rows that a task takes at a time, of one bucket or many.
LEAST, SHELF = 512, 8192
#: By how many standard deviations an estimate from LEAST hashes may fall short.
DEVIATIONS = 5.3
#: Sketch digits of 160 in which a candidate may differ: 30 are expected at 0.8, with a deviation of 4.9.
MOST_DIGITS = 56

_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 2**64, HASHES, dtype=np.uint64, endpoint=False)
_MIX = np.uint64(0x9E3779B97F4A7C15)
MAX = np.uint64(2**64 - 1)


def shingles(text: bytes) -> list[bytes]:
    """The runs of WIDTH words (as fingerprints see words), with repeats; all words of a shorter text; none without words."""
    words = text.translate(_LOWER).split()
    return [b" ".join(words[i : i + WIDTH]) for i in range(max(1, len(words) - WIDTH + 1))] if words else []


def similar(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return UNDER * both >= OVER * (len(a) + len(b) - both)


def signature(text: bytes) -> tuple[bytes, int, np.ndarray, np.ndarray]:
    """A 128-bit digest of the words, the SimHash fingerprint, a bucket (uint64) for each band, and the sketch as LONGS uint64."""
    words = text.translate(_LOWER).split()
    digest = xxhash.xxh3_128_digest(b" ".join(words))
    hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles(text)] or [0], dtype=np.uint64)
    fp = majority(sum(bits_set(hashes[at : at + 65536]) for at in range(0, len(hashes), 65536)), len(hashes))
    hashes = np.unique(hashes)
    least = np.full(HASHES, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 512):
        part = hashes[at : at + 512][None, :] * _FACTORS[:, None]
        part += _SHIFTS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    mixed = (least ^ (least >> np.uint64(29))) * _MIX
    bands = np.zeros(BANDS, np.uint64)
    for row in mixed.reshape(BANDS, ROWS).T:
        bands = (bands ^ row) * _MIX
        bands ^= bands >> np.uint64(32)
    digits = (mixed >> np.uint64(60)).reshape(LONGS, 16) << np.arange(0, 64, 4, dtype=np.uint64)
    return digest, fp, bands, np.bitwise_or.reduce(digits, axis=1)


def _signatures(df: DataFrame) -> DataFrame:
    """key, doc_id, the digest as h1 and h2, fingerprint, buckets and sketch of every row; null text is empty."""

    def longs(rows: list[np.ndarray]) -> pa.Array:
        flat = np.concatenate(rows).view("<i8")
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(rows[0])), pa.array(flat))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                texts = part.column(2).cast(pa.binary())
                digests, prints, bands, sketches = zip(*[signature(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in texts])
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield {"key": part.column(0), "doc_id": part.column(1), "h1": pa.array(halves[:, 0].copy()), "h2": pa.array(halves[:, 1].copy()), "fp": pa.array(np.array(prints, "<u8").view("<i8")), "buckets": longs(bands), "sketch": longs(sketches)}

    return map_arrow(df, run, "key long, doc_id long, h1 long, h2 long, fp long, buckets array<long>, sketch array<long>")


def _by_simhash(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node and fp): each with the smallest of its fingerprint, and that one with the smallest
    whose fingerprint differs in 1 to BITS bits. So a node brings two pairs at most, whatever its group's size."""
    prints = materialize(nodes.groupBy("fp").agg(F.min("node").alias("least")), "prints")
    equal = with_salt(nodes.select("node", "fp"), F.col("node")).join(salted(prints).hint("merge"), ["fp", "__salt"]).filter("node <> least")
    edges = materialize(link_fingerprints(prints.select("fp"), BITS), "print-links")
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    nearest = both.join(prints.select(F.col("fp").alias("v"), F.col("least").alias("there")), "v").groupBy("u").agg(F.min("there").alias("there"))
    near = nearest.join(prints.select(F.col("fp").alias("u"), F.col("least").alias("here")), "u")
    pairs = equal.select(F.col("least").alias("a"), F.col("node").alias("b")).unionByName(near.select(F.least("here", "there").alias("a"), F.greatest("here", "there").alias("b")))
    pairs = materialize(pairs.distinct(), "simhash-pairs")
    discard(prints, edges)
    return pairs


def _digits_apart(a: str, b: str) -> Column:
    """In how many of the sketches' digits columns a0, a1, ... and b0, b1, ... differ."""
    each = []
    for i in range(LONGS):
        x = F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        each.append(F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111))))
    return sum(each[1:], each[0])


def _side(members: DataFrame, name: str, *more: str) -> DataFrame:
    return members.select("band", "bucket", F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in more], *[F.col(f"s{i}").alias(f"{name}{i}") for i in range(LONGS)])


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingles are similar; ``texts`` has key and text."""

    def run(batches):
        known: dict[int, set[bytes]] = {}
        held = 0
        for batch in batches:
            for part in slices(batch, 2):
                columns = [part.column(i) for i in range(4)]
                linked = []
                for row in range(part.num_rows):
                    if held > 200_000:
                        known, held = {}, 0
                    sets = []
                    for key, text in ((columns[0][row].as_py(), columns[2][row]), (columns[1][row].as_py(), columns[3][row])):
                        if key not in known:
                            known[key] = set(shingles((text.as_py() or "").encode()))
                            held += len(known[key])
                        sets.append(known[key])
                    linked.append(similar(*sets))
                mask = pa.array(linked, pa.bool_())
                yield {"a": columns[0].filter(mask), "b": columns[1].filter(mask)}

    pairs = materialize(pairs.select("a", "b").distinct(), "pairs")
    named = materialize(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "named")
    some = materialize(texts.select("key", "text").join(named, "key", "left_semi"), "texts")
    both = pairs.join(some.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").join(some.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    links = materialize(map_arrow(both.select("a", "b", "text_a", "text_b"), run, "a long, b long"), "links")
    discard(pairs, named, some)
    return links


def _apart(sketch: np.ndarray, others: np.ndarray) -> np.ndarray:
    """In how many digits each of the sketches (n, LONGS) differs from each of the others."""
    x = sketch[:, None, :] ^ others[None, :, :]
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=2, dtype=np.int16)


def _hashes(df: DataFrame) -> DataFrame:
    """node, count and hashes of each text: the LEAST smallest of its distinct shingles' XXH64, in order."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column(1).cast(pa.binary())]
                found = [np.unique(np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles(t)] or [0], dtype=np.uint64)) for t in texts]
                yield {"node": part.column(0), "count": [len(x) for x in found], "hashes": [x[:LEAST].tobytes() for x in found]}

    return map_arrow(df, run, "node long, count int, hashes binary")


def _likely(u: np.ndarray, u_top: np.uint64, others: list[np.ndarray], tops: np.ndarray) -> np.ndarray:
    """Which sets of hashes may be similar to ``u``. Sets are whole up to their top; exact where both are whole."""
    starts = np.cumsum([0, *map(len, others[:-1])])
    flat = np.concatenate(others)
    top = np.minimum(tops, u_top)
    inside = flat <= np.repeat(top, [len(x) for x in others])
    at = np.minimum(np.searchsorted(u, flat), len(u) - 1)
    both = np.add.reduceat((u[at] == flat) & inside, starts, dtype=np.int64)
    union = np.searchsorted(u, top, "right") + np.add.reduceat(inside, starts, dtype=np.int64) - both
    slack = np.where(top == MAX, 0.0, DEVIATIONS * np.sqrt(OVER * (UNDER - OVER) * np.maximum(union, 1)))
    return UNDER * both + slack >= OVER * union


def _tile_pairs(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each pair of tiles in a sorted frame, the rows to find mates for and those to find them among; both ways for unlike tiles."""
    place = pdf[["band", "bucket", "i", "j"]].to_numpy()
    side, seen_d = pdf["side"].to_numpy(), pdf["seen_d"].to_numpy()
    edges = np.nonzero((place[1:] != place[:-1]).any(axis=1))[0] + 1
    for first, end in zip([0, *edges], [*edges, len(pdf)]):
        here = np.arange(first, end)
        for mine, theirs in [(0, 0)] if place[first, 2] == place[first, 3] else [(0, 1), (1, 0)]:
            left, right = here[(side[here] == mine) & (seen_d[here] <= HASHES)], here[side[here] == theirs]
            if len(right):
                step = max(1, AREA // len(right))
                yield from ((left[at : at + step], right) for at in range(0, len(left), step))


def _sketch_mates(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(u, v, d) as rows of a sorted frame: near sketches of other components behind u's cursor, rows of u together."""
    sketch = pdf[[f"s{i}" for i in range(LONGS)]].to_numpy(np.int64).view(np.uint64)
    node, part, seen_d, seen_v = (pdf[c].to_numpy() for c in ("node", "part", "seen_d", "seen_v"))
    for rows, right in _tile_pairs(pdf):
        d = _apart(sketch[rows], sketch[right])
        later = (d > seen_d[rows, None]) | ((d == seen_d[rows, None]) & (node[None, right] > seen_v[rows, None]))
        a, b = np.nonzero((d <= MOST_DIGITS) & later & (part[rows, None] != part[None, right]))
        yield rows[a], right[b], d[a, b]


ORDER = ["band", "bucket", "i", "j", "node"]


def _with_mates(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of nodes that have near sketches among their tiles, or are such."""
    pdf = pdf.sort_values(ORDER, kind="stable")
    kept = np.zeros(len(pdf), bool)
    for u, v, _ in _sketch_mates(pdf):
        kept[u] = kept[v] = True
    return pdf[kept]


def _best(pdf: pd.DataFrame, keep: int) -> pd.DataFrame:
    """u, v, d: for each node the ``keep`` nearest of other components in its bucket's tiles and behind its cursor, by (d, v)."""
    pdf = pdf.sort_values(ORDER, kind="stable")
    node = pdf["node"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]
    tops = np.array([x[-1] if n > len(x) else MAX for x, n in zip(sets, pdf["count"])], np.uint64)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int16))]
    for u, v, d in _sketch_mates(pdf):
        good = np.zeros(len(u), bool)
        starts = np.nonzero(np.diff(u, prepend=-1))[0]
        for x, y in zip(starts, [*starts[1:], len(u)]):
            good[x:y] = _likely(sets[u[x]], tops[u[x]], [sets[m] for m in v[x:y]], tops[v[x:y]])
        u, v, d = u[good], v[good], d[good]
        order = np.lexsort((v, d, u))
        u, v, d = u[order], v[order], d[order]
        first = np.arange(len(u)) - np.searchsorted(u, u) < keep
        out.append((node[u[first]], node[v[first]], d[first]))
    u, v, d = (np.concatenate(x) for x in zip(*out))
    return pd.DataFrame({"u": u, "v": v, "d": d.astype(np.int32)})


def _open(members: DataFrame, parts: DataFrame) -> DataFrame:
    """The buckets that hold several components: band, bucket, nodes n and tiles."""
    placed = members.select("band", "bucket", "node").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    found = placed.groupBy("band", "bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("n"))
    return materialize(found.filter("low <> high").select("band", "bucket", "n", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "open")


def _in_open(rows: DataFrame, open_: DataFrame) -> DataFrame:
    return with_salt(rows, F.col("node")).join(salted(open_), ["band", "bucket", "__salt"]).drop("__salt", "n")


def _nearest(members: DataFrame, parts: DataFrame, open_: DataFrame, hashes: DataFrame, cursor: DataFrame | None, keep: int) -> DataFrame:
    """u and best, its ``keep`` nearest (d, v) of other components that share an open bucket with it, behind its cursor; only nodes that have any.

    A bucket of more than TILE nodes is dealt to pairs of tiles; small ones share a task. Hashes travel only
    to the tiles where a node has near sketches. A task returns ``keep`` rows a node and bucket at most.
    """
    rows = _in_open(members, open_).join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    if cursor is None:
        rows = rows.withColumns({"seen_d": F.lit(-1), "seen_v": F.lit(0).cast("long")})
    else:
        rows = rows.join(cursor.withColumnRenamed("u", "node"), "node", "left").fillna(HASHES + 1, ["seen_d"]).fillna(0, ["seen_v"])
    spots = F.expr("transform(sequence(0, tiles - 1), k -> struct(least(t, k) as i, greatest(t, k) as j, if(k < t, 1, 0) as side))")
    dealt = rows.withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("p", F.explode(spots)).select("*", "p.*").drop("p", "t", "tiles")
    shelves = (open_.agg(F.sum(F.col("n") * F.col("tiles"))).first()[0] or 0) // SHELF + 1
    shelf = F.pmod(F.xxhash64(*ORDER[:-1]), F.lit(shelves)).alias("shelf")
    close = dealt.groupBy(shelf).applyInPandas(_with_mates, dealt.schema)
    near = close.join(hashes, "node").groupBy(shelf).applyInPandas(lambda pdf: _best(pdf, keep), "u long, v long, d int")
    best = near.groupBy("u").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "v"))), 1, keep).alias("best"))
    return materialize(best, "nearest")


def near_copies(df: DataFrame) -> DataFrame:
    """key, doc_id and component (a key) of every row of ``df``: key long (unique), doc_id long, text string.

    Rows are linked at Jaccard similarity 0.8 or more of their sets of five-word shingles.
    ``df`` is read several times and must give the same rows each time. Null text is empty, texts without
    words are alike, shorter texts than five words are one shingle; no rows give none.
    """
    rows = materialize(_signatures(df.select("key", "doc_id", "text")), "signatures", spread=True)
    nodes = materialize(rows.groupBy("h1", "h2").agg(F.min("key").alias("node"), F.min("fp").alias("fp")), "nodes")
    one = rows.join(nodes.select(F.col("node").alias("key")), "key", "left_semi").withColumnRenamed("key", "node")
    one = materialize(one.select("node", "buckets", *[F.col("sketch")[i].alias(f"s{i}") for i in range(LONGS)]), "sketches")

    entries = one.select("node", F.posexplode("buckets").alias("band", "bucket"))
    shared = entries.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).filter("n > 1").drop("n")
    shared = materialize(shared, "shared")
    met = with_salt(entries, F.col("node")).join(salted(shared), ["band", "bucket", "__salt"]).drop("__salt")
    kept = materialize(met.join(one.drop("buckets"), "node"), "members")
    discard(one, shared)

    close = _digits_apart("a", "b") <= MOST_DIGITS
    least = salted(_side(kept.filter("node = least"), "a"))
    others = with_salt(_side(kept.filter("node <> least"), "b"), F.col("b"))
    alike = _by_simhash(nodes)
    first = _compared(others.join(least, ["band", "bucket", "__salt"]).filter(close).select("a", "b").unionByName(alike), df)

    members = kept.drop("least")
    parts = connected_components(first)
    open_ = _open(members, parts)
    wanted = _in_open(members.select("band", "bucket", "node"), open_).select("node").distinct()
    hashes = materialize(_hashes(df.select(F.col("key").alias("node"), "text").join(wanted, "node", "left_semi").select("node", "text")), "hashes", spread=True)
    cursor, keep = None, KEEP
    while True:
        collect_garbage(df.sparkSession)
        found = _nearest(members, parts, open_, hashes, cursor, keep)
        discard(open_)
        if found.isEmpty():
            break
        pairs = found.select("u", F.explode("best").alias("b")).select(F.least("u", "b.v").alias("a"), F.greatest("u", "b.v").alias("b"))
        links = _compared(pairs, df)
        last = F.element_at("best", -1)
        ended = F.size("best") < keep
        step = found.select("u", F.when(ended, HASHES + 1).otherwise(last["d"]).cast("int").alias("seen_d"), F.when(ended, F.lit(0)).otherwise(last["v"]).alias("seen_v"))
        cursor = materialize(step if cursor is None else step.unionByName(cursor.join(step, "u", "left_anti")), "cursor")
        keep *= MORE
        if not links.isEmpty():
            # The components so far stand for all links before, a link a node; so few rounds join them.
            parts = connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))
        discard(links)
        open_ = _open(members, parts)
    named = materialize(nodes.join(parts, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component")), "classes")
    grouped = with_salt(rows.select("key", "doc_id", "h1", "h2"), F.col("key")).join(salted(named), ["h1", "h2", "__salt"]).select("key", "doc_id", "component")
    grouped = materialize(grouped, "groups")
    discard(rows, nodes, alike, found, hashes, named, kept, first)
    return grouped
