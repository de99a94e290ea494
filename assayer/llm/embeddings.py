"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance 2 - 2c. After a rotation that spreads the
energy, the coordinates are cut into low-dimensional blocks; of a close pair, at least one block lies
within that block's proportional share of the budget. The blocks' range joins run on tiles of rows, and
the union of what they admit is verified exactly.

A label's vectors are dealt to tiles in one of two ways, whichever exact counts show to be cheaper. Whole:
tiles of the label meet each other once, all blocks in the same task, where a pair that several
blocks admit is one candidate. By cells: each block has a grid over its first two coordinates, homes
meet the visitors of their cell, and a pair counts in the first block that admits it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import few_files, hash128, map_arrow, materialize, salted, with_salt
from assayer.llm.components import connected_components

#: Rows of a tile; a task compares two tiles at most, AREA pairs of them at a time.
TILE, AREA = 8192, 1 << 20
#: Room for rounding to 32 bits, relative and absolute, when a block admits a pair.
SLACK, SLACK_ABS = 1e-4, 4e-6
#: Neighbour cells that a point visits, half of the eight, so that each pair of cells meets once.
HALF = ((0, 1), (1, -1), (1, 0), (1, 1))
#: The block of entries of labels that are compared whole.
ALL_BLOCKS = -1


@lru_cache(8)
def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(20240229).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int, block_dim: int = 16) -> list[slice]:
    """Blocks of ``block_dim`` coordinates; a shorter rest joins the last one."""
    n = max(1, dim // block_dim)
    return [slice(i * block_dim, dim if i == n - 1 else (i + 1) * block_dim) for i in range(n)]


def _budgets(dim: int, cosine: float) -> list[float]:
    return [(2 - 2 * cosine) * (b.stop - b.start) / dim * (1 + SLACK) + SLACK_ABS for b in blocks(dim)]


def _cells(rot: list[bytes], cosine: float) -> dict[str, np.ndarray]:
    """row, block, cx, cy and role of each rotated vector's home cells (role 0) and the neighbour cells within reach (role 1)."""
    out: dict[str, list] = {k: [np.zeros(0, np.int64)] for k in ("row", "block", "cx", "cy", "role")}
    dims = np.array([len(x) // 4 for x in rot])
    for dim in np.unique(dims):
        rows = np.nonzero(dims == dim)[0]
        x = np.frombuffer(b"".join(rot[i] for i in rows), np.float32).reshape(len(rows), dim).astype(float)
        for k, (b, budget) in enumerate(zip(blocks(dim), _budgets(dim, cosine))):
            wide = 2 * budget**0.5
            p = x[:, b][:, :2] if b.stop - b.start > 1 else np.column_stack([x[:, b], np.zeros(len(rows))])
            cell = np.floor(p / wide).astype(np.int64)
            inside = p - cell * wide
            for dx, dy, role in [(0, 0, 0), *((dx, dy, 1) for dx, dy in HALF)]:
                off = [np.where(d > 0, wide - inside[:, a], np.where(d < 0, inside[:, a], 0.0)) for a, d in enumerate((dx, dy))]
                at = np.nonzero(off[0] ** 2 + off[1] ** 2 <= budget * (1 + SLACK))[0] if role else np.arange(len(rows))
                for name, v in (("row", rows[at]), ("block", np.full(len(at), k)), ("cx", cell[at, 0] + dx), ("cy", cell[at, 1] + dy), ("role", np.full(len(at), role))):
                    out[name].append(v)
    return {k: np.concatenate(v) for k, v in out.items()}


def _plans(reps: DataFrame, cosine: float) -> DataFrame:
    """label, dim and cells (boolean) of the labels of more than a tile: whether cells compare fewer blocks of pairs.

    Counts are exact. Whole, all blocks of every pair are compared; by cells, a block of the pairs that
    meet there. Cells must halve the work, since they also move each vector once for each entry.
    """

    def run(batches):
        for batch in batches:
            found = _cells(batch.column("rot").to_pylist(), cosine)
            kept = {c: batch.column(c).take(_index(found["row"])) for c in ("label", "dim")}
            yield kept | {c: found[c] for c in ("block", "cx", "cy", "role")}

    sizes = reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TILE)
    sizes = materialize(sizes, "labels")
    large = with_salt(reps.select("node", "label", "dim", "rot"), F.col("node")).join(salted(sizes), ["label", "dim", "__salt"])
    cells = map_arrow(large.select("label", "dim", "rot"), run, "label string, dim int, block int, cx long, cy long, role int")
    counts = cells.groupBy("label", "dim", "block", "cx", "cy").agg(F.count_if(F.col("role") == 0).cast("double").alias("h"), F.count_if(F.col("role") == 1).cast("double").alias("v"))
    work = counts.groupBy("label", "dim").agg(F.sum(F.col("h") * ((F.col("h") - 1) / 2 + F.col("v"))).alias("work"), F.countDistinct("block").alias("blocks"))
    whole = F.col("n") * (F.col("n") - 1) / 2 * F.col("blocks")
    return materialize(work.join(sizes, ["label", "dim"]).select("label", "dim", (F.col("work") * 2 < whole).alias("cells")), "plans")


def _entries(reps: DataFrame, plans: DataFrame, cosine: float) -> DataFrame:
    """A row for each place where a vector is compared: one of its label as a whole, or its cells."""

    def run(batches):
        for batch in batches:
            found = _cells(batch.column("rot").to_pylist(), cosine)
            kept = {c: batch.column(c).take(_index(found["row"])) for c in ("node", "label", "dim", "copies", "vec", "rot")}
            yield kept | {c: found[c] for c in ("block", "cx", "cy", "role")}

    schema = "node long, label string, dim int, copies long, vec binary, rot binary, block int, cx long, cy long, role int"
    by_cells = plans.filter("cells").select("label", "dim")
    whole = reps.join(by_cells, ["label", "dim"], "left_anti").select("node", "label", "dim", "copies", "vec", F.lit(None).cast("binary").alias("rot"), F.lit(ALL_BLOCKS).alias("block"), F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"), F.lit(0).alias("role"))
    cut = with_salt(reps, F.col("node")).join(salted(by_cells), ["label", "dim", "__salt"]).select("node", "label", "dim", "copies", "vec", "rot")
    return whole.unionByName(map_arrow(cut, run, schema))


def _index(rows: np.ndarray):
    import pyarrow as pa

    return pa.array(rows.astype(np.int64))


def _tiles(entries: DataFrame) -> DataFrame:
    """Deal a cell's rows to pairs of tiles (kind, i, j): homes among themselves, homes with visitors.

    Cells of up to TILE homes and visitors are one tile each; larger ones are cut by a hash of the node.
    """
    cell = ["label", "dim", "block", "cx", "cy"]
    counts = entries.groupBy(*cell).agg(F.count_if(F.col("role") == 0).alias("h"), F.count_if(F.col("role") == 1).alias("v"))
    counts = counts.filter((F.col("h") > 0) & (F.col("h") + F.col("v") > 1))
    sized = counts.select(*cell, F.ceil(F.col("h") / TILE).cast("int").alias("ht"), F.ceil(F.col("v") / TILE).cast("int").alias("vt"))
    rows = with_salt(entries, F.col("node")).join(salted(materialize(sized, "cells")), [*cell, "__salt"]).drop("__salt")
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("role") == 0, F.col("ht")).otherwise(F.col("vt"))).cast("int")
    rows = rows.withColumn("t", mine)
    spots = "struct<kind: int, i: int, j: int, side: int>"
    among = F.expr("transform(sequence(0, ht - 1), k -> struct(0 as kind, least(t, k) as i, greatest(t, k) as j, if(k < t, 1, 0) as side))")
    hosts = F.expr("if(vt = 0, array(), transform(sequence(0, greatest(vt - 1, 0)), k -> struct(1 as kind, t as i, k as j, 0 as side)))")
    visits = F.expr("transform(sequence(0, ht - 1), k -> struct(1 as kind, k as i, t as j, 1 as side))")
    places = F.when(F.col("role") == 0, F.concat(among.cast(f"array<{spots}>"), hosts.cast(f"array<{spots}>"))).otherwise(visits.cast(f"array<{spots}>"))
    kept = [*cell, "node", "copies", "vec", "rot"]
    return rows.select(*kept, F.explode(places).alias("p")).select(*kept, "p.*")


def _first_admits(rot: np.ndarray, a: np.ndarray, b: np.ndarray, block: int, cuts: list[slice], budgets: list[float]) -> np.ndarray:
    """Whether ``block`` is the first that admits each pair. Sums run in one fixed order: every tile decides alike."""
    admitted = np.ones(len(a), bool)
    for c in range(block + 1):
        d = rot[a][:, cuts[c]] - rot[b][:, cuts[c]]
        total = np.zeros(len(a))
        for e in range(d.shape[1]):
            total += d[:, e] * d[:, e]
        admitted &= total <= budgets[c] if c == block else total > budgets[c]
    return admitted


def _merge(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least members ``low`` of the groups so far, after linking the pairs (a, b)."""
    while True:
        x, y = low[a], low[b]
        apart = x != y
        if not apart.any():
            return low
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]


def _compare(pdf: pd.DataFrame, cosine: float, wide: bool) -> pd.DataFrame:
    """Verified links of a pair of tiles: for each node its links, and the least node of its group there.

    AREA pairs are held at a time, so memory doesn't depend on how many are linked.
    """
    dim, block, kind, i, j = (int(pdf[c].iat[0]) for c in ("dim", "block", "kind", "i", "j"))
    pdf = pdf.sort_values(["side", "node"], kind="stable")
    n, nodes, copies = len(pdf), pdf["node"].to_numpy(), pdf["copies"].to_numpy().astype(float)
    vec = np.frombuffer(b"".join(pdf["vec"]), np.float64 if wide else np.float32).reshape(n, dim).astype(float)
    norm = np.sqrt(np.einsum("ij,ij->i", vec, vec))
    unit = vec / norm[:, None]
    cuts, budgets = blocks(dim), _budgets(dim, cosine)
    if block == ALL_BLOCKS:
        rot, used = (unit @ rotation(dim)).astype(np.float32), range(len(cuts))
    else:
        rot, used = np.frombuffer(b"".join(pdf["rot"]), np.float32).reshape(n, dim), [block]
    ones = np.ones((n, 1), np.float32)
    left, right = [], []  # their product is a block's squared distances less its budget
    for c in used:
        part = rot[:, cuts[c]]
        square = np.einsum("ij,ij->i", part, part)[:, None]
        left.append(np.hstack([-2 * part, ones, square - np.float32(budgets[c])]))
        right.append(np.ascontiguousarray(np.hstack([part, square, ones]).T))
    same = kind == 0 and i == j
    first = n if same else int((pdf["side"].to_numpy() == 0).sum())
    low, links = np.arange(n), np.zeros(n)
    step = max(1, AREA // n)
    for at in range(0, first, step):
        rows = slice(at, min(at + step, first))
        others = slice(at, n) if same else slice(first, n)
        hit = left[0][rows] @ right[0][:, others] <= 0
        for x, y in zip(left[1:], right[1:]):
            np.logical_or(hit, x[rows] @ y[:, others] <= 0, out=hit)
        a, b = np.nonzero(hit)
        if len(a) * 8 > hit.size:  # crowded: what is clearly under or over is told by one product
            plain = (unit[rows] @ unit[others].T)[a, b]
            sure, a, b = plain > cosine + 1e-9, a[plain > cosine - 1e-9], b[plain > cosine - 1e-9]
            sure = sure[plain > cosine - 1e-9]
        else:
            sure = np.zeros(len(a), bool)
        a, b = a + rows.start, b + others.start
        if same:
            a, b, sure = a[a < b], b[a < b], sure[a < b]
        if block != ALL_BLOCKS and len(a):
            mine = np.concatenate([_first_admits(rot.astype(float), a[k : k + 20_000], b[k : k + 20_000], block, cuts, budgets) for k in range(0, len(a), 20_000)])
            a, b, sure = a[mine], b[mine], sure[mine]
        open_ = np.nonzero(~sure)[0]
        for k in range(0, len(open_), 20_000):
            x, y = a[open_[k : k + 20_000]], b[open_[k : k + 20_000]]
            sure[open_[k : k + 20_000]] = np.einsum("ij,ij->i", vec[x], vec[y]) / (norm[x] * norm[y]) >= cosine
        a, b = a[sure], b[sure]
        links += np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
        low = _merge(low, a, b)
    has = links > 0
    return pd.DataFrame({"node": nodes[has], "links": links[has].astype(np.int64), "root": nodes[low[has]]})


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``df``.

    Rows are compared if their labels are equal and not null and their vectors are equally long; vectors
    that are null, empty, zero, or hold null or non-finite components link with nothing. Equal vectors
    of a label are one node that counts its copies; they link with each other. A null id is ignored as
    least id and counts as kept. Repeated rows are vectors of their own. An empty table gives no rows.

    A label of up to TILE vectors moves each once. A larger one costs the square of its size in
    arithmetic unless cells prune it, spread over tasks of two tiles; what leaves a task is one row per
    vector.
    """
    wide = dict(df.dtypes)[vector_col] == "array<double>"
    kind = "double" if wide else "float"
    v = F.col(vector_col).cast(f"array<{kind}>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    ok = F.coalesce(F.col(label_col).isNotNull() & fine, F.lit(False))
    vec = F.when(ok, v)
    key = F.struct(F.col(label_col).cast("string").alias("l"), vec.alias("v"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.when(ok, F.col(label_col).cast("string")).alias("label"), vec.alias("v"), *[F.when(ok, h).alias(n) for n, h in zip(("h1", "h2"), hash128("h", key))])
    distinct = rows.filter("h1 is not null").groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))

    def rotate(batches):
        for batch in batches:
            vecs = [np.asarray(x, np.float64 if wide else np.float32) for x in batch.column("v").to_pylist()]
            unit = [x.astype(float) / np.abs(x).max() for x in vecs]
            rot = [(u / np.sqrt(u @ u) @ rotation(len(u))).astype(np.float32).tobytes() for u in unit]
            stored = [(u if wide else x).tobytes() for x, u in zip(vecs, unit)]
            yield {c: batch.column(c) for c in ("h1", "h2", "label", "copies", "least")} | {"dim": [len(x) for x in vecs], "vec": stored, "rot": rot}

    reps = map_arrow(distinct, rotate, "h1 long, h2 long, label string, copies long, least long, dim int, vec binary, rot binary")
    reps = materialize(reps.withColumn("node", F.monotonically_increasing_id()), "vectors")

    def compare(pdf):
        return _compare(pdf, cosine, wide)

    tiles = _tiles(_entries(reps, _plans(reps, cosine), cosine))
    found = tiles.groupBy("label", "dim", "block", "cx", "cy", "kind", "i", "j").applyInPandas(compare, "node long, links long, root long")
    found = materialize(found, "links")
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = reps.select("h1", "h2", "node", "copies", "least").join(parts, "node", "left").join(links, "node", "left")
    nodes = materialize(nodes.select("h1", "h2", "least", F.coalesce("component", "node").alias("part"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n")), "nodes")
    least = nodes.groupBy("part").agg(F.min("least").alias("component_id"))
    classes = materialize(nodes.join(least, "part").select("h1", "h2", "n", "component_id"), "classes")
    joined = with_salt(rows.select("vec_id", "h1", "h2"), F.col("vec_id")).join(salted(classes), ["h1", "h2", "__salt"], "left")
    component = F.when(F.col("n").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """All embeddings linked at cosine 0.93 within a label."""
    return few_files(near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
