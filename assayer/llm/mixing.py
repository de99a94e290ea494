"""Mixing sources to target weights by entropy balancing.

Each document gets a rate; among all rates whose words meet their source's target, the dual solution
is exponentially tilted in the document's size: exp(lambda * size / mean size), at most the cap. Newton
iterations find every source's lambda at once; each is one distributed aggregation over the counts of
(source, size), which hold all that the rates depend on. Rates become whole copies by carrying the
rounding error from large sizes to small ones within a source.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import bucket_rank, discard, few_files, hidden, materialize, ordered_rank, salted, shown, with_salt

#: A word: a run of code points other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text, as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """source, source_size, target of every source; ``sizes`` has source and source_size.

    Sources by code point, null last, take the weights in turn and share 100 % of all sizes by weight;
    a target stops at ``cap`` times its source's size, and the excess is shared by weight among the
    others until none is above: in the end every target is min(cap * size, weight * level). The level
    is found from scalar sums over all sources, one round for each time that more sources reach the cap.
    """
    ranked = ordered_rank(sizes, [F.col("source").isNull().asc(), F.col("source").asc()])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight), "sources")
    limit = F.lit(cap) * F.col("source_size")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, capped = 0.0, None
    while True:
        full = F.lit(False) if capped is None else limit <= F.col("weight") * level
        n, used, rest = ranked.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not rest:
            break
        capped, level = n, (total - cap * used) / rest
    return ranked.select("source", "source_size", F.least(limit, F.col("weight") * level).alias("target"))


def solve_tilts(counts: DataFrame, targets: DataFrame, cap: float = 3.0, tolerance: float = 1e-6, max_rounds: int = 100) -> DataFrame:
    """targets with ``tilt`` and ``mean``: rates min(cap, exp(tilt * size / mean)) meet each target.

    Newton steps on the logarithm of the words taken, held between bounds by bisection. A round is one
    aggregation over ``counts`` (source, size, n); the few columns by source are written each time.
    Sums are rounded to whole millionths of a target, so reruns agree whatever the order of addition.
    Raises RuntimeError if a target isn't met and its bounds are still apart after ``max_rounds``.
    """
    facts = counts.filter("size > 0").groupBy("source").agg(F.sum("n").alias("docs"), F.min("size").alias("least"))
    state = targets.join(facts, targets.source.eqNullSafe(facts.source), "left").select(targets.source, "source_size", "target", F.col("source_size") / F.col("docs"), F.col("least"))
    state = state.toDF("source", "source_size", "target", "mean", "least")
    floor = F.col("least") / F.col("mean")
    grows = F.col("target") >= F.col("source_size")
    state = state.withColumns({
        "lo": F.when(grows, F.lit(0.0)).otherwise(F.log(F.col("target") / F.col("source_size")) / floor),
        "hi": F.when(grows, F.log(F.lit(cap)) / floor).otherwise(F.lit(0.0)),
        "tilt": F.lit(0.0),
        "miss": F.lit(1.0),
    })
    state = materialize(state.filter("mean is not null"), "tilts")
    for _ in range(max_rounds):
        rows = counts.filter("size > 0").join(state, counts.source.eqNullSafe(state.source)).drop(state.source)
        x = F.col("size") / F.col("mean")
        free = F.exp(F.col("tilt") * x)
        share = F.col("n") * F.col("size") * F.least(free, F.lit(cap)) / F.col("target")
        slope = F.when(free < cap, share * x).otherwise(F.lit(0.0))
        fixed = lambda c: F.sum(F.round(c * 1e9).cast("decimal(30,0)")).cast("double") / 1e9
        sums = rows.groupBy("source").agg(fixed(share).alias("got"), fixed(slope).alias("slope"))
        both = state.join(sums, state.source.eqNullSafe(sums.source)).drop(sums.source)
        over = F.col("got") > 1
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("tilt")), F.when(over, F.col("tilt")).otherwise(F.col("hi"))
        step = F.col("tilt") - F.when(F.col("slope") > 0, F.log("got") * F.col("got") / F.col("slope"))
        held = F.when((step > lo) & (step < hi), step).otherwise((lo + hi) / 2)
        miss = F.abs(F.col("got") - 1)
        done = miss <= tolerance
        found = materialize(
            both.select("source", "source_size", "target", "mean", "least", lo.alias("lo"), hi.alias("hi"), F.when(done, F.col("tilt")).otherwise(held).alias("tilt"), F.when(done | (hi - lo <= 1e-12 * F.greatest(F.lit(1.0), F.abs(lo), F.abs(hi))), F.lit(0.0)).otherwise(miss).alias("miss")),
            "tilts",
        )
        discard(state)
        state = found
        if (state.agg(F.max("miss")).first()[0] or 0.0) <= tolerance:
            break
    else:
        raise RuntimeError("tilts did not settle")
    return state.select("source", "source_size", "target", "tilt", "mean")


def _whole_copies(pdf: pd.DataFrame, cap: float) -> pd.DataFrame:
    """Copies by size of one source: large sizes first, each rounded so that the words so far come nearest to plan."""
    pdf = pdf.sort_values("size", ascending=False)
    plan, taken, out = 0.0, 0, []
    for size, n, rate in zip(pdf["size"].tolist(), pdf["n"].tolist(), pdf["rate"].tolist()):
        plan += size * n * rate
        k = n if not size else min(max(int((plan - taken) / size + 0.5), 0), int(cap * n))
        taken += k * size
        out.append(k)
    return pdf.assign(k=out)[["source", "size", "n", "k"]]


def mix_sources(df: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, row_col: str | None = None) -> DataFrame:
    """All rows of ``df`` with ``size``, ``source_size``, ``target`` and ``copies`` (columns of those names are replaced).

    :param size: words of a row, a long.
    :param row_col: a column that tells rows of one id apart, if ids may repeat or be null; without one, rows
        of one id, source and size are ranked in one task.
    :param cap: no row gets more than so many copies, no target more than so many times its source.
    :returns: copies, 0 to ``cap``; the sum of copies * size over a source comes to its target but for
        about half of its smallest size. Documents of one source and size share a rate; which of them
        get the odd copy is decided by a hash of the id (then ``row_col``), so reruns agree. Documents without
        words have one copy. Null sources are one source. An empty table gives no rows. ``df`` is read
        several times and must give the same rows.
    """
    used = (id_col, source_col, *([row_col] if row_col else []))
    named = df.drop("size", "source_size", "target", "copies")
    rows = df.select(*hidden(named, *used), F.col(source_col).alias("__source"), size.alias("__size"), F.xxhash64(F.lit(3), F.col(id_col)).alias("__u"))
    counts = materialize(rows.groupBy(F.col("__source").alias("source"), F.col("__size").alias("size")).agg(F.count(F.lit(1)).alias("n")), "sizes")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    targets = source_targets(counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, float(cap))
    targets = materialize(targets, "targets")
    tilts = solve_tilts(counts, targets, float(cap))
    tilted = counts.join(tilts, counts.source.eqNullSafe(tilts.source), "left").drop(tilts.source)
    rate = F.coalesce(F.least(F.exp(F.col("tilt") * F.col("size") / F.col("mean")), F.lit(float(cap))), F.lit(1.0))

    def whole(pdf):
        return _whole_copies(pdf, float(cap))

    kinds = dict(counts.dtypes)
    classes = tilted.withColumn("rate", rate).groupBy("source").applyInPandas(whole, f"source {kinds['source']}, size long, n long, k long")
    classes = classes.join(targets, classes.source.eqNullSafe(targets.source)).drop(targets.source)
    classes = materialize(classes.select(F.col("source").alias("__s"), F.col("size").alias("__z"), "source_size", "target", F.expr("k div n").alias("__base"), F.expr("k % n").alias("__odd")), "copies")
    ranked = bucket_rank(rows, ["__source", "__size"], ["__u", id_col, *([row_col] if row_col else [])], total, "__rank")
    spread = with_salt(ranked, F.col("__u"))
    table = salted(classes).withColumnRenamed("__salt", "__salt2")
    on = F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__z")) & (F.col("__salt") == F.col("__salt2"))
    copies = F.col("__base") + (F.col("__rank") < F.col("__odd")).cast("long")
    # Sizes times sources grow with the corpus: a merge join, rather than a broadcast that a compressed file's size lets pass.
    return spread.join(table.hint("merge"), on).select(*shown(named, *used), F.col("__size").alias("size"), "source_size", "target", copies.alias("copies"))


def mix_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The mix itself: every row of ``df``, unchanged, as often as it has copies (0 to ``cap``).

    Each row has copies of its own, also where ids or whole rows repeat or are null; which of rows of one
    id, source and size get an odd copy is decided by their text, then their place. Null text has no words,
    and rows without words stay once. An empty table gives no rows. Copies are decided on ids, sources and
    sizes alone; whole rows are written once with a row number, and shuffled once to meet their copies.
    """
    used = (id_col, text_col, source_col)
    rows = materialize(df.select(*hidden(df, *used), F.monotonically_increasing_id().alias("__row")), "rows", spread=True)
    text_hash = F.coalesce(F.xxhash64(F.lit(5), F.col(text_col)), F.lit(0))
    narrow = rows.select(F.col(id_col).alias("__id"), "__row", F.struct(text_hash.alias("text"), "__row").alias("__tie"), F.col(source_col).alias("__from"), word_count(F.col(text_col)).alias("__words"))
    narrow = materialize(narrow, "words", spread=True)
    mixed = mix_sources(narrow, F.col("__words"), "__id", "__from", weights, cap, "__tie")
    copies = mixed.filter("copies > 0").select(F.col("__row").alias("__to"), F.col("copies").cast("int").alias("__n"))
    joined = rows.join(copies.hint("merge"), rows["__row"] == F.col("__to"))
    return joined.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*shown(df, *used))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 1, 2, 3 by code point."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("row")), "words", spread=True)
    out = mix_sources(words, F.col("size"), row_col="row")
    return few_files(out).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
