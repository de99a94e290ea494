"""Column quality and pairwise correlation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions.values import finite, is_numeric, number, quoted
from assayer.operators.base import Metric, Rejected, ratio, requirements, rows


def field_facts(df: DataFrame, fields: list[str]) -> DataFrame:
    """pos, field, row_count, non_null_count, numeric_non_null_count, unique_count of each present field.

    Fields are unpivoted and counted by distinct number first, with map-side partial sums; the second
    step sees a row for each distinct number of a field. So any number of exact distinct counts costs
    one scan and no Expand over all fields. An empty frame gives no rows.
    """
    present = [f for f in fields if f in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "pos int, field string, row_count long, non_null_count long, numeric_non_null_count long, unique_count long")
    cells = [c for i, f in enumerate(present) for c in (F.lit(i), quoted(f).isNotNull(), number(quoted(f), is_numeric(df, f)))]
    long = df.select(F.stack(F.lit(len(present)), *cells).alias("pos", "there", "value"))
    by_value = long.groupBy("pos", "value").agg(rows().alias("n"), F.count_if("there").alias("there"))
    facts = by_value.groupBy("pos").agg(
        F.sum("n").alias("row_count"),
        F.sum("there").alias("non_null_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("numeric_non_null_count"),
        F.count("value").alias("unique_count"),
    )
    names = F.array(*[F.lit(f) for f in present])
    return facts.select("pos", F.get(names, F.col("pos")).alias("field"), "row_count", "non_null_count", "numeric_non_null_count", "unique_count")


def quality_reason(non_null: Column, numeric: Column, unique: Column) -> Column:
    return F.when(non_null == 0, "empty_column").when(numeric == 0, "non_numeric").when(numeric < 2, "insufficient_numeric_values").when(unique < 2, "constant_column").otherwise("usable")


def quality_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """The facts of every candidate field, present or not, with flags and reason."""
    spark = df.sparkSession
    wanted = spark.range(1).select(F.posexplode(F.array(*[F.lit(f) for f in fields])).alias("pos", "field"))
    facts = field_facts(df, fields).drop("pos")
    # All present fields have the rows' count; only without any it must be counted. The window is over one row a field.
    n = F.coalesce(F.max("row_count").over(W.partitionBy(F.lit(0))), F.lit(0 if set(fields) & set(df.columns) else df.count())).cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = wanted.join(facts, "field", "left").withColumn("all_rows", n).withColumn("exists", F.col("field").isin([f for f in fields if f in df.columns]))
    out = out.select("pos", "field", "exists", F.col("all_rows").alias("row_count"), zero("non_null_count"), zero("numeric_non_null_count"), zero("unique_count"))
    usable = (F.col("numeric_non_null_count") >= 2) & (F.col("unique_count") >= 2)
    return out.select(
        "*",
        ((F.col("numeric_non_null_count") > 0) & (F.col("unique_count") < 2)).alias("constant_column"),
        usable.alias("usable_for_analysis"),
        F.when(~F.col("exists"), "missing_column").otherwise(quality_reason(F.col("non_null_count"), F.col("numeric_non_null_count"), F.col("unique_count"))).alias("reason"),
    )


def column_quality(df: DataFrame, spec: dict) -> Metric:
    fields = requirements(spec).get("candidate_fields")
    if fields is None:
        raise Rejected("candidate_fields is required.")

    def finish(counters, tables, _):
        found = {r["field"]: r for r in tables["facts"]}
        n = counters["row_count"]
        out = []
        for f in fields:
            r = found.get(f)
            exists = f in df.columns
            there, numeric, unique = (r["non_null_count"], r["numeric_non_null_count"], r["unique_count"]) if r else (0, 0, 0)
            if not exists:
                reason = "missing_column"
            elif not there:
                reason = "empty_column"
            elif not numeric:
                reason = "non_numeric"
            elif numeric < 2:
                reason = "insufficient_numeric_values"
            else:
                reason = "constant_column" if unique < 2 else "usable"
            out.append({
                "field": f, "exists": exists, "row_count": n, "non_null_count": there, "non_null_ratio": ratio(there, n),
                "numeric_non_null_count": numeric, "numeric_non_null_ratio": ratio(numeric, n), "unique_count": unique,
                "unique_ratio": ratio(unique, numeric), "constant_column": numeric > 0 and unique < 2,
                "usable_for_analysis": numeric >= 2 and unique >= 2, "reason": reason,
            })
        k = len(out)
        mean = lambda name: round(sum(x[name] for x in out) / k, 6) if k else None
        usable = sum(x["usable_for_analysis"] for x in out)
        return {"fields": out, "summary": {
            "field_count": k, "usable_field_count": usable, "constant_field_count": sum(x["constant_column"] for x in out),
            "missing_field_count": sum(not x["exists"] for x in out), "mean_non_null_ratio": mean("non_null_ratio"),
            "mean_numeric_non_null_ratio": mean("numeric_non_null_ratio"), "mean_unique_ratio": mean("unique_ratio"),
            "quality_score": round(usable / k, 6) if k else None,
        }}

    return Metric(spec["metric_id"], {"row_count": rows()}, finish, tables={"facts": lambda d: field_facts(d, fields)})


def pair_columns(df: DataFrame, a: str, b: str) -> tuple[Column, Column]:
    """(r, overlap) of two fields. Infinities count for the overlap and not for r.

    r is NULL without two different finite pairs on either side.
    """
    x, y = (number(quoted(c), is_numeric(df, c)) for c in (a, b))
    both = finite(x).isNotNull() & finite(y).isNotNull()
    p, q = F.when(both, x), F.when(both, y)
    varies = (F.min(p) < F.max(p)) & (F.min(q) < F.max(q))
    r = F.when(varies, F.try_divide(F.covar_pop(p, q), F.stddev_pop(p) * F.stddev_pop(q)))
    return r, F.count_if(x.isNotNull() & y.isNotNull())


def usable_reason(numeric: int, unique: int) -> str:
    return "non_numeric" if not numeric else "insufficient_numeric_values" if numeric < 2 else "constant_column" if unique < 2 else "usable"


def pearson(df: DataFrame, spec: dict) -> Metric:
    """All present candidate pairs are aggregated with the other counters; the finish keeps those of usable fields."""
    needs = requirements(spec)
    fields, least = needs.get("candidate_fields"), needs.get("minimum_runnable_fields")
    if fields is None or least is None:
        raise Rejected("candidate_fields and minimum_runnable_fields are required.")
    present = [f for f in fields if f in df.columns]
    pairs = list(combinations(range(len(present)), 2))
    counters: dict[str, Column] = {"row_count": rows()}
    for i, j in pairs:
        counters[f"r_{i}_{j}"], counters[f"n_{i}_{j}"] = pair_columns(df, present[i], present[j])

    def finish(values, tables, _):
        found = {r["field"]: r for r in tables["facts"]}
        validation = []
        for f in fields:
            r = found.get(f)
            numeric, unique = (r["numeric_non_null_count"], r["unique_count"]) if r else (0, 0)
            reason = usable_reason(numeric, unique) if f in present else "missing_column"
            validation.append({"field": f, "exists": f in present, "numeric_non_null_count": numeric, "numeric_unique_count": unique, "usable_for_pearson": reason == "usable", "reason": reason})
        good = [v["field"] for v in validation if v["usable_for_pearson"]]
        if len(good) < least:
            raise Rejected(f"Not enough usable numeric columns for Pearson correlation: {len(good)} of at least {least}.", column_validation=validation)
        at = {f: i for i, f in enumerate(present)}
        found_pairs, matrix = [], {f: {} for f in good}
        for f in good:
            matrix[f][f] = 1.0
        for a, b in combinations(good, 2):
            key = f"{min(at[a], at[b])}_{max(at[a], at[b])}"
            r = values[f"r_{key}"]
            r = float("nan") if r is None else round(r, 6)
            matrix[a][b] = matrix[b][a] = r
            found_pairs.append({"fields": [a, b], "value": r, "overlap_non_null_count": values[f"n_{key}"]})
        real = [abs(p["value"]) for p in found_pairs if p["value"] == p["value"]]
        mean = round(sum(real) / len(real), 6) if real else None
        ordered = {f: {g: matrix[f][g] for g in good} for f in good}
        return {"fields": good, "matrix": ordered, "summary": {"pair_count": len(found_pairs), "mean_absolute_correlation": mean, "pairs": found_pairs}, "__column_validation": validation}

    return Metric(spec["metric_id"], counters, finish, tables={"facts": lambda d: field_facts(d, fields)})


def pearson_pairs(df: DataFrame, fields: list[str]) -> DataFrame:
    """field_a, field_b, value (unrounded), overlap of all pairs of present fields: one aggregation, then one row a pair."""
    present = [f for f in fields if f in df.columns]
    pairs = list(combinations(present, 2))
    columns = []
    for k, (a, b) in enumerate(pairs):
        r, n = pair_columns(df, a, b)
        columns += [r.alias(f"r{k}"), n.alias(f"n{k}")]
    out = F.array(*[F.struct(F.lit(a).alias("field_a"), F.lit(b).alias("field_b"), F.col(f"r{k}").alias("value"), F.col(f"n{k}").alias("overlap_non_null_count")) for k, (a, b) in enumerate(pairs)])
    return df.agg(*columns).select(F.inline(out))
