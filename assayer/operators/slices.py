"""Slice identifiers: known values, and agreement with their rows' context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.values import any_of, fold_identifier, fold_numeric, holds, identifier, numeric_equivalent, quoted, strip
from assayer.operators.base import Metric, Rejected, count_if, parameters, ratio, requirements, rows, verdict
from assayer.sources.tabular import ROW_INDEX


def _slice_field(df: DataFrame, spec: dict, needed: str, error: str) -> str:
    field = requirements(spec).get("slice_field")
    if not field:
        raise Rejected("slice_field is required.")
    if not parameters(spec).get(needed):
        raise Rejected(error)
    if field not in df.columns:
        raise Rejected("Slice field does not exist in dataset.", missing_field=field)
    return field


def allowed_identifiers(values: list, case_sensitive: bool, aliases: dict, numeric: bool) -> list[str]:
    """The folded allowed values and, if wanted, their numeric equivalents."""
    out = {fold_identifier(v, case_sensitive, aliases) for v in values} - {None}
    if numeric:
        out |= {fold_numeric(v) for v in values if fold_identifier(v, case_sensitive, aliases) is not None} - {None}
    return sorted(out)


def valid_slices(df: DataFrame, spec: dict) -> Metric:
    field = _slice_field(df, spec, "allowed_slice_ids", "allowed_slice_ids is required and must be non-empty.")
    p = parameters(spec)
    sensitive, aliases, numeric = bool(p.get("case_sensitive", False)), p.get("slice_aliases") or {}, bool(p.get("allow_numeric_equivalents", True))
    strict, limit = p.get("missing_policy", "count_invalid") == "count_invalid", int(p.get("max_examples", 10))
    allowed = allowed_identifiers(p["allowed_slice_ids"], sensitive, aliases, numeric)
    value = F.col("__vs_id")
    missing = value.isNull()
    known = holds(value.isin(allowed)) | (holds(numeric_equivalent(value).isin(allowed)) if numeric else F.lit(False))
    counters = {"row_count": rows(), "missing_slice_count": count_if(missing), "valid_slice_count": count_if(known)}

    def derive(d):
        return d.withColumn("__vs_id", identifier(quoted(field), sensitive, aliases))

    def unknown(d):
        off = d.filter(~known & (F.lit(strict) | ~missing))
        reason = F.when(missing, "missing_slice_id").otherwise("slice_id_not_allowed")
        return off.select(ROW_INDEX, F.when(~missing, quoted(field).cast("string")).alias("value"), reason.alias("reason")).orderBy(ROW_INDEX).limit(limit)

    def finish(c, tables, examples):
        n, gone, good = c["row_count"], c["missing_slice_count"], c["valid_slice_count"]
        checked = n if strict else n - gone
        if not checked:
            raise Rejected("No slice identifiers were available to check.")
        share = ratio(good, checked)
        return {
            "slice_field": field, "row_count": n, "checked_slice_count": checked, "valid_slice_count": good, "invalid_slice_count": checked - good,
            "missing_slice_count": gone, "valid_slice_identifier_ratio": share, "invalid_slice_identifier_ratio": ratio(checked - good, checked),
            "missing_slice_ratio": ratio(gone, n), "allowed_slice_ids": allowed, "observed_slice_ids": [r["id"] for r in tables["observed"]],
            "invalid_examples": examples["invalid"], "status": verdict(share, 0.99, 0.95),
        }

    return Metric(
        spec["metric_id"], counters, finish, derive, row_index=True,
        tables={"observed": lambda d: d.filter(~missing).select(value.alias("id")).distinct().orderBy("id")},
        examples={"invalid": unknown},
    )


def rule_matches(cell: Column, operator: str | None, target: object, case_sensitive: bool) -> Column:
    """Whether a cell meets a rule's condition; unknown operators and blank cells or targets don't."""
    text = identifier(cell, case_sensitive)
    if operator == "in":
        targets = [t for t in (fold_identifier(x, case_sensitive) for x in (target if isinstance(target, list) else [target])) if t is not None]
        return holds(text.isin(targets)) if targets else F.lit(False)
    goal = None if isinstance(target, list) else fold_identifier(target, case_sensitive)
    if goal is None:
        return F.lit(False)
    made = {"equals": text == F.lit(goal), "contains": text.contains(goal), "starts_with": text.startswith(goal), "ends_with": text.endswith(goal)}
    return holds(made[operator]) if operator in made else F.lit(False)


def consistent_slices(df: DataFrame, spec: dict) -> Metric:
    """A row's identifier must be one that the rules matching the row expect."""
    field = _slice_field(df, spec, "rules", "rules is required and must be non-empty.")
    p = parameters(spec)
    sensitive, limit = bool(p.get("case_sensitive", False)), int(p.get("max_examples", 10))
    strict = p.get("missing_policy", "count_invalid") == "count_invalid"
    rules = [{"rule_index": i} | {k: r.get(k) for k in ("when_field", "operator", "value")} | {"expected": sorted({fold_identifier(x, sensitive) for x in r.get("expected_slice_ids", [])} - {None})} for i, r in enumerate(p["rules"])]
    usable = [r for r in rules if r["when_field"] in df.columns]
    hits = {r["rule_index"]: F.col(f"__sc_{r['rule_index']}") for r in usable}
    value = F.col("__sc_id")
    matched = any_of(hits.values())
    missing = matched & value.isNull()
    seen = matched & value.isNotNull()
    agrees = seen & any_of(hits[r["rule_index"]] & value.isin(r["expected"]) for r in usable if r["expected"])
    differs = seen & ~agrees
    counters: dict[str, Column] = {"row_count": rows(), "consistent_row_count": count_if(agrees), "differing_row_count": count_if(differs), "missing_slice_count": count_if(missing), "unmatched_context_row_count": count_if(~matched)}
    for i, hit in hits.items():
        counters |= {f"applied_{i}": count_if(hit), f"agreed_{i}": count_if(hit & agrees), f"differed_{i}": count_if(hit & differs)}

    def derive(d):
        named = {f"__sc_{r['rule_index']}": rule_matches(quoted(r["when_field"]), r["operator"], r["value"], sensitive) for r in usable}
        return d.withColumns(named | {"__sc_id": identifier(quoted(field), sensitive)})

    context = [f for f in requirements(spec).get("context_fields", []) if f in df.columns]

    def off(d):
        expected = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.when(hits[r["rule_index"]], F.array(*[F.lit(x) for x in r["expected"]]).cast("array<string>")).otherwise(F.array().cast("array<string>")) for r in usable]))))
        which = F.array_compact(F.array(*[F.when(hits[r["rule_index"]], F.lit(r["rule_index"])) for r in usable]))
        around = F.array(*[strip(quoted(f)) for f in context]).cast("array<string>").alias("context")
        return d.filter(differs).select(ROW_INDEX, value.alias("observed"), expected.alias("expected"), which.alias("rules"), around).orderBy(ROW_INDEX).limit(limit)

    def finish(c, tables, examples):
        gone = c["missing_slice_count"]
        counted = gone if strict else 0
        good = c["consistent_row_count"]
        bad = c["differing_row_count"] + counted
        checked = good + bad
        share = ratio(good, checked)
        summary = []
        for r in sorted(rules, key=lambda r: r["rule_index"] in hits):
            i = r["rule_index"]
            summary.append({k: r[k] for k in ("rule_index", "when_field", "operator", "value")} | {"application_count": c.get(f"applied_{i}", 0), "consistent_count": c.get(f"agreed_{i}", 0), "inconsistent_count": c.get(f"differed_{i}", 0)})
        return {
            "slice_field": field, "row_count": c["row_count"], "checked_row_count": checked, "consistent_row_count": good, "inconsistent_row_count": bad,
            "missing_slice_count": gone, "unmatched_context_row_count": c["unmatched_context_row_count"],
            "rule_application_count": sum(c[f"applied_{i}"] for i in hits), "rule_unavailable_count": len(rules) - len(hits),
            "slice_identifier_consistency_ratio": share, "inconsistency_ratio": ratio(bad, checked), "missing_slice_ratio": ratio(gone, c["row_count"]),
            "rules_applied_summary": summary,
            "examples": [{"row_index": r[ROW_INDEX], "observed_slice_id": r["observed"], "expected_slice_ids": r["expected"], "matched_rules": r["rules"], "context": dict(zip(context, r["context"])), "reason": "slice_id_does_not_match_expected_context"} for r in examples.get("examples", [])],
            "status": verdict(share, 0.99, 0.95) if checked else "not_applicable",
        }

    return Metric(spec["metric_id"], counters, finish, derive, examples={"examples": off} if usable else {}, wanted={"examples": ("differing_row_count",)} if usable else {}, row_index=True, extra={"rules": rules, "usable": usable})
