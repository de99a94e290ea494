"""Plan, case and taxonomy documents: loading, checking, ordering, trees."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from assayer.sources.files import beside, folder_of, given, read_text

#: Rank of metrics that a taxonomy doesn't list.
UNRANKED = 10**9


@dataclass
class Case:
    """``dataset`` and ``output`` are local paths, or URIs as text."""

    plan: dict
    dataset: str | Path
    output: str | Path
    case_id: str


def load_case(document: str | Path, dataset: str | None = None, output: str | None = None, case_id: str = "ad_hoc_case", spark: SparkSession | None = None) -> Case:
    """A case document, or a plan document with dataset and output given apart. ValueError for others.

    Paths in a document are relative to its folder. All may be URIs of any store that Spark reaches; a
    document at a URI needs a session.
    """
    document = given(document) if isinstance(document, str) else document.resolve()
    data = json.loads(read_text(document, spark))
    if {"test_plan", "dataset", "output"} <= data.keys():
        at = lambda part: beside(folder_of(document), data[part]["path"])
        return Case(json.loads(read_text(at("test_plan"), spark)), at("dataset"), at("output"), data.get("case_id", "unknown_case"))
    if {"metrics", "plan_meta"} <= data.keys():
        if not dataset or not output:
            raise ValueError("A plan needs --dataset and --output")
        return Case(data, given(dataset), given(output), case_id)
    raise ValueError("Neither a case nor a plan document")


def check_plan(plan: object) -> None:
    """ValueError at the first thing wrong with a plan."""

    def need(ok: bool, text: str) -> None:
        if not ok:
            raise ValueError(text)

    need(isinstance(plan, dict), "A plan must be an object")
    meta = plan.get("plan_meta")
    need(isinstance(meta, dict), "A plan needs an object plan_meta")
    need("plan_id" in meta, "plan_meta needs a plan_id")
    metrics = plan.get("metrics")
    need(isinstance(metrics, list) and bool(metrics), "A plan needs a list of metrics that isn't empty")
    for i, m in enumerate(metrics):
        need(isinstance(m, dict), f"Metric {i} must be an object")
        need("metric_id" in m, f"Metric {i} needs a metric_id")
        name = m["metric_id"]
        need(isinstance(m.get("taxonomy_path", []), list), f"{name}: taxonomy_path must be a list")
        need(isinstance(m.get("input_requirements", {}), dict), f"{name}: input_requirements must be an object")
        need(isinstance(m.get("calculation", {}), dict), f"{name}: calculation must be an object")
        need("calculation" not in m or "method" in m["calculation"], f"{name}: calculation needs a method")
        need(bool(m.get("taxonomy_path")), f"{name}: taxonomy_path must not be empty")


def _leaves(node: object) -> Iterator[str]:
    """Metric ids of a taxonomy, depth first, in the order written."""
    if isinstance(node, dict):
        for key, value in node.items():
            if key == "_metrics":
                yield from value
            else:
                yield from _leaves(value)


def taxonomy_ranks(taxonomy: dict) -> dict[str, int]:
    """Rank of each metric id; of several places the first counts."""
    out: dict[str, int] = {}
    for metric_id in _leaves(taxonomy):
        out.setdefault(metric_id, len(out))
    return out


def load_ranks(path: str | Path, spark: SparkSession | None = None) -> dict[str, int]:
    return taxonomy_ranks(json.loads(read_text(given(str(path)), spark)))


def order_metrics(metrics: list[dict], ranks: dict[str, int], strict: bool = False) -> list[dict]:
    """Metrics by rank, ties and unlisted ones (last) in plan order; ``strict`` refuses unlisted ones."""
    unlisted = [m["metric_id"] for m in metrics if m["metric_id"] not in ranks]
    if strict and unlisted:
        raise ValueError(f"Not in the taxonomy: {', '.join(unlisted)}")
    return sorted(metrics, key=lambda m: ranks.get(m["metric_id"], UNRANKED))


def _tree(metrics: list[dict], leaf: str, make) -> dict:
    root: dict = {}
    for m in metrics:
        node = root
        for part in m.get("taxonomy_path", []):
            node = node.setdefault(part, {})
        node.setdefault(leaf, []).append(make(m))
    return root


def plan_tree(metrics: list[dict]) -> dict:
    return _tree(metrics, "_metrics", lambda m: {"metric_id": m.get("metric_id"), "label": m.get("label"), "enabled": m.get("enabled", True)})


def result_tree(metrics: list[dict], records: list[dict], results: dict) -> dict:
    """Status (``skipped`` if never reached), result and error of each metric."""
    by_id = {r["metric_id"]: r for r in records}

    def make(m):
        r = by_id.get(m["metric_id"], {})
        return {"metric_id": m["metric_id"], "status": r.get("status", "skipped"), "result": results.get(m["metric_id"]), "error": r.get("error")}

    return _tree(metrics, "_metrics", make)


def results_tree(metrics: list[dict], results: dict) -> dict:
    return _tree(metrics, "_results", lambda m: {"metric_id": m["metric_id"], "result": results.get(m["metric_id"])})


def tree_lines(tree: dict, depth: int = 0) -> list[str]:
    """A result tree as indented lines; a branch that only holds metrics is shown by them."""
    out = []
    for key, value in tree.items():
        listed = value if key == "_metrics" else value["_metrics"] if isinstance(value, dict) and set(value) == {"_metrics"} else None
        if listed is not None:
            out += [f"{'  ' * depth}↳ {m.get('metric_id')} [{m.get('status', 'unknown')}]" for m in listed]
        else:
            out += [f"{'  ' * depth}↳ {key}", *tree_lines(value, depth + 1)]
    return out
