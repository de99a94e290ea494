"""Runs a plan on a dataset and writes the outcome document.

Counters of all metrics are evaluated together, in few aggregations over one scan of the dataset; what
is left for each metric is small: its tables and its examples, submitted from a thread pool under a job
group of their own. Records, status and order follow the plan's order whatever finishes first.
"""

from __future__ import annotations

import argparse
import json
import os
import signal
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from assayer.functions.values import quoted
from assayer.operators.addresses import DEFAULT_FIELDS
from assayer.operators.base import Metric, Rejected
from assayer.plans.documents import Case, check_plan, load_case, load_ranks, order_metrics, plan_tree, result_tree, results_tree, tree_lines
from assayer.plans.progress import run_lines, task_share
from assayer.plans.registry import build_metric
from assayer.sources.files import write_text
from assayer.sources.pcap import CAPTURES, COLUMNS, read_pcap
from assayer.sources.tabular import ROW_INDEX, read_tabular, suffix

#: Counters of one aggregation; more would outgrow the size of generated code.
BATCH = 100
#: Seconds between reports while metrics run.
REPORT_S = 5.0


class Control:
    """Cancel, pause and resume from signals or other threads."""

    def __init__(self) -> None:
        self.cancelled = threading.Event()
        self.running = threading.Event()
        self.running.set()

    def install(self) -> None:
        """SIGINT cancels, SIGUSR1 pauses, SIGUSR2 resumes."""
        signal.signal(signal.SIGINT, lambda *_: (self.cancelled.set(), self.running.set()))
        signal.signal(signal.SIGUSR1, lambda *_: self.running.clear())
        signal.signal(signal.SIGUSR2, lambda *_: self.running.set())


def workers_for(metrics: int, asked: int | None = None) -> int:
    """Threads that submit jobs: as asked, else one less than the processors, 4 at most."""
    cpus = os.cpu_count() or 1
    return max(1, min(metrics, asked or (1 if cpus <= 2 else min(4, cpus - 1))))


def fused_counts(df: DataFrame, metrics: list[Metric]) -> list[dict]:
    """The counters of all metrics, evaluated over one derived frame in batches of aggregates."""
    wide = df
    for m in metrics:
        wide = m.derive(wide)
    named = [(i, n, c) for i, m in enumerate(metrics) for n, c in m.counters.items()]
    out: list[dict] = [{} for _ in metrics]
    for at in range(0, len(named), BATCH):
        part = named[at : at + BATCH]
        row = wide.agg(*[c.alias(f"c{k}") for k, (_, _, c) in enumerate(part)]).first()
        for value, (i, n, _) in zip(row, part):
            out[i][n] = value
    return out


def finish_metric(df: DataFrame, metric: Metric, counters: dict) -> dict:
    """A metric's result; examples are only looked for if one of the counters they show is above zero."""
    wide = metric.derive(df)
    tables = {n: [r.asDict(True) for r in make(wide).collect()] for n, make in metric.tables.items()}
    examples = {}
    for n, make in metric.examples.items():
        asked = n not in metric.wanted or any(counters.get(c) for c in metric.wanted[n])
        examples[n] = [r.asDict(True) for r in make(wide).collect()] if asked else []
    return metric.finish(counters, tables, examples)


def load_dataset(spark: SparkSession, path: str | Path, row_index: bool = True, metrics: list[dict] | None = None) -> DataFrame:
    """Packets of a capture or of a folder of captures, or a tabular dataset with row numbers.

    Of packets only the columns that the metrics need are parsed.
    """
    kind = suffix(str(path))
    if kind in CAPTURES or not kind:
        alone = metrics is not None and all(m["metric_id"] == "timestamp_coherence_profile" for m in metrics)
        return read_pcap(spark, str(path), ("packet_index", "ts") if alone else COLUMNS[1:])
    return read_tabular(spark, str(path), row_index)


def _texts(value: object) -> set[str]:
    """All texts anywhere in a document."""
    if isinstance(value, str):
        return {value}
    parts = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return set().union(*map(_texts, parts))


def needed_columns(df: DataFrame, metrics: list[dict]) -> DataFrame:
    """``df`` with the columns that the metrics could name, so that scans and caches hold no others."""
    if "packet_index" in df.columns:
        return df
    named = _texts(metrics) | {ROW_INDEX, *DEFAULT_FIELDS}
    kept = [c for c in df.columns if c in named]
    return df.select(*[quoted(c) for c in kept]) if kept else df


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def run_metrics(spark: SparkSession, df: DataFrame | None, metrics: list[dict], fail_fast: bool = True, workers: int | None = None, control: Control | None = None, report: Callable[[dict, dict, float | None], None] | None = None, load_error: str | None = None) -> tuple[str, list[dict], dict, dict]:
    """(status, records, results, column validations) of the metrics, in plan order.

    ``report`` is given states and seconds by metric id and the share of finished tasks, as metrics end
    and every few seconds. With ``fail_fast`` nothing behind the first failed metric is reported. A metric that raises is
    a failed metric. After a cancel, the metrics not finished are cancelled and their jobs stopped.
    """
    control = control or Control()
    group = f"assayer-{time.time_ns()}"
    built: dict[int, Metric] = {}
    failed: dict[int, dict] = {}
    began = time.perf_counter()
    status: dict[str, str] = {}
    for i, spec in enumerate(metrics):
        try:
            if df is None:
                raise Rejected(load_error or "Failed to load dataset")
            built[i] = build_metric(df, spec)
        except Rejected as e:
            failed[i] = e.payload
        except Exception as e:  # a broken spec fails its own metric only
            failed[i] = {"error": f"{type(e).__name__}: {e}"}
    last = min(failed) if failed and fail_fast else len(metrics)
    order = [i for i in built if i < last]
    took = {i: 0.0 for i in range(len(metrics))}
    results: dict[int, dict] = {}
    if order and df is not None:
        cached = needed_columns(df, metrics)
        if len(order) > 1:
            cached = cached.persist()
        try:
            spark.sparkContext.setJobGroup(group, "metric counters", True)
            try:
                firsts = [i for i in order if metrics[i]["metric_id"] not in {metrics[k]["metric_id"] for k in order if k < i}]
                shared = dict(zip(firsts, fused_counts(cached, [built[i] for i in firsts])))
            except Exception as e:
                if "Failed to scan" in str(e) or control.cancelled.is_set():
                    raise
                shared = {}  # one metric's counters break the common scan: each gets its own

            def tell() -> None:
                if report:
                    report(dict(status), {metrics[k]["metric_id"]: took[k] for k in took if took[k]}, task_share(spark, group))

            def one(i: int) -> None:
                control.running.wait()
                if control.cancelled.is_set():
                    return
                spec, start = metrics[i], time.perf_counter()
                status[spec["metric_id"]] = "running"
                spark.sparkContext.setJobGroup(group, spec["metric_id"], True)
                try:
                    counts = shared[i] if i in shared else fused_counts(cached, [built[i]])[0]
                    results[i] = finish_metric(cached, built[i], counts)
                except Rejected as e:
                    failed[i] = e.payload
                except Exception as e:
                    if control.cancelled.is_set():
                        return
                    failed[i] = {"error": f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"}
                took[i] = round(time.perf_counter() - start, 6)
                status[spec["metric_id"]] = "success" if i in results else "failed"
                tell()

            with ThreadPoolExecutor(workers_for(len(order), workers)) as pool:
                waiting, told = [pool.submit(one, i) for i in order], time.monotonic()
                while not all(f.done() for f in waiting):
                    if control.cancelled.wait(0.05):
                        spark.sparkContext.cancelJobGroup(group)
                    if time.monotonic() - told >= REPORT_S:
                        tell()
                        told = time.monotonic()
                    if fail_fast and failed:
                        for i, f in zip(order, waiting):
                            if i > min(failed):
                                f.cancel()
                for f in waiting:
                    if not f.cancelled():
                        f.result()
        except Exception as e:
            if not control.cancelled.is_set():
                error = str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__
                failed |= {i: {"error": error} for i in order if i not in results}
        finally:
            cached.unpersist()
    records, out, validations, overall = [], {}, {}, "success"
    for i, spec in enumerate(metrics):
        name = spec["metric_id"]
        record = {"metric_id": name, "status": "success", "started_at": _now(), "finished_at": _now(), "elapsed_seconds": took[i] or round(time.perf_counter() - began, 6)}
        if i in results:
            result = results[i]
            if "__column_validation" in result:
                validations[name] = result.pop("__column_validation")
            out[name] = result
        elif i in failed:
            record |= {"status": "failed", "error": failed[i].get("error", "Unknown error")}
            if "column_validation" in failed[i]:
                validations[name] = failed[i]["column_validation"]
            overall = "failed" if overall == "success" else overall
        elif control.cancelled.is_set():
            overall = "cancelled"
            records.append(record | {"status": "cancelled", "error": "Cancelled by user"})
            break
        records.append(record)
        if record["status"] == "failed" and fail_fast:
            break
    return overall, records, out, validations


def run_case(spark: SparkSession, case: Case, ranks: dict[str, int] | None = None, strict: bool = False, workers: int | None = None, control: Control | None = None, report=None) -> dict:
    """Run a case and write its outcome document; returns the outcome."""
    check_plan(case.plan)
    metrics = [m for m in case.plan["metrics"] if m.get("enabled", True)]
    if ranks is not None:
        metrics = order_metrics(metrics, ranks, strict)
    if not metrics:
        raise ValueError("The plan does not contain any enabled metrics.")
    started, clock = _now(), time.perf_counter()
    df, error = None, None
    try:
        df = load_dataset(spark, case.dataset, metrics=metrics)
    except Exception as e:
        lines = [x.strip() for x in str(e).splitlines() if x.strip()]
        error = f"Failed to load dataset: {next((x for x in lines if x.startswith(('ValueError', 'FileNotFoundError'))), lines[0] if lines else type(e).__name__)}"
    fail_fast = case.plan.get("execution_policy", {}).get("fail_fast", True)
    status, records, results, validations = run_metrics(spark, df, metrics, fail_fast, workers, control, report, error)
    outcome = {
        "status": status, "case_id": case.case_id, "plan_id": case.plan["plan_meta"]["plan_id"], "metric_ids": [m["metric_id"] for m in metrics],
        "dataset_path": str(case.dataset), "plan_taxonomy": plan_tree(metrics), "metric_results": records, "test_results": results,
        "test_results_taxonomy": results_tree(metrics, results), "result_taxonomy": result_tree(metrics, records, results),
        "run_started_at": started, "run_finished_at": _now(), "run_elapsed_seconds": round(time.perf_counter() - clock, 6),
    }
    if validations:
        outcome["column_validations"] = validations
    write_text(spark, case.output, json.dumps(outcome, indent=2, default=str))
    return outcome


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Run a quality plan on a dataset.")
    parser.add_argument("--case", required=True, help="case document, or plan document with --dataset and --output")
    parser.add_argument("--dataset")
    parser.add_argument("--output")
    parser.add_argument("--case-id", default="ad_hoc_case")
    parser.add_argument("--taxonomy-file")
    parser.add_argument("--taxonomy-strict", action="store_true")
    parser.add_argument("--workers", type=int)
    parser.add_argument("--master")
    args = parser.parse_args(argv)
    builder = SparkSession.builder.appName("assayer").config("spark.sql.session.timeZone", "UTC").config("spark.scheduler.mode", "FAIR")
    spark = (builder.master(args.master) if args.master else builder).getOrCreate()
    case = load_case(args.case, args.dataset, args.output, args.case_id, spark)
    ranks = load_ranks(args.taxonomy_file, spark) if args.taxonomy_file else None
    control = Control()
    control.install()
    enabled = [m for m in case.plan.get("metrics", []) if m.get("enabled", True)]
    print(f"{case.plan['plan_meta'].get('name')} ({case.plan['plan_meta'].get('plan_id')}) | case {case.case_id} | {case.dataset} -> {case.output}")

    def report(states, seconds, share):
        print(*run_lines(enabled, states, seconds, share), sep="\n")

    outcome = run_case(spark, case, ranks, args.taxonomy_strict, args.workers, control, report)
    print("Results by taxonomy:", *tree_lines(outcome["result_taxonomy"]), sep="\n")
    return 0 if outcome["status"] == "success" else 1


if __name__ == "__main__":
    raise SystemExit(main())
