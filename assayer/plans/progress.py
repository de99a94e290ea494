"""What a run prints while it works: a plain line for each metric and one for the run.

States and seconds come from the runner, the share of finished tasks from Spark's status tracker. Nothing
is estimated: a metric that has not started has neither seconds nor a share.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def task_share(spark: SparkSession, group: str) -> float | None:
    """Finished tasks over all tasks of the stages that a job group has started so far; None without any."""
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    stages = [tracker.getStageInfo(k) for job in jobs if job for k in job.stageIds]
    known = [x for x in stages if x]
    total = sum(x.numTasks for x in known)
    return sum(x.numCompletedTasks for x in known) / total if total else None


def metric_line(metric: dict, state: str, seconds: float | None) -> str:
    """``place / of / metric id: state`` and its seconds, if it has any."""
    place = " / ".join([*metric.get("taxonomy_path", []), metric["metric_id"]])
    return f"{place}: {state}" + (f", {seconds:.1f} s" if seconds is not None else "")


def run_lines(metrics: list[dict], states: dict[str, str], seconds: dict[str, float], share: float | None = None) -> list[str]:
    """A line for each metric in plan order (``waiting`` if it has no state yet), then one for the run."""
    lines = [metric_line(m, states.get(m["metric_id"], "waiting"), seconds.get(m["metric_id"])) for m in metrics]
    ended = sum(states.get(m["metric_id"], "running") != "running" for m in metrics)
    tasks = "" if share is None else f", {share:.0%} of started tasks"
    return [*lines, f"{ended} of {len(metrics)} metrics ended{tasks}"]
