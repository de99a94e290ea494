"""Timestamp coherence over a stream of packets, in arrival order.

Out-of-order timestamps are what is measured, so there is no watermark and nothing is dropped. Each
micro-batch is folded by :func:`assayer.operators.timestamps.gap_facts`; the running fold is merged with
it on the driver, a few numbers a capture, with the difference over the seam between batches. The fold is
written before the batch counts as done, with its batch number, so a replayed batch is not counted twice.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from assayer.operators.timestamps import gap_facts, gap_result

EMPTY = {"packet_count": 0, "first_timestamp": None, "last_timestamp": None, "backwards_jump_count": 0, "zero_delta_count": 0, "large_gap_count": 0, "gap_count": 0, "gap_sum": 0.0, "gap_max": None}


def merge_folds(a: dict, b: dict, threshold: float) -> dict:
    """The fold of two stretches of packets, ``a`` before ``b``. Associative; an empty fold is neutral."""
    if not a["packet_count"] or not b["packet_count"]:
        return dict(b if b["packet_count"] else a)
    d = b["first_timestamp"] - a["last_timestamp"]
    gap = d >= 0
    longest = [x for x in (a["gap_max"], b["gap_max"], d if gap else None) if x is not None]
    out = {k: a[k] + b[k] for k in ("packet_count", "backwards_jump_count", "zero_delta_count", "large_gap_count", "gap_count", "gap_sum")}
    out["backwards_jump_count"] += d < 0
    out["zero_delta_count"] += d == 0
    out["large_gap_count"] += d > threshold
    out["gap_count"] += gap
    out["gap_sum"] += d if gap else 0.0
    return out | {"first_timestamp": a["first_timestamp"], "last_timestamp": b["last_timestamp"], "gap_max": max(longest) if longest else None}


class CoherenceFold:
    """The running fold, kept in a JSON file. Packets of a batch are ordered by file, if they name one, then number."""

    def __init__(self, path: str, threshold: float = 1.0, order: str | list[str] | None = None, ts: str = "ts") -> None:
        self.path, self.threshold, self.order, self.ts = Path(path), threshold, order, ts

    def state(self) -> dict:
        return json.loads(self.path.read_text()) if self.path.exists() else {"batch": -1, "fold": dict(EMPTY)}

    def add(self, batch: DataFrame, number: int) -> None:
        state = self.state()
        if number <= state["batch"]:
            return
        order = self.order or [c for c in ("file", "packet_index") if c in batch.columns]
        facts = gap_facts(batch, order, self.ts, self.threshold).first().asDict()
        facts["gap_sum"] = facts["gap_sum"] or 0.0
        state = {"batch": number, "fold": merge_folds(state["fold"], facts, self.threshold)}
        part = self.path.with_suffix(".part")
        part.write_text(json.dumps(state))
        part.replace(self.path)

    def result(self) -> dict:
        return gap_result(self.state()["fold"], self.threshold)


def start_coherence(packets: DataFrame, fold: CoherenceFold, checkpoint: str, **trigger) -> StreamingQuery:
    """Fold a streaming DataFrame of packets; batches must hold packets later in arrival order than earlier ones."""
    writer = packets.writeStream.foreachBatch(fold.add).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
