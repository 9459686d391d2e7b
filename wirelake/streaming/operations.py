"""Running streams: rules that change while a stream runs, and counts of the engine itself."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import filters


def routed_batches(rules: Callable[[], Sequence[filters.Rule]], then: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: asks for the rules anew for every micro-batch, keeps and routes the packets that they name, and hands them on."""

    def run(packets: DataFrame, number: int) -> None:
        now = list(rules())
        then(filters.route(packets.where(filters.rule_predicate(now)), now), number)

    return run


class SelfMetrics(StreamingQueryListener):
    """Counts of streams started and ended, micro-batches and rows, as (name, value) pairs."""

    def __init__(self) -> None:
        self.values: Counter[str] = Counter()

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.values["streams_started_total"] += 1

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self.values["batches_total"] += 1
        self.values["rows_total"] += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.values["streams_ended_total"] += 1
        self.values["streams_failed_total"] += event.exception is not None

    def lines(self) -> list[str]:
        return [f"{name} {value:.6f}" for name, value in sorted(self.values.items())]


def watch(rows: DataFrame, most: int = 100, idle_seconds: float = 5.0) -> list[str]:
    """The next rows of a stream as JSON lines: at most ``most``, until none has come for ``idle_seconds``. Rows beyond that are passed over, as watching is lossy by design."""
    seen: list[str] = []
    last = [time.time()]

    def keep(batch: DataFrame, _: int) -> None:
        if len(seen) < most:
            new = [r[0] for r in batch.select(F.to_json(F.struct("*"))).limit(most - len(seen)).collect()]
            seen.extend(new)
            last[0] = time.time() if new else last[0]

    query = rows.writeStream.foreachBatch(keep).start()
    try:
        while query.isActive and len(seen) < most and time.time() - last[0] < idle_seconds:
            query.awaitTermination(0.2)
    finally:
        query.stop()
    return seen
