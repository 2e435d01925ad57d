"""Several feeds into one store: a streaming query for each at its own cadence, failures kept in the feeds' marks, and queries begun again after them."""

from __future__ import annotations

import logging
import queue
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from . import ingest
from .store import Store

log = logging.getLogger(__name__)
ERROR_CHARS, FIRST_WAIT_S, MOST_WAIT_S = 1_000, 5, 900


@dataclass(frozen=True)
class Feed:
    """raw opens the stream of raw rows; normalizer gives events and rejects, None for hotspots. every is what a trigger takes, None for the feed's own cadence."""

    name: str
    raw: Callable[[], DataFrame]
    normalizer: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None
    every: str | None = None


class Ends(StreamingQueryListener):
    """Queries that end are told apart by their names; what they died of waits in a queue, as a listener shouldn't start jobs."""

    def __init__(self, feeds: dict[str, str]):
        self.feeds, self.names, self.ended = feeds, {}, queue.SimpleQueue()

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        if event.name in self.feeds:
            self.names[str(event.runId)] = self.feeds[event.name]

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        feed = self.names.pop(str(event.runId), None)
        if feed and event.exception:
            self.ended.put((feed, str(event.exception)))


@dataclass
class Runner:
    """One query a feed, one batch at a time in the store. A feed that fails is written down and begun again after a while that doubles with each failure; the others go on."""

    store: Store
    feeds: list[Feed]
    checkpoints: str
    publish: ingest.Publish | None = None
    text_rule: bool = True
    running: dict[str, StreamingQuery] = field(default_factory=dict)
    failures: dict[str, int] = field(default_factory=dict)
    again: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.ends = Ends({f"{f.name} into {self.store.path}": f.name for f in self.feeds})
        self.store.spark.streams.addListener(self.ends)

    def begin(self, feed: Feed, once: bool) -> StreamingQuery:
        at, every = f"{self.checkpoints.rstrip('/')}/{feed.name}", None if once else feed.every or ingest.cadence(feed.name)
        if feed.normalizer is None:
            return ingest.stream_hotspots(feed.raw(), self.store, at, every, feed.name)
        return ingest.stream_events(feed.raw(), feed.normalizer, self.store, at, self.publish, every, self.text_rule, feed.name)

    def start(self, once: bool = False) -> None:
        """Begins every feed that isn't running and needn't wait; a stream that can't be opened is a failure of its feed alone."""
        for feed in self.feeds:
            query = self.running.get(feed.name)
            if (query is None or not query.isActive) and self.again.get(feed.name, 0) <= time.monotonic():
                try:
                    self.running[feed.name] = self.begin(feed, once)
                except Exception as e:  # noqa: BLE001 a source raises what it will
                    self.failed(feed.name, str(e))

    def failed(self, feed: str, error: str) -> None:
        """A run that failed, with the first characters of its message. The batch's rows aren't there: it runs again."""
        n = self.failures[feed] = self.failures.get(feed, 0) + 1
        self.again[feed] = time.monotonic() + min(FIRST_WAIT_S * 2 ** (n - 1), MOST_WAIT_S)
        log.error("%s: failed %d times in a row: %s", feed, n, error[:200])
        self.store.write_failure(feed, error[:ERROR_CHARS])

    def settle(self) -> None:
        """Writes down what the listener has heard."""
        while not self.ends.ended.empty():
            self.failed(*self.ends.ended.get())
        for name, query in self.running.items():
            if query.lastProgress is not None and (query.isActive or query.exception() is None):
                self.failures[name] = 0

    def run_once(self) -> None:
        """What every feed has now, each to its end or its failure."""
        self.start(once=True)
        for query in list(self.running.values()):
            try:
                query.awaitTermination()
            except StreamingQueryException:
                log.warning("%s ended by an error", query.name)
        self.store.spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
        deadline = time.monotonic() + 10
        while time.monotonic() < deadline and any(q.exception() is not None and str(q.runId) in self.ends.names for q in self.running.values()):
            time.sleep(0.1)  # what the listener hears comes a moment later
        self.settle()

    def run(self, stop: Callable[[], bool], poll_s: float = 1.0) -> None:
        """All feeds at their cadences until told to stop; then each ends the batch that it is in."""
        while not stop():
            self.start()
            time.sleep(poll_s)
            self.settle()
        self.close()

    def close(self) -> None:
        for query in self.running.values():
            query.stop()
        self.settle()
        self.store.spark.streams.removeListener(self.ends)

    def marks(self, marks: DataFrame, at: str) -> DataFrame:
        """The feeds' marks after all runs so far, with failures."""
        return ingest.feed_marks(self.store, marks, at)


def healthy(marks: DataFrame) -> DataFrame:
    """Feeds whose last run went well."""
    return marks.filter(F.col("consecutive_failures") == 0)
