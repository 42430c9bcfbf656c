"""Progress of streaming queries: a line per so many rows or seconds, with rate and time left."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class Heartbeat:
    """Says where a job is every `rows` rows or `seconds` seconds; stalled() says so when nothing has come for a while."""

    def __init__(self, total: int | None = None, rows: int = 1000, seconds: float = 30.0, say: Callable[[str], None] = print, clock: Callable[[], float] = time.monotonic):
        self.total, self.rows, self.seconds, self.say, self.clock = total, rows, seconds, say, clock
        self.done, self.said_at, self.said_rows = 0, clock(), 0
        self.began = self.moved = self.said_at

    def line(self) -> str:
        rate = self.done / max(1e-9, self.clock() - self.began)
        left = f", {(self.total - self.done) / rate:.0f} s left" if self.total and rate > 0 else ""
        return f"{self.done}{f' of {self.total}' if self.total else ''} rows, {rate:.1f} a second{left}"

    def add(self, n: int = 1) -> None:
        self.done += n
        self.moved = self.clock()
        if self.done - self.said_rows >= self.rows or self.moved - self.said_at >= self.seconds or self.done == self.total:
            self.say(self.line())
            self.said_at, self.said_rows = self.moved, self.done

    def stalled(self) -> bool:
        if self.clock() - max(self.moved, self.said_at) < self.seconds:
            return False
        self.say(f"no progress for {self.clock() - self.moved:.0f} s; {self.line()}")
        self.said_at = self.clock()
        return True


class HeartbeatListener(StreamingQueryListener):
    """Feeds a Heartbeat from Spark's streaming queries."""

    def __init__(self, beat: Heartbeat):
        self.beat = beat

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        if event.progress.numInputRows:
            self.beat.add(event.progress.numInputRows)

    def onQueryIdle(self, event):
        self.beat.stalled()

    def onQueryTerminated(self, event):
        pass
