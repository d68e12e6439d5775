"""Live fetching on the executors: hosts in turn, few requests and a gap between starts at each of them.

All addresses of a host go to one task, so its limits hold without any shared
state; a task serves its hosts with a few threads.  ``HostQueue`` decides what
may start when and knows no clock of its own.
"""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inputs import RESPONSES, fetch
from .robots import delay_ms


@dataclass(frozen=True)
class Manners:
    concurrency: int = 4
    per_host: int = 2
    delay_ms: int = 250
    timeout_ms: int = 20_000
    agent: str = "auditlake"


@dataclass
class _Host:
    waiting: deque = field(default_factory=deque)
    running: int = 0
    next_start: float = 0.0
    answered: bool = False


class HostQueue:
    """Waiting items by host.  A host that has not answered yet gets one request at a time."""

    def __init__(self, per_host: int, gap: Callable[[str], float]):
        self.per_host, self.gap = per_host, gap
        self.hosts: dict[str, _Host] = {}
        self.turn: deque[str] = deque()
        self.closed = False

    def add(self, host: str, item) -> None:
        entry = self.hosts.setdefault(host, _Host())
        if not entry.waiting:
            self.turn.append(host)
        entry.waiting.append(item)

    def take(self, now: float) -> tuple[str, object] | None:
        """The next item that may start now; its host goes to the end of the turn."""
        for _ in range(0 if self.closed else len(self.turn)):
            host = self.turn.popleft()
            entry = self.hosts[host]
            free = entry.running < (self.per_host if entry.answered else 1)
            if not free or entry.next_start > now:
                self.turn.append(host)
                continue
            item = entry.waiting.popleft()
            entry.running += 1
            entry.next_start = now + self.gap(host)
            if entry.waiting:
                self.turn.append(host)
            return host, item
        return None

    def release(self, host: str) -> None:
        entry = self.hosts[host]
        entry.running -= 1
        entry.answered = True

    def soonest(self) -> float | None:
        """When a waiting item of a host with a free place may start; None if none can before a release."""
        free = (e.next_start for h in self.turn if (e := self.hosts[h]).running < (self.per_host if e.answered else 1))
        return None if self.closed else min(free, default=None)

    def close(self) -> None:
        """Nothing starts any more."""
        self.closed = True


def serve(queue: HostQueue, open_one: Callable[[object], tuple], concurrency: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple]:
    """Results of ``open_one`` as they come in; what the queue holds is started as soon as it may be."""
    running: dict[Future, str] = {}
    with ThreadPoolExecutor(concurrency) as threads:
        while True:
            while len(running) < concurrency and (taken := queue.take(clock())):
                running[threads.submit(open_one, taken[1])] = taken[0]
            soonest = queue.soonest() if len(running) < concurrency else None
            pause = None if soonest is None else max(0.0, soonest - clock())
            if running:
                done, _ = wait(running, timeout=pause, return_when=FIRST_COMPLETED)
                for future in done:
                    queue.release(running.pop(future))
                    yield future.result()
            elif pause is None:
                return
            else:
                sleep(pause)


def gaps(manners: Manners, delays: dict[str, int]) -> Callable[[str], float]:
    """Seconds between two starts at a host: a crawl delay can only make them more."""
    return lambda host: max(manners.delay_ms, delays.get(host, 0)) / 1000


class LiveResponses:
    """Answers of the network in the schema of recorded responses; ``crawl`` calls it in place of a table.

    ``delays``: crawl delays by host, filled by ``robots``; bounded by the hosts of the crawl.
    """

    columns = [c.split()[0] for c in RESPONSES.split(", ")]

    def __init__(self, manners: Manners, open_one: Callable[[str, str, float, str], tuple] = fetch):
        self.manners, self.open_one = manners, open_one
        self.delays: dict[str, int] = {}

    def __call__(self, urls: DataFrame, method: str = "GET") -> DataFrame:
        """One response for each row of ``urls`` (url and perhaps wait_s, seconds to wait before)."""
        manners, open_one, delays, names = self.manners, self.open_one, dict(self.delays), self.columns

        def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            queue = HostQueue(manners.per_host, gaps(manners, delays))
            for part in parts:
                for host, url, wait_s in part[["host", "url", "wait_s"]].itertuples(index=False):
                    queue.add(host, (url, wait_s))

            def one(item: tuple[str, float]) -> tuple:
                if item[1] > 0:
                    threading.Event().wait(item[1])
                return open_one(item[0], method, manners.timeout_ms / 1000, manners.agent)

            for row in serve(queue, one, manners.concurrency):
                yield pd.DataFrame([row], columns=names)

        host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
        wait_s = F.coalesce(F.col("wait_s").cast("double"), F.lit(0.0)) if "wait_s" in urls.columns else F.lit(0.0)
        return urls.select("url", host.alias("host"), wait_s.alias("wait_s")).repartition("host").mapInPandas(run, RESPONSES)

    def robots(self, found: dict[str, str]) -> None:
        """Learn the crawl delays of robots texts by origin."""
        for origin, text in found.items():
            if delay := delay_ms(text, self.manners.agent):
                self.delays[origin.partition("://")[2]] = delay
