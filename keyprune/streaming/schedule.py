"""Processors that run on their own: their settings, kept in the store, and the loops that follow them."""

from __future__ import annotations

import threading
import time
from dataclasses import asdict, dataclass, replace
from datetime import datetime

from ..operators import maintain
from ..plans.fragments import Options
from ..sources.store import Store
from .queue import Queue

_SETTINGS = "job string, name string, value string, version long"
_EVICTIONS = "partition_key string, strategy string, removed long, created_at timestamp"


@dataclass(frozen=True)
class QueueSettings:
    enabled: bool = True
    workers: int = 5
    every_s: int = 1
    timeout_s: float = 1800
    stale_s: float = 3600  # requests that a stopped processor held are taken up again after so long
    limit: int = 0  # keys of a set; 0: any number

    def __post_init__(self):
        if not 1 <= self.workers <= 20 or self.every_s < 1 or self.timeout_s <= 0:
            raise ValueError("1 to 20 workers, a second or more between runs, a positive timeout")


@dataclass(frozen=True)
class EvictionSettings:
    enabled: bool = False
    every_s: int = 3600
    strategy: str = "oldest"
    threshold: int = 1000

    def __post_init__(self):
        if self.strategy not in ("oldest", "largest") or self.threshold < 0 or self.every_s < 1:
            raise ValueError("strategy oldest or largest, a threshold of 0 or more")


def job_of(kind: str, name: str) -> str:
    """A schedule's name: its kind and what it serves, fit for a name of a job."""
    return f"keyprune_{kind}_{''.join(c if c.isalnum() else '_' for c in name)}"


def save(store: Store, job: str, settings: QueueSettings | EvictionSettings) -> None:
    now = time.time_ns()
    store._note([(job, k, repr(v), now) for k, v in asdict(settings).items()], "settings", _SETTINGS)


def load(store: Store, job: str, default: QueueSettings | EvictionSettings):
    """The newest settings saved for a job, else the given ones."""
    rows = sorted(store._read("settings", _SETTINGS).filter(f"job = '{job}'").collect(), key=lambda r: r.version)
    kinds = {k: type(v) for k, v in asdict(default).items()}
    read = {r.name: r.value == "True" if kinds[r.name] is bool else kinds[r.name](r.value.strip("'")) for r in rows if r.name in kinds}
    return replace(default, **read)


class Scheduler:
    """Runs a store's queue and its evictions in a thread each, as their settings say at each turn, until it is stopped."""

    def __init__(self, store: Store, name: str = "default", options: Options = Options()):
        self.store, self.name, self.options = store, name, options
        self._stop = threading.Event()
        self._threads: list[threading.Thread] = []

    def queue_turn(self, n: int = 100) -> bool:
        """One turn of the queue's processor: whether it ran."""
        s = load(self.store, job_of("queue", self.name), QueueSettings())
        if not s.enabled:
            return False
        Queue(self.store, self.options, s.workers, s.timeout_s, s.limit or None).process("", n)
        return True

    def eviction_turn(self) -> int:
        """One turn of eviction: how many sets went. Each is logged."""
        s = load(self.store, job_of("eviction", self.name), EvictionSettings())
        if not s.enabled:
            return 0
        victims = (maintain.largest_over if s.strategy == "largest" else maintain.oldest_over)(self.store.queries(), s.threshold)
        gone = maintain.remove(self.store, victims)
        self.store._note([(self.name, s.strategy, gone, datetime.now())], "evictions", _EVICTIONS)
        return gone

    def evictions(self):
        return self.store._read("evictions", _EVICTIONS)

    def start(self) -> None:
        def loop(turn, kind: str, default) -> None:
            while not self._stop.is_set():
                turn()
                self._stop.wait(load(self.store, job_of(kind, self.name), default).every_s)

        for turn, kind, default in ((self.queue_turn, "queue", QueueSettings()), (self.eviction_turn, "eviction", EvictionSettings())):
            self._threads.append(threading.Thread(target=loop, args=(turn, kind, default), daemon=True))
            self._threads[-1].start()

    def stop(self) -> None:
        self._stop.set()
        for t in self._threads:
            t.join()

    def status(self) -> dict:
        return {"name": self.name, "running": any(t.is_alive() for t in self._threads), "queue": asdict(load(self.store, job_of("queue", self.name), QueueSettings())), "eviction": asdict(load(self.store, job_of("eviction", self.name), EvictionSettings()))} | Queue(self.store).status()
