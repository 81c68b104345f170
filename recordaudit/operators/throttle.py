"""A call budget for all tasks of a job together.

Time is cut into windows; a window has a fixed number of leases, each for some calls, and a lease
is taken by creating its file in a shared folder, which only one task can.  So however many
tasks, machines or attempts there are, a window never gets more than ``calls`` calls; a task that finds
no lease left sleeps until the next window.  A lease ends with its window, unused calls lapse.

Machines with clocks that differ by s seconds can spread one window's calls over s more seconds, but
add none, because windows are numbered and a number's leases exist once.  Leases of windows
that ended ``KEEP`` windows ago are removed.  The folder must be on a file system that all tasks mount
(exclusive creation is not offered by object stores).
"""

from __future__ import annotations

import os
import random
import re
import shutil
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

KEEP = 120  # windows


@dataclass
class CallBudget:
    """At most ``calls`` calls per ``window`` seconds over all tasks that share ``folder``."""

    folder: str
    calls: int
    window: float = 1.0
    leases: int = 32  # files per window: fewer files, larger shares
    clock: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep
    _slot: int = field(default=-1, init=False, repr=False)
    _left: int = field(default=0, init=False, repr=False)
    _lock: threading.Lock = field(default_factory=threading.Lock, init=False, repr=False)

    def __post_init__(self) -> None:
        if "://" in self.folder and not self.folder.startswith("file:"):
            raise ValueError("a call budget needs a folder that all tasks mount")
        if self.calls < 1 or self.window <= 0:
            raise ValueError("a call budget needs at least one call per window")
        self.folder = re.sub(r"^file:/+", "/", self.folder)

    def __getstate__(self) -> dict:  # a task starts without a lease
        return {k: v for k, v in self.__dict__.items() if k != "_lock"} | {"_slot": -1, "_left": 0}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, _lock=threading.Lock())

    def _shares(self) -> list[int]:
        n = min(self.leases, self.calls)
        return [self.calls // n + (k < self.calls % n) for k in range(n)]

    def _lease(self, slot: int) -> int:
        """Calls of a lease of window ``slot`` that nobody had, 0 if none is left."""
        shares = self._shares()
        place = os.path.join(self.folder, f"window-{slot}")
        os.makedirs(place, exist_ok=True)
        for k in random.sample(range(len(shares)), len(shares)):
            try:
                os.close(os.open(os.path.join(place, str(k)), os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                continue
            if k == 0:  # one task per window clears up
                self._clear(slot - KEEP)
            return shares[k]
        return 0

    def _clear(self, before: int) -> None:
        for name in os.listdir(self.folder):
            slot = name.removeprefix("window-")
            if slot.isdigit() and int(slot) < before:
                shutil.rmtree(os.path.join(self.folder, name), ignore_errors=True)

    def take(self, wanted: int = 1) -> int:
        """Wait for the right to make calls; how many of ``wanted`` may be made now (at least one).

        The threads of a task share its lease."""
        with self._lock:
            return self._take(wanted)

    def _take(self, wanted: int) -> int:
        while True:
            slot = int(self.clock() // self.window)
            if slot != self._slot:
                self._slot, self._left = slot, 0
            if not self._left:
                self._left = self._lease(slot)
            if self._left:
                n = min(wanted, self._left)
                self._left -= n
                return n
            self.sleep(max((slot + 1) * self.window - self.clock(), 0.001))
