"""A sampler beside a running computation (ST2): a daemon thread that calls a probe at set times."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from typing import Any


class Sampler:
    """with Sampler(probe, 1.0) as s: ...; then s.samples holds (seconds since the start, value), at most `most`, the last ones.

    A probe that raises gives the value None, so the computation beside it is never disturbed.
    """

    def __init__(self, probe: Callable[[], Any], every: float = 1.0, most: int = 100_000):
        self.probe, self.every, self.most = probe, every, most
        self.samples: list[tuple[float, Any]] = []
        self._over = threading.Event()

    def _run(self) -> None:
        began = time.monotonic()
        while True:
            try:
                value = self.probe()
            except Exception:
                value = None
            self.samples.append((time.monotonic() - began, value))
            del self.samples[: -self.most]
            if self._over.wait(self.every):
                return

    def __enter__(self) -> Sampler:
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._over.set()
        self._thread.join()
