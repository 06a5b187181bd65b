"""The chat service as a library: validation, request ids, answers, metrics, health and error mapping, without a server."""

from __future__ import annotations

import time
import uuid
from collections import Counter, deque
from collections.abc import Callable
from threading import Lock

from tessera.plans.runtime import health, valid_request


class BadRequest(ValueError):
    """A request that is well formed but can't be served."""


class NotReady(RuntimeError):
    """A part that the service needs is missing."""


#: Status and name by kind of error; the first that fits counts.
ERRORS: tuple[tuple[type[Exception], int, str], ...] = (
    (BadRequest, 400, "bad_request"), (NotReady, 503, "not_ready"), (TimeoutError, 504, "timeout"), (RuntimeError, 502, "generation_failed"), (Exception, 500, "internal_error"),
)


class Service:
    """`answer` takes (query, top_k, history) and returns a dictionary with `mode`; `components` are those of `health`."""

    def __init__(self, answer: Callable[[str, int, list], dict], components: dict | None = None, required: tuple[str, ...] = (), versions: dict | None = None, samples: int = 500):
        self.answer, self.components, self.required, self.versions = answer, components or {}, required, versions or {}
        self.outcomes: Counter[str] = Counter()
        self.latencies: deque[float] = deque(maxlen=samples)
        self._lock = Lock()

    def chat(self, body: dict, request_id: str | None = None) -> dict:
        """{"status", "request_id", "body"}: the answer with its elapsed milliseconds, or the error's name and message."""
        request_id = request_id or uuid.uuid4().hex
        faults = valid_request(body.get("query") or "", body.get("top_k", 5), body.get("history"))
        if faults:
            return self._reply(422, request_id, {"error": "invalid_request", "detail": faults})
        begun = time.perf_counter()
        try:
            found = self.answer(body["query"].strip(), body.get("top_k", 5), body.get("history") or [])
        except Exception as e:
            status, name = next((s, n) for kind, s, n in ERRORS if isinstance(e, kind))
            return self._reply(status, request_id, {"error": name, "detail": str(e)})
        elapsed = (time.perf_counter() - begun) * 1000
        with self._lock:
            self.latencies.append(elapsed)
        return self._reply(200, request_id, {**found, "total_ms": round(elapsed, 3), **self.versions})

    def _reply(self, status: int, request_id: str, body: dict) -> dict:
        with self._lock:
            self.outcomes["requests"] += 1
            self.outcomes[body.get("error") or body.get("mode") or "other"] += 1
        return {"status": status, "request_id": request_id, "body": body}

    def health(self) -> dict:
        return health(self.components, self.required) | self.versions

    def metrics(self) -> dict:
        """Counts by outcome, and interpolated percentiles of the last latencies."""
        with self._lock:
            x, counts = sorted(self.latencies), dict(self.outcomes)

        def at(share: float) -> float | None:
            if not x:
                return None
            place = share * (len(x) - 1)
            low = int(place)
            return x[low] + (x[min(low + 1, len(x) - 1)] - x[low]) * (place - low)

        return {**counts, "p50_ms": at(0.5), "p95_ms": at(0.95)}
