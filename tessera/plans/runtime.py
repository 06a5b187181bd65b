"""Driver-side run state: caches, identifiers, versions, health."""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from collections.abc import Callable, Hashable
from datetime import datetime
from pathlib import Path
from threading import Lock
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession


class Cache:
    """Least recently used entries, at most `size`; counts hits and misses."""

    def __init__(self, size: int = 512):
        self.size, self.hits, self.misses = size, 0, 0
        self._entries: OrderedDict[Hashable, object] = OrderedDict()
        self._lock = Lock()

    def get(self, key: Hashable, make: Callable[[], object]) -> object:
        with self._lock:
            if key in self._entries:
                self.hits += 1
                self._entries.move_to_end(key)
                return self._entries[key]
            self.misses += 1
        value = make()
        with self._lock:
            self._entries[key] = value
            while len(self._entries) > self.size:
                self._entries.popitem(last=False)
        return value

    def stats(self) -> dict[str, int]:
        return {"hits": self.hits, "misses": self.misses, "size": len(self._entries), "capacity": self.size}


def canonical_query(query: str) -> str:
    return " ".join(query.split())


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def retrieval_key(query: str, lexical: str, top_k: int, alpha: float, dense_k: int, lexical_k: int, index: str, model: str) -> tuple:
    return canonical_query(query), hashlib.sha256(lexical.encode()).hexdigest(), top_k, alpha, dense_k, lexical_k, index, model


def run_id(zone: str = "America/Toronto", now: datetime | None = None) -> str:
    return (now or datetime.now(ZoneInfo(zone))).strftime("%Y%m%d_%H%M%S")


def artefact_dir(root: str, kind: str, config: dict, stamp: str | None = None) -> str:
    name = config_hash(config)
    return f"{root}/{kind}/{stamp}__{name}" if stamp else f"{root}/{kind}/{name}"


def newest(folder: str) -> str | None:
    """The subfolder whose name is last."""
    names = sorted(p.name for p in Path(folder).iterdir() if p.is_dir()) if Path(folder).is_dir() else []
    return f"{folder}/{names[-1]}" if names else None


def finished_runs(spark: SparkSession, root: str, marker: str | None = "_SUCCESS") -> list[str]:
    """Subfolders in the order of their names that hold the marker of a finished write, wherever Hadoop's file systems reach.

    Spark writes that marker last, so a run that is under way or was lost has none. Without a marker all subfolders."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        return []
    Path_ = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folders = [f.getPath() for f in system.listStatus(where) if f.isDirectory()]
    return sorted(f.toString() for f in folders if marker is None or system.exists(Path_(f, marker)))


def newest_run(spark: SparkSession, root: str) -> str | None:
    """The last finished run."""
    found = finished_runs(spark, root)
    return found[-1] if found else None


def versions(index: str, model: str, prompt: str) -> dict[str, str]:
    from tessera.operators.answers import PROMPT_VERSION

    return {"index_version": index, "embedding_model": model, "prompt_version": prompt or PROMPT_VERSION}


def health(components: dict[str, DataFrame | Callable[[], bool] | None], required: tuple[str, ...] = ()) -> dict:
    """Each component's state (a table must have a row, a function be true) and theirs together: error if a required one
    fails, degraded if another does."""
    states = {}
    for name, c in components.items():
        try:
            good = c is not None and (not c.isEmpty() if isinstance(c, DataFrame) else bool(c()))
            states[name] = "ok" if good else "missing"
        except Exception as e:
            states[name] = f"error: {type(e).__name__}"
    bad = [n for n, s in states.items() if s != "ok"]
    return {"status": "error" if any(n in required for n in bad) else "degraded" if bad else "ok", "components": states}


def valid_request(query: str, top_k: int, history: list[dict] | None) -> list[str]:
    """What is wrong with a request; nothing if it is valid."""
    faults = []
    if not (query or "").strip():
        faults.append("query is blank")
    if not 1 <= top_k <= 20:
        faults.append("top_k must be 1 to 20")
    if len(history or []) > 12:
        faults.append("history is longer than 12 turns")
    for t in history or []:
        if t.get("role") not in ("user", "assistant") or not 1 <= len(t.get("content", "")) <= 2000:
            faults.append("a turn needs a role of user or assistant and 1 to 2000 characters")
            break
    return faults
