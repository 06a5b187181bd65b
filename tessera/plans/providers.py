"""Protocols of outside models, deterministic stand-ins for tests, and requests with retry."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np

#: Answers of a server that a second try may mend.
RETRIED = (502, 503, 504)


class EmbeddingProvider(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Scorer(Protocol):
    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class Generator(Protocol):
    def __call__(self, system: str, user: str) -> str: ...


def hashed_embedding(dim: int = 64) -> EmbeddingProvider:
    """Signed hashed word counts: a stand-in that needs no model, not a substitute for one."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 16 & 1 else -1
        return out

    return embed


def overlap_scorer(pairs: list[tuple[str, str]]) -> list[float]:
    return [len(set(q.lower().split()) & set(t.lower().split())) / max(1, len(set(q.lower().split()))) for q, t in pairs]


@dataclass
class Transport:
    """What the calls of one batch took: requests sent, those that were second tries, time-outs, failures and bytes."""

    requests: int = 0
    retries: int = 0
    timeouts: int = 0
    failures: int = 0
    bytes_sent: int = 0
    bytes_received: int = 0


def post_json(
    url: str, body: dict, timeout: float = 30.0, tries: int = 4, wait: float = 0.5, sleep: Callable[[float], None] = time.sleep, send: Callable | None = None, transport: Transport | None = None
) -> dict:
    """POST and read JSON; after a time-out or an answer of RETRIED again, waiting twice as long each time. `transport` is
    added to, whether or not the call succeeds in the end."""
    data, t = json.dumps(body).encode(), transport or Transport()
    send = send or (lambda: urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json"}), timeout=timeout).read())
    for n in range(tries):
        t.requests += 1
        t.retries += n > 0
        t.bytes_sent += len(data)
        try:
            got = send()
            t.bytes_received += len(got)
            return json.loads(got)
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED or n == tries - 1:
                t.failures += 1
                raise
        except (TimeoutError, urllib.error.URLError) as e:
            t.timeouts += isinstance(e, TimeoutError) or isinstance(getattr(e, "reason", None), TimeoutError)
            if n == tries - 1:
                t.failures += 1
                raise
        sleep(wait * 2**n)
    raise AssertionError


#: Models that this process has loaded.
_models: dict[tuple, object] = {}


@dataclass(frozen=True)
class Loaded:
    """A model that each worker process makes once, when it is first called there, and keeps for all its tasks.

    `factory` is a function of a module that workers can import, called with `args` and with the local paths of `files`, which
    `distribute` has sent to every node. What is sent with a task is this description, not the model.
    """

    factory: Callable
    args: tuple = ()
    files: tuple[str, ...] = ()

    def model(self) -> object:
        key = (self.factory.__module__, self.factory.__qualname__, self.args, self.files)
        if key not in _models:
            from pyspark import SparkFiles

            _models[key] = self.factory(*self.args, *map(SparkFiles.get, self.files))
        return _models[key]

    def __call__(self, *args: object, **named: object) -> object:
        return self.model()(*args, **named)


def distribute(spark, path: str) -> str:
    """Send a file to every node once, and give the name that `Loaded` asks for."""
    spark.sparkContext.addFile(path)
    return path.rstrip("/").rsplit("/", 1)[-1]


def http_generator(url: str, **options: object) -> Generator:
    return lambda system, user: post_json(url, {"system": system, "user": user}, **options)["text"]


def http_scorer(url: str, **options: object) -> Scorer:
    return lambda pairs, **counted: post_json(url, {"pairs": pairs}, **options, **counted)["scores"]


def ollama_generator(url: str, model: str, **options: object) -> Generator:
    """A generator behind a local model server's /api/generate, asked for one whole reply."""

    def generate(system: str, user: str) -> str:
        return post_json(f"{url.rstrip('/')}/api/generate", {"model": model, "system": system, "prompt": user, "stream": False}, **options)["response"]

    return generate


@dataclass(frozen=True)
class RerankConfig:
    """How candidates are reranked: by `scorer`, or by the service at `url`."""

    url: str | None = None
    max_chars: int = 2000
    batch: int = 16
    normalize: bool = False
    timeout: float = 30.0
    tries: int = 4

    def rerank(self, candidates, k: int, scorer: Scorer | None = None):
        from tessera.operators.fusion import rerank_model

        if scorer is None and not self.url:
            raise ValueError("a reranker needs a scorer or an address")
        scorer = scorer or http_scorer(self.url, timeout=self.timeout, tries=self.tries)
        return rerank_model(candidates, scorer, k, self.max_chars, self.batch, self.normalize)
