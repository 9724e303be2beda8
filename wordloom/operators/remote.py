"""Resilient remote calls: retries, error classes and a circuit breaker, over Arrow batches, with an injected transport."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

RESULT = "ok boolean, payload string, error_class string, error_detail string, latency_ms int, attempts int, circuit_open boolean, http_status int"
#: A transport takes (vendor, payload, timeout) and gives (status, body); it raises TimeoutError or OSError.
Transport = Callable[[str, str, float], tuple[int, str]]
RETRIED = ("timeout", "http_5xx", "network", "unknown")


@dataclass
class Breaker:
    """Opens for `cooldown` seconds after `most` failed calls in a row; a success resets it."""

    most: int = 3
    cooldown: float = 60.0
    clock: Callable[[], float] = time.monotonic
    failures: dict[str, int] = field(default_factory=dict)
    opened: dict[str, float] = field(default_factory=dict)

    def is_open(self, vendor: str) -> bool:
        if vendor in self.opened and self.clock() - self.opened[vendor] >= self.cooldown:
            self.reset(vendor)
        return vendor in self.opened

    def failed(self, vendor: str) -> None:
        self.failures[vendor] = self.failures.get(vendor, 0) + 1
        if self.failures[vendor] >= self.most:
            self.opened.setdefault(vendor, self.clock())

    def reset(self, vendor: str | None = None) -> None:
        for state in (self.failures, self.opened):
            state.clear() if vendor is None else state.pop(vendor, None)


def _classified(status: int) -> str:
    return "auth" if status in (401, 403) else "http_4xx" if status < 500 else "http_5xx"


def call(vendor: str, payload: object, transport: Transport, breaker: Breaker, timeout: float = 30.0, retries: int = 2, backoff: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One call's envelope; it never raises. Only timeouts, 5xx, network and unknown errors are tried again; the breaker counts calls, not attempts."""
    began = time.monotonic()
    made = dict.fromkeys(("payload", "error_class", "error_detail", "http_status")) | {"ok": False, "attempts": 0, "circuit_open": False}
    done = lambda **more: made | more | {"latency_ms": int(1000 * (time.monotonic() - began))}
    if breaker.is_open(vendor):
        return done(error_class="circuit_open", error_detail=f"{vendor} is resting", circuit_open=True)
    try:
        body = payload if isinstance(payload, str) else json.dumps(payload)
    except (TypeError, ValueError) as error:
        return done(error_class="payload_encode", error_detail=str(error))
    for attempt in range(retries + 1):
        made["attempts"] = attempt + 1
        try:
            status, answer = transport(vendor, body, timeout)
            made["http_status"] = status
            if status != 200:
                kind, detail = _classified(status), f"status {status}"
            else:
                content = json.loads(answer).get("content")
                if content:
                    breaker.reset(vendor)
                    return done(ok=True, payload=content)
                kind, detail = "empty_response", "no content"
        except TimeoutError as error:
            kind, detail = "timeout", str(error)
        except OSError as error:
            kind, detail = "network", str(error)
        except (ValueError, AttributeError) as error:
            kind, detail = "parse", str(error)
        except Exception as error:  # the envelope says so
            kind, detail = "unknown", str(error)
        if kind not in RETRIED or attempt == retries:
            break
        sleep(backoff * 2**attempt)
    breaker.failed(vendor)
    return done(error_class=kind, error_detail=detail)


def call_with_fallback(primary: str, fallback: str, payload: object, transport: Transport, breaker: Breaker, **options) -> dict:
    """The fallback's answer where the primary has none; if both fail, the primary's envelope."""
    first = call(primary, payload, transport, breaker, **options)
    if first["ok"]:
        return first
    second = call(fallback, payload, transport, breaker, **options)
    return second if second["ok"] else first


def call_all(requests: DataFrame, transport: Transport, breaker: Breaker | None = None, **options) -> DataFrame:
    """requests (id, vendor, payload) -> id and the envelope's fields; a breaker for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Breaker(breaker.most, breaker.cooldown) if breaker else Breaker()
        for batch in batches:
            rows = [{"id": r.id} | call(r.vendor, r.payload, transport, own, **options) for r in batch.itertuples()]
            yield pd.DataFrame(rows, columns=["id", *[f.split(" ")[0] for f in RESULT.split(", ")]])

    return requests.select("id", "vendor", "payload").mapInPandas(run, f"id long, {RESULT}")
