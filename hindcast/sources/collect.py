"""Collection: what observes an interface and lands raw responses, with the transport and the clock passed in.

Nothing here opens a connection. A transport is a function from (url, parameters) to (status, headers, body) that
raises OSError when nothing comes back; every attempt becomes a row of raw_responses, repeats included. The loops run on the
driver, one page after another, as an interface is asked; what they land is a table, and all that follows is Spark's.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.sources import schemas

Transport = Callable[[str, dict], tuple[int, dict, bytes]]


def canonical(value: Any) -> str:
    """Compact JSON with sorted keys; numbers that aren't finite become null, so that equal values have equal text."""

    def clean(x: Any) -> Any:
        if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))):
            return None
        if isinstance(x, dict):
            return {str(k): clean(v) for k, v in x.items()}
        return [clean(v) for v in x] if isinstance(x, (list, tuple)) else x

    return json.dumps(clean(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


class Ledger:
    """Rows of the bookkeeping tables of one collector run, held until they are flushed to a folder of tables."""

    def __init__(self, collector: str, clock: Callable[[], float] = time.time, configuration: dict | None = None):
        self.clock, self.collector = clock, collector
        self.run = {"collector_run_id": uuid.uuid4().hex, "collector": collector, "started_at": clock(), "finished_at": None, "status": "running", "configuration_json": canonical(configuration or {}), "note": None}
        self.responses: list[dict] = []
        self.gaps: dict[tuple, dict] = {}
        self.windows: dict[tuple, dict] = {}

    def response(self, base: str, endpoint: str, parameters: dict, asked: float, status: int | None, headers: dict, body: bytes, error: str | None) -> int:
        number = uuid.uuid4().int >> 65
        self.responses.append({"raw_response_id": number, "collector": self.collector, "base_url": base, "endpoint": endpoint, "canonical_params_json": canonical(parameters), "requested_at": asked, "received_at": self.clock(), "http_status": status, "response_headers_json": canonical({k.lower(): v for k, v in headers.items()}), "content_hash": hashlib.sha256(body).hexdigest(), "payload": body, "error_text": error})
        return number

    def gap(self, surface: str, object_id: str | None, start: float, end: float | None, reason: str) -> None:
        """A hole in what was observed; the first of equal (surface, object, start) stays, and no object stands for all."""
        row = {"collector": self.collector, "surface": surface, "object_id": object_id or "", "gap_start": start, "gap_end": end, "reason": reason[:200], "detected_at": self.clock(), "resolved_at": None}
        self.gaps.setdefault((surface, object_id or "", start), row)

    def finish(self, status: str = "complete", note: str | None = None) -> None:
        self.run |= {"finished_at": self.clock(), "status": status, "note": note}

    def flush(self, spark: SparkSession, base: str) -> None:
        """Appends what is held to the tables below base; keys that are there already are left alone."""
        for name, rows in (("collector_runs", [self.run]), ("raw_responses", self.responses), ("collector_gaps", list(self.gaps.values())), ("backfill_windows", list(self.windows.values()))):
            if rows:
                schema = schemas.schema(name)
                value = lambda r, f: float(r[f.name]) if f.dataType.typeName() == "double" and r.get(f.name) is not None else r.get(f.name)
                schemas.append(spark, base, name, spark.createDataFrame([tuple(value(r, f) for f in schema) for r in rows], schema))
        self.responses, self.gaps, self.windows = [], {}, {}


@dataclass
class Client:
    """Asks a transport, and asks again with growing pauses after errors of the transport or the server."""

    ledger: Ledger
    transport: Transport
    base: str = ""
    tries: int = 4
    pause: float = 0.5
    sleep: Callable[[float], None] = time.sleep

    def get(self, endpoint: str, parameters: dict | None = None) -> tuple[int, Any]:
        """(raw_response_id of the last attempt, decoded body or None); each attempt is kept."""
        parameters, number = dict(parameters or {}), -1
        for attempt in range(self.tries):
            if attempt:
                self.sleep(self.pause * 2 ** (attempt - 1))
            asked = self.ledger.clock()
            try:
                status, headers, body = self.transport(f"{self.base.rstrip('/')}/{endpoint.lstrip('/')}", parameters)
            except OSError as e:
                number = self.ledger.response(self.base, endpoint, parameters, asked, None, {}, canonical({"error": type(e).__name__, "detail": str(e)}).encode(), str(e))
                continue
            number = self.ledger.response(self.base, endpoint, parameters, asked, status, headers, body, None if status < 400 else f"http {status}")
            if status < 500:
                return number, _decoded(body) if status < 400 else None
        return number, None


def _decoded(body: bytes) -> Any:
    try:
        return json.loads(body)
    except ValueError:
        return None


def records_of(body: Any) -> list | None:
    """The records of a decoded body: a list, the list under "data", or the one object; None for no body."""
    if isinstance(body, dict):
        body = body.get("data", body)
    return body if body is None or isinstance(body, list) else [body]


@dataclass
class Walk:
    """What a walk over pages saw: complete, incomplete (with where to go on) or failed."""

    pages: list[tuple[int, list, dict]] = field(default_factory=list)
    status: str = "complete"
    note: str = ""
    resume: dict = field(default_factory=dict)

    @property
    def records(self) -> list:
        return [r for _, page, _ in self.pages for r in page]


def _walk(fetch: Callable[[dict], tuple[int, list | None]], base: dict | None, state: Any, named: Callable[[Any], dict], mark: Callable[[list, Any], Any], after: Callable[[list, Any], Any], most: int, what: str) -> Walk:
    """Pages from state on. after gives the next state, or None at the end; mark tells pages apart: one seen twice ends the walk
    as incomplete, since the interface is going round in a circle."""
    walk, seen = Walk(), set()
    for _ in range(most):
        parameters = dict(base or {}) | named(state)
        number, page = fetch(parameters)
        if page is None:
            walk.status, walk.note, walk.resume = "failed", f"no answer at {what} {state}", {what: state}
            return walk
        sign = mark(page, state)
        if sign is not None and sign in seen:
            walk.status, walk.note, walk.resume = "incomplete", f"{what} {state}: a page came twice", {what: state}
            return walk
        seen.add(sign)
        walk.pages.append((number, page, parameters))
        state = after(page, state)
        if state is None:
            return walk
    walk.status, walk.note, walk.resume = "incomplete", f"stopped after {most} pages", {what: state}
    return walk


def by_offset(fetch: Callable[[dict], tuple[int, list | None]], base: dict | None = None, size: int = 100, most: int = 1000, start: int = 0, enough: Callable[[list], bool] | None = None) -> Walk:
    """Pages of size records by offset, to the first short one; enough ends the walk after a page that has been kept."""
    done = lambda page: len(page) < size or (enough is not None and enough(page))
    digest = lambda page, _: hashlib.sha256(canonical(page).encode()).digest() if page else None
    return _walk(fetch, base, start, lambda o: {"limit": size, "offset": o}, digest, lambda page, o: None if done(page) else o + size, most, "offset")


def by_cursor(fetch: Callable[[dict], tuple[int, list | None]], following: Callable[[list], str | None], base: dict | None = None, name: str = "next_cursor", most: int = 1000, start: str | None = None) -> Walk:
    """Pages by the cursor that each one gives for the next; a cursor that comes again ends the walk as incomplete."""
    return _walk(fetch, base, start, lambda c: {} if c is None else {name: c}, lambda _, c: ("cursor", c), lambda page, _: following(page), most, "cursor")


#: Fixed names of the surfaces: endpoint, the parameter that names the object, and fixed parameters.
SURFACES = {
    "trades_taker": ("trades", "market", {"takerOnly": "true"}),
    "trades": ("trades", "market", {"takerOnly": "false"}),
    "markets": ("markets", "condition_ids", {}),
    "market_status": ("markets", "condition_ids", {}),
    "positions": ("positions", "user", {}),
    "activity": ("activity", "user", {}),
    "books": ("book", "token_id", {}),
}


def collect(client: Client, surface: str, object_id: str, since: float | None = None, size: int = 100, most: int = 1000) -> Walk:
    """Everything of an object on a surface; books are one object, the rest pages. Trades come newest first, so a walk since a
    time ends with the page that reaches it, which is kept."""
    endpoint, name, fixed = SURFACES[surface]

    def fetch(parameters: dict) -> tuple[int, list | None]:
        number, body = client.get(endpoint, parameters)
        return number, records_of(body)

    base = {name: object_id} | fixed
    if surface == "books":
        number, page = fetch(base)
        return Walk([(number, page, base)]) if page is not None else Walk(status="failed", note="no answer", resume={"object": object_id})
    reached = None
    if since is not None and endpoint == "trades":
        reached = lambda page: any(float(r.get("timestamp", 0)) < since for r in page if isinstance(r, dict))
    return by_offset(fetch, base, size, most, enough=reached)


def plan_windows(start: float, end: float, width: float, overlap: float) -> Iterator[tuple[float, float]]:
    """Half-open windows from the end backwards; each reaches overlap further back than its own width."""
    at = end
    while at > start:
        yield max(start, at - width - overlap), at
        at -= width


def run_backfill(ledger: Ledger, object_id: str, windows: list[tuple[float, float]], fetch: Callable[[float, float], Walk], done: set[tuple[float, float]] = frozenset()) -> dict[tuple[float, float], str]:
    """Fetches the windows that aren't done. A window is complete only if its walk is and all its times lie in [start, end);
    else it's incomplete and a gap says so."""
    out = {}
    for start, end in windows:
        if (start, end) in done:
            continue
        walk = fetch(start, end)
        times = [float(r["timestamp"]) for r in walk.records if isinstance(r, dict) and r.get("timestamp") is not None]
        inside = all(start <= t < end for t in times)
        status = "complete" if walk.status == "complete" and inside else "incomplete"
        note = walk.note or ("" if inside else "times outside the window")
        ledger.windows[(object_id, start, end)] = {"collector": ledger.collector, "object_id": object_id, "window_start": start, "window_end": end, "page_count": len(walk.pages), "record_count": len(walk.records), "status": status, "observed_min_ts": min(times, default=None), "observed_max_ts": max(times, default=None), "note": note or None}
        if status != "complete":
            ledger.gap("backfill", object_id, start, end, note or "incomplete")
        out[(start, end)] = status
    return out


def pending_windows(stored: DataFrame, windows: DataFrame) -> DataFrame:
    """The windows (object_id, window_start, window_end) that no complete row of backfill_windows covers."""
    return windows.join(stored.where("status = 'complete'"), ["object_id", "window_start", "window_end"], "left_anti")


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """url, headline, published_at (epoch seconds), source and body of the items of RSS files; items without a title or a
    readable date are left out."""
    rows = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string, source string, description string").load(path)
    at = F.unix_seconds(F.coalesce(F.try_to_timestamp(F.regexp_replace("pubDate", r"^\w{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(F.regexp_replace("pubDate", r"^\w{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp("pubDate"))).cast("double")
    rows = rows.select(F.col("link").alias("url"), F.trim("title").alias("headline"), at.alias("published_at"), "source", F.trim(F.regexp_replace(F.regexp_replace("description", r"<[^>]*>", " "), r"\s+", " ")).alias("body"))
    return rows.where("headline != '' and published_at is not null")


@dataclass
class Loop:
    """Cycles over surfaces, each of its own: what fails leaves a gap for its window and the others go on."""

    ledger: Ledger
    surfaces: dict[str, tuple[Callable[[float, float], str], str | None]]
    objects: list[str]
    every: float = 300.0
    last: float | None = None
    cycles: int = 0
    failures: dict[str, int] = field(default_factory=dict)
    stopped: bool = False

    def downtime(self, now: float, seen: float | None) -> int:
        """A gap for each object if nothing was received for two cadences and more."""
        if seen is None or now - seen <= 2 * self.every:
            return 0
        for x in self.objects:
            self.ledger.gap("loop", x, seen, now, "collector was down")
        return len(self.objects)

    def cycle(self, now: float) -> dict[str, str]:
        window, report = (self.last if self.last is not None else now - self.every, now), {}
        for name, (collect_, gap) in self.surfaces.items():
            try:
                report[name] = collect_(*window)
            except Exception as e:  # noqa: BLE001 - a surface must not end the cycle
                report[name] = f"failed: {e}"
                self.failures[name] = self.failures.get(name, 0) + 1
                for x in self.objects if gap else ():
                    self.ledger.gap(gap, x, *window, f"{name} failed: {e}")
        self.last, self.cycles = now, self.cycles + 1
        return report

    def run(self, most: int | None = None, seconds: float | None = None, sleep: Callable[[float], None] = time.sleep, seen: float | None = None, told: Callable[[int, dict], None] | None = None) -> None:
        """Until so many cycles or seconds are over, or stopped is set (a signal handler may)."""
        clock = self.ledger.clock
        began = clock()
        self.downtime(began, seen)
        while not self.stopped:
            start = clock()
            report = self.cycle(start)
            if told:
                told(self.cycles, report)
            if (most is not None and self.cycles >= most) or (seconds is not None and clock() - began >= seconds):
                break
            sleep(max(0.0, self.every - (clock() - start)))
