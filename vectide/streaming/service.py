"""An HTTP front to the live micro-batches.

``POST /rag`` with ``{"query": ..., "k": 2}`` answers ``{"query", "result"}``;
``GET /performance`` gives the running counters. Requests wait in a queue. A batch
opens with its first request and closes with ``size`` of them or ``wait`` seconds
later; it is written as one file of the stream's source, so what was accepted
survives the front. ``microbatch.serve`` answers the files; answers go to the sink
and from there to the clients that wait.

Defined results: a body that is no JSON object, a missing or empty query and a k
that is no positive whole number get status 422; an answer that isn't there after
``timeout`` seconds is status 504, and counts as a timeout. ``stop`` takes no more
requests, answers those accepted, then ends.
"""

from __future__ import annotations

import itertools
import json
import queue
import threading
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession

from vectide.operators.rag import DEFAULT_K
from vectide.sources.files import opened
from vectide.sources.tables import shared_dir
from vectide.streaming import microbatch

SCHEMA = "request_id long, ts timestamp, query string, k int"


class _Waiting:
    def __init__(self, query: str, k: int):
        self.query, self.k, self.ts = query, k, datetime.now(timezone.utc)
        self.done = threading.Event()
        self.result: str | None = None


class Service:
    """``handle`` answers requests as ``microbatch.serve`` says; ``folder`` is shared
    by driver and executors (by default below the shared folder)."""

    def __init__(self, spark: SparkSession, handle: Callable[[DataFrame], DataFrame], folder: str | None = None, size: int = microbatch.SIZE, wait: float = microbatch.WAIT, timeout: float = 30.0, trigger: str = "50 milliseconds", host: str = "127.0.0.1", port: int = 0):
        self.spark, self.size, self.wait, self.timeout = spark, size, wait, timeout
        self.folder = folder or f"{shared_dir(spark)}/service-{uuid.uuid4().hex}"
        self.counts = {"total_requests": 0, "total_batches": 0, "batched": 0, "max_batch": 0, "timeouts": 0, "answered": 0}
        self._lock = threading.Lock()
        self._numbers = itertools.count(time.time_ns() // 1000)
        self._queue: queue.Queue[_Waiting | None] = queue.Queue()
        self._waiting: dict[int, _Waiting] = {}
        system, place = opened(f"{self.folder}/requests")
        system.create_dir(place, recursive=True)
        stream = spark.readStream.schema(SCHEMA).json(f"{self.folder}/requests")
        self.query = microbatch.serve(stream, handle, f"{self.folder}/answers", f"{self.folder}/state", trigger, timeout=timeout, size=size, done=self._deliver)
        self._batcher = threading.Thread(target=self._batch, daemon=True)
        self._batcher.start()
        self.server = ThreadingHTTPServer((host, port), _handler(self))
        self.server.daemon_threads = True
        self.address = f"http://{host}:{self.server.server_address[1]}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def ask(self, query: str, k: int) -> str | None:
        """The result, or None if there is none in time."""
        mine = _Waiting(query, k)
        with self._lock:
            self.counts["total_requests"] += 1
        self._queue.put(mine)
        mine.done.wait(self.timeout)
        with self._lock:
            self.counts["timeouts" if mine.result is None else "answered"] += 1
        return mine.result

    def performance(self) -> dict[str, float]:
        with self._lock:
            return self.counts | {"avg_batch": self.counts["batched"] / max(1, self.counts["total_batches"])}

    def stop(self) -> None:
        self.server.shutdown()
        self.server.server_close()
        self._queue.put(None)
        self._batcher.join()
        self.query.processAllAvailable()
        self.query.stop()

    def _batch(self) -> None:
        ended = False
        while not ended:
            first = self._queue.get()
            if first is None:
                return
            held, closes = [first], time.monotonic() + self.wait
            while len(held) < self.size and (left := closes - time.monotonic()) > 0:
                try:
                    more = self._queue.get(timeout=left)
                except queue.Empty:
                    break
                if more is None:
                    ended = True
                    break
                held.append(more)
            self._write(held)

    def _write(self, held: list[_Waiting]) -> None:
        lines = []
        with self._lock:
            for one in held:
                number = next(self._numbers)
                self._waiting[number] = one
                lines.append(json.dumps({"request_id": number, "ts": one.ts.isoformat(), "query": one.query, "k": one.k}))
            self.counts["total_batches"] += 1
            self.counts["batched"] += len(held)
            self.counts["max_batch"] = max(self.counts["max_batch"], len(held))
        system, place = opened(f"{self.folder}/requests")
        name = uuid.uuid4().hex
        with system.open_output_stream(f"{place}/_{name}") as out:
            out.write(("\n".join(lines) + "\n").encode())
        system.move(f"{place}/_{name}", f"{place}/{name}.json")

    def _deliver(self, answers: DataFrame) -> None:
        for r in answers.select("request_id", "result").toLocalIterator():
            with self._lock:
                one = self._waiting.pop(r["request_id"], None)
            if one is not None:
                one.result = r["result"]
                one.done.set()


def _handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            if self.path == "/performance":
                self._send(200, service.performance())
            else:
                self._send(404, {"error": "not found"})

        def do_POST(self) -> None:  # noqa: N802
            length = self.headers.get("Content-Length", "0")
            body = self.rfile.read(int(length) if length.isdigit() else 0)
            if self.path != "/rag":
                return self._send(404, {"error": "not found"})
            try:
                asked = json.loads(body)
                query, k = asked["query"], asked.get("k", DEFAULT_K)
                good = isinstance(query, str) and query and type(k) is int and 0 < k < 1 << 31
            except (ValueError, KeyError, TypeError, AttributeError):
                good = False
            if not good:
                return self._send(422, {"error": "a request needs a query, and k must be positive"})
            result = service.ask(query, k)
            return self._send(504, {"error": "timeout"}) if result is None else self._send(200, {"query": query, "result": result})

        def log_message(self, *args) -> None:
            pass

    return Handler
