"""A small HTTP surface over a review sample: state, records, annotations, export.

The sample is what one person reads (JSON lines, a few hundred rows), so it is held by the server; every
annotation rewrites the file as a whole beside the old one and then takes its place.
"""

from __future__ import annotations

import json
import os
import tempfile
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from pyspark.sql import DataFrame


def export_sample(sample: DataFrame, path: str, texts: DataFrame | None = None, key: str = "id_registro", text: str = "text",
    most: int = 10_000) -> int:
    """Write a sample as JSON lines for the server, with the full text of its cases; only their texts are read."""
    if texts is not None:
        wanted = texts.join(sample.select(key).distinct(), key, "left_semi").select(key, text)
        sample = sample.join(wanted, key, "left")
    rows = sample.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a review sample has at most {most} rows")
    write_lines(Path(path), [json.loads(json.dumps(r.asDict(True), default=str)) for r in rows])
    return len(rows)


def write_lines(path: Path, records: list[dict]) -> None:
    """All records as JSON lines, at once: readers see the old file or the new one."""
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=path.name)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.writelines(json.dumps(r, ensure_ascii=False, allow_nan=False) + "\n" for r in map(finite, records))
    os.replace(name, path)


def read_lines(path: Path) -> list[dict]:
    """Records of a JSON lines file; blank and malformed lines are left out, so is a missing file."""
    out = []
    for line in path.read_text(encoding="utf-8").splitlines() if path.exists() else ():
        try:
            r = json.loads(line)
        except ValueError:
            continue
        if isinstance(r, dict):
            out.append(r)
    return out


def finite(x):
    """NaN and infinities as null, inside lists and objects too."""
    if isinstance(x, float):
        return x if x - x == 0 else None
    if isinstance(x, dict):
        return {k: finite(v) for k, v in x.items()}
    return [finite(v) for v in x] if isinstance(x, list) else x


class ReviewStore:
    """Records of a sample with their annotations; those of an earlier session are taken over by (variable, key)."""

    FIELDS = ("human_label", "human_note", "confidence", "time_spent_s")

    def __init__(self, sample: str, key: str = "id_registro", legend: dict[str, str] | None = None):
        self.key, self.legend, self.lock = key, legend or {}, threading.Lock()
        self.target = Path(sample).with_suffix(".annotated.jsonl")
        old = {self._id(r): r for r in read_lines(self.target)}
        self.records = [r | {k: old[self._id(r)].get(k) for k in self.FIELDS} if self._id(r) in old else r for r in read_lines(Path(sample))]

    def _id(self, r: dict) -> tuple:
        return r.get("variable"), r.get(self.key)

    def record(self, i: int) -> dict:
        if not 0 <= i < len(self.records):
            raise IndexError(i)
        r = self.records[i]
        return r | {"index": i, "legend": self.legend.get(r.get("variable"))}

    def state(self) -> dict:
        open_ = [i for i, r in enumerate(self.records) if not r.get("human_label")]
        return {"total": len(self.records), "done": len(self.records) - len(open_), "first_pending": open_[0] if open_ else None}

    def annotate(self, i: int, label: str | None, note: str | None = None, confidence: str = "high",
        seconds: float = 0.0) -> dict:
        """Set a record's label; None clears it."""
        with self.lock:
            self.record(i)
            values = (label, note, confidence, seconds) if label else (None,) * 4
            self.records[i] = self.records[i] | dict(zip(self.FIELDS, values))
            write_lines(self.target, self.records)
        return self.record(i)


def handler(store: ReviewStore, page: str = "<!doctype html><title>review</title>"):
    """Request handler: GET /, /api/state, /api/record/<i>, /api/export; POST /api/annotate, /api/clear."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def _send(self, code: int, body, kind: str = "application/json"):
            data = body.encode() if isinstance(body, str) else json.dumps(finite(body), ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            if self.path == "/":
                return self._send(200, page, "text/html")
            if self.path == "/api/state":
                return self._send(200, store.state())
            if self.path == "/api/export":
                return self._send(200, store.records)
            if self.path.startswith("/api/record/"):
                return self._try(lambda: store.record(int(self.path.rsplit("/", 1)[1])))
            return self._send(404, {"error": "not found"})

        def do_POST(self):
            try:
                d = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError:
                return self._send(400, {"error": "bad JSON"})
            if self.path == "/api/annotate":
                return self._try(lambda: store.annotate(int(d["index"]), str(d["human_label"]), d.get("human_note"),
                        d.get("confidence", "high"), float(d.get("time_spent_s", 0))))
            if self.path == "/api/clear":
                return self._try(lambda: store.annotate(int(d["index"]), None))
            return self._send(404, {"error": "not found"})

        def _try(self, f):
            try:
                return self._send(200, f())
            except IndexError:
                return self._send(404, {"error": "no such record"})
            except (KeyError, TypeError, ValueError) as e:
                return self._send(400, {"error": f"bad request: {e}"})

    return Handler


def serve(store: ReviewStore, port: int = 8765) -> tuple[ThreadingHTTPServer, threading.Thread]:
    """A server on this machine only, in a thread of its own; port 0 takes a free one."""
    server = ThreadingHTTPServer(("127.0.0.1", port), handler(store))
    t = threading.Thread(target=server.serve_forever, daemon=True)
    t.start()
    return server, t
