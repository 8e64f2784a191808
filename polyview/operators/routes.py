"""The query service over HTTP: four routes of JSON on Python's own server; the work stays in ``Service``."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from polyview.operators.service import Refused, Service

#: Fixed values, the wire contract: fields of each request with their types; those of the first set must be given.
FIELDS = {
    "/query": ({"text": (str,)}, {"path": (str, type(None)), "raw": (bool,), "pool": (str, type(None)), "top": (int,), "min_score": (int, float, type(None)), "cap": (int,)}),
    "/similar": ({"path": (str,)}, {"scope": (str, type(None)), "k": (int,), "pool": (str, type(None))}),
    "/reload": ({}, {"rescan": (bool,)}),
}


def arguments(route: str, body: object) -> dict:
    """The known fields of a request; one that lacks, or has another type, is refused."""
    if not isinstance(body, dict):
        raise Refused(422, "a request is a JSON object")
    must, may = FIELDS[route]
    for name in must:
        if name not in body:
            raise Refused(422, f"{name} is missing")
    out = {k: v for k, v in body.items() if k in must or k in may}
    for name, value in out.items():
        kinds = (must | may)[name]
        if not isinstance(value, kinds) or (isinstance(value, bool) and bool not in kinds):
            raise Refused(422, f"{name} has the wrong type")
    return out


def serve(service: Service, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that is not yet running: GET /status, POST /query, /similar and /reload.  Each request has a thread of its own."""
    routes: dict[str, Callable[..., dict]] = {"/query": service.query, "/similar": service.similar, "/reload": service.reload}

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            path = self.path.split("?")[0]
            if path == "/status":
                self.answer(200, service.status())
            else:
                self.answer(405 if path in routes else 404, {"detail": "Method Not Allowed" if path in routes else "Not Found"})

        def do_POST(self) -> None:
            path = self.path.split("?")[0]
            try:
                raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                if path not in routes:
                    raise Refused(405 if path == "/status" else 404, "Method Not Allowed" if path == "/status" else "Not Found")
                try:
                    body = json.loads(raw or b"{}")
                except ValueError as e:
                    raise Refused(422, f"the body is no JSON: {e}") from e
                self.answer(200, routes[path](**arguments(path, body)))
            except Refused as e:
                # a server that cannot answer says so in the words of its status
                detail = {"ready": False, "failure": service.status()["failure"]} if e.status == 503 else {"reloaded": False, "ready": True, "failure": str(e)} if e.status == 409 else str(e)
                self.answer(e.status, {"detail": detail})
            except Exception as e:
                self.answer(500, {"detail": type(e).__name__})

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
