"""REST, server-sent events and the agent protocol over one search, with the standard library's server.

POST /query, GET /query/stream, GET /.well-known/agent-card.json, POST / (JSON-RPC). Requests run in threads of their
own; the Spark session is shared. For one trusted network: there is no authentication here.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from lectern.plans.deep_search import query_response, sse
from lectern.serve.agent import CARD_PATH, PARSE_ERROR, Agent, agent_card

MAX_BODY = 1 << 20


class BadRequest(Exception):
    pass


def read_query(data: object) -> tuple[str, list[int] | None]:
    """question and document_ids (none for an empty list) of a request's body."""
    if not isinstance(data, dict) or not isinstance(data.get("question"), str) or not data["question"].strip():
        raise BadRequest("question must be a text that is not blank")
    ids = data.get("document_ids")
    if ids is not None and not (isinstance(ids, list) and all(isinstance(i, int) and not isinstance(i, bool) for i in ids)):
        raise BadRequest("document_ids must be a list of integers")
    return data["question"], ids or None


def read_query_string(query: str) -> tuple[str, list[int] | None]:
    given = parse_qs(query)
    try:
        ids = [int(i) for i in given.get("document_ids", [])]
    except ValueError:
        raise BadRequest("document_ids must be integers") from None
    return read_query({"question": given.get("question", [None])[0], "document_ids": ids})


def handler(search, card_url: str | None = None) -> type[BaseHTTPRequestHandler]:
    """A request handler over search, which has run(question, ids) and stream(question, ids)."""
    agent = Agent(search)

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def _json(self, status: int, body: object) -> None:
            raw = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def _stream(self, frames: Iterator[str]) -> None:
            """Frames as they come; the connection's end is the stream's."""
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream; charset=utf-8")
            self.send_header("Cache-Control", "no-store")
            self.send_header("Connection", "close")
            self.end_headers()
            try:
                for frame in frames:
                    self.wfile.write(frame.encode())
                    self.wfile.flush()
            except (BrokenPipeError, ConnectionResetError):  # the reader left; the search stops with its generator
                pass
            self.close_connection = True

        def _body(self) -> object:
            length = int(self.headers.get("Content-Length") or 0)
            if length > MAX_BODY:
                raise BadRequest("the body is too long")
            return json.loads(self.rfile.read(length))

        def do_GET(self) -> None:
            at = urlsplit(self.path)
            if at.path == CARD_PATH:
                return self._json(200, agent_card(card_url or f"http://{self.headers.get('Host', 'localhost')}/"))
            if at.path != "/query/stream":
                return self._json(404, {"detail": "not found"})
            try:
                question, ids = read_query_string(at.query)
            except BadRequest as e:
                return self._json(422, {"detail": str(e)})
            return self._stream(sse(search.stream(question, ids)))

        def do_POST(self) -> None:
            path = urlsplit(self.path).path
            if path not in ("/", "/query"):
                return self._json(404, {"detail": "not found"})
            try:
                data = self._body()
                if path == "/":
                    return self._rpc(data)
                question, ids = read_query(data)
            except BadRequest as e:
                return self._json(422, {"detail": str(e)})
            except ValueError as e:
                return self._json(200, {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": str(e)}}) if path == "/" else self._json(422, {"detail": str(e)})
            try:
                status, body = query_response(search, question, ids)
            except Exception as e:
                status, body = 500, {"detail": str(e)}
            return self._json(status, body)

        def _rpc(self, data: object) -> None:
            answers = agent.answer(data)
            if isinstance(data, dict) and data.get("method") == "message/stream":
                return self._stream(f"data: {json.dumps(a, ensure_ascii=False, default=str)}\n\n" for a in answers)
            return self._json(200, next(answers))

    return Handler


def server(search, host: str = "127.0.0.1", port: int = 8000, card_url: str | None = None) -> ThreadingHTTPServer:
    """A server that is not running yet: call serve_forever(). Port 0 takes a free one."""
    made = ThreadingHTTPServer((host, port), handler(search, card_url))
    made.daemon_threads = True
    return made
