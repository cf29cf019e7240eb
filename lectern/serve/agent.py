"""The agent protocol (JSON-RPC 2.0) over the same events: a card, tasks with a life cycle, an answer as artifact."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator

from lectern.plans.contracts import Event

#: Names and codes of the public protocol, and the size of a frame of text.
ARTIFACT, FRAME_CHARS, CARD_PATH = "answer", 200, "/.well-known/agent-card.json"
FINAL_STATES = ("completed", "failed")
PARSE_ERROR, INVALID_REQUEST, NO_METHOD, BAD_PARAMS, INTERNAL_ERROR, NO_TASK, NOT_CANCELABLE = -32700, -32600, -32601, -32602, -32603, -32001, -32002


class RpcError(Exception):
    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


def agent_card(url: str) -> dict:
    skill = {"id": "deep-search", "name": "Ask the books", "description": "Takes a question in plain words; the reply names the chapters it rests on.", "tags": ["books", "answers"]}
    return {
        "protocolVersion": "0.3.0", "name": "lectern", "description": "A reader of stored books that answers what it is asked.", "version": "0.1.0", "url": url, "preferredTransport": "JSONRPC",
        "capabilities": {"streaming": True}, "defaultInputModes": ["text/plain"], "defaultOutputModes": ["text/plain"], "skills": [skill],
    }


def question_of(params: dict) -> str:
    """The text parts of the message, a line each."""
    message = params.get("message") if isinstance(params, dict) else None
    parts = message.get("parts") if isinstance(message, dict) else None
    texts = [p["text"] for p in parts if isinstance(p, dict) and isinstance(p.get("text"), str)] if isinstance(parts, list) else []
    if not "".join(texts).strip():
        raise RpcError(BAD_PARAMS, "the message has no text")
    return "\n".join(texts)


def _text(text: str) -> list[dict]:
    return [{"kind": "text", "text": text}]


class Agent:
    """Tasks of one process, the latest max_tasks of them. search: anything with stream(question) -> events.

    If search also has cancel(tag), a task's id is the tag of its question's jobs, and a task that is cancelled, or whose
    reader leaves, ends them.
    """

    def __init__(self, search, max_tasks: int = 10_000) -> None:
        self.search, self.max_tasks, self.tasks, self.lock = search, max_tasks, {}, threading.Lock()

    def _open(self, params: dict) -> dict:
        context = params["message"].get("contextId") or str(uuid.uuid4())
        task = {"kind": "task", "id": str(uuid.uuid4()), "contextId": context, "status": {"state": "submitted"}, "artifacts": [], "history": [params["message"]]}
        with self.lock:
            self.tasks[task["id"]] = task
            while len(self.tasks) > self.max_tasks:
                self.tasks.pop(next(iter(self.tasks)))
        return task

    def _to(self, task: dict, state: str, text: str | None = None) -> dict:
        """The task moved to a state, unless it has ended, and the update that tells so."""
        status: dict = {"state": state}
        if text is not None:
            status["message"] = {"kind": "message", "role": "agent", "messageId": str(uuid.uuid4()), "taskId": task["id"], "contextId": task["contextId"], "parts": _text(text)}
        with self.lock:
            if task["status"]["state"] in FINAL_STATES:
                status = task["status"]
            task["status"] = status
        return {"kind": "status-update", "taskId": task["id"], "contextId": task["contextId"], "status": status, "final": status["state"] in FINAL_STATES}

    def _events(self, task: dict, question: str) -> Iterator[Event]:
        return self.search.stream(question, tag=task["id"]) if hasattr(self.search, "cancel") else self.search.stream(question)

    def _end_jobs(self, task: dict) -> None:
        if hasattr(self.search, "cancel"):
            self.search.cancel(task["id"])

    def updates(self, task: dict, events: Iterator[Event]) -> Iterator[dict]:
        """working, text in frames of FRAME_CHARS or more, what is left, the answer as artifact, completed; or failed. A cancelled task stops at its next event, or when its jobs end."""
        yield self._to(task, "working")
        answer, held = "", ""
        try:
            for event in events:
                if task["status"]["state"] in FINAL_STATES:
                    yield self._to(task, "failed")
                    return
                if event.type == "answer_delta":
                    held += event.body["text"]
                    if len(held) >= FRAME_CHARS:
                        yield self._to(task, "working", held)
                        held = ""
                elif event.type == "final":
                    answer = event.body["answer"]
        except Exception as e:
            yield self._to(task, "failed", str(e))
            return
        if held:
            yield self._to(task, "working", held)
        artifact = {"artifactId": str(uuid.uuid4()), "name": ARTIFACT, "parts": _text(answer)}
        with self.lock:
            task["artifacts"].append(artifact)
        yield {"kind": "artifact-update", "taskId": task["id"], "contextId": task["contextId"], "artifact": artifact}
        yield self._to(task, "completed")

    def _known(self, params: dict) -> dict:
        task = self.tasks.get(params.get("id")) if isinstance(params, dict) else None
        if task is None:
            raise RpcError(NO_TASK, "no such task")
        return task

    def _results(self, method: str, params: dict) -> Iterator[dict]:
        if method in ("message/send", "message/stream"):
            question = question_of(params)
            task = self._open(params)
            if method == "message/stream":
                yield {**task, "artifacts": []}
            events = self._events(task, question)
            try:
                for update in self.updates(task, events):
                    if method == "message/stream":
                        yield update
            except GeneratorExit:  # the reader has left
                self._to(task, "failed", "the reader left")
                self._end_jobs(task)
                raise
            finally:
                getattr(events, "close", lambda: None)()
            if method == "message/send":
                yield task
        elif method == "tasks/get":
            yield self._known(params)
        elif method == "tasks/cancel":
            task = self._known(params)
            if task["status"]["state"] in FINAL_STATES:
                raise RpcError(NOT_CANCELABLE, "the task has ended")
            self._to(task, "failed", "cancelled")
            self._end_jobs(task)
            yield task
        else:
            raise RpcError(NO_METHOD, f"no method {method!r}")

    def answer(self, request: object) -> Iterator[dict]:
        """The responses to one request: several for message/stream, else one."""
        fine = isinstance(request, dict) and request.get("jsonrpc") == "2.0" and isinstance(request.get("method"), str)
        own = {"jsonrpc": "2.0", "id": request.get("id") if isinstance(request, dict) else None}
        try:
            if not fine:
                raise RpcError(INVALID_REQUEST, "not a JSON-RPC 2.0 request")
            for result in self._results(request["method"], request.get("params") or {}):
                yield {**own, "result": result}
        except RpcError as e:
            yield {**own, "error": {"code": e.code, "message": str(e)}}
        except Exception as e:
            yield {**own, "error": {"code": INTERNAL_ERROR, "message": str(e)}}
