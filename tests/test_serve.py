import json
import threading
import urllib.error
import urllib.request

import pytest

from lectern.plans.contracts import Event
from lectern.serve import agent, cli, http
from tests.test_plans import searcher

RESULT = {"answer": "x" * 450, "citations": ["B › 1"], "chunks": [{"chunk_id": 1, "source": "B › 1", "score": 0.1, "content": "a  b"}, {"chunk_id": 2, "source": "B › 2", "score": 0.2, "content": "c" * 400}], "iterations": 1}


class Fake:
    """A search of fixed events; asked: what it was called with."""

    def __init__(self, found=True, fail=None):
        self.found, self.fail, self.asked = found, fail, []

    def stream(self, question, document_ids=None):
        self.asked.append((question, document_ids))
        yield Event("plan_ready", {})
        for _ in range(9):
            yield Event("answer_delta", {"text": "x" * 50})
        if self.fail:
            raise self.fail
        yield Event("final", RESULT)

    def run(self, question, document_ids=None):
        list(self.stream(question, document_ids))
        return RESULT if self.found else None


@pytest.fixture
def serve():
    running = []

    def start(search):
        made = http.server(search, port=0)
        threading.Thread(target=made.serve_forever, daemon=True).start()
        running.append(made)
        return f"http://127.0.0.1:{made.server_address[1]}"

    yield start
    for made in running:
        made.shutdown()
        made.server_close()


def call(url, data=None):
    body = data if data is None or isinstance(data, bytes) else json.dumps(data).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body), timeout=60) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode()


def test_query_and_its_failures(serve):
    fake = Fake()
    at = serve(fake)
    assert call(at + "/query", {"question": "q", "document_ids": []}) == (200, json.dumps(RESULT, ensure_ascii=False))
    assert call(at + "/query", {"question": "q", "document_ids": [3]})[0] == 200 and fake.asked == [("q", None), ("q", [3])]
    for bad in ({"question": " "}, {"question": 1}, [], {"question": "q", "document_ids": ["x"]}, b"{"):
        assert call(at + "/query", bad)[0] == 422
    assert call(at + "/other", {})[0] == 404 and call(at + "/other")[0] == 404
    assert call(serve(Fake(found=False)) + "/query", {"question": "q"})[0] == 502
    assert call(serve(Fake(fail=RuntimeError("down"))) + "/query", {"question": "q"}) == (500, '{"detail": "down"}')


def test_events_as_they_come(serve):
    fake = Fake()
    at = serve(fake)
    status, body = call(at + "/query/stream?question=what%3F&document_ids=1&document_ids=2")
    frames = body.strip().split("\n\n")
    assert status == 200 and fake.asked == [("what?", [1, 2])] and len(frames) == 11
    assert frames[0].startswith("event: plan_ready\ndata: ") and frames[-1].startswith("event: final\n")
    assert call(at + "/query/stream")[0] == 422 and call(at + "/query/stream?question=q&document_ids=x")[0] == 422


def message(method, text="q", **more):
    return {"jsonrpc": "2.0", "id": 7, "method": method, "params": {"message": {"role": "user", "parts": [{"kind": "text", "text": text}], **more}}}


def test_agent_over_http(serve):
    at = serve(Fake())
    card = json.loads(call(at + agent.CARD_PATH)[1])
    assert card["capabilities"]["streaming"] and card["skills"][0]["id"] == "deep-search" and card["url"] == at + "/"
    task = json.loads(call(at + "/", message("message/send"))[1])["result"]
    assert task["status"]["state"] == "completed" and task["artifacts"][0]["parts"][0]["text"] == RESULT["answer"] and task["artifacts"][0]["name"] == "answer"
    assert json.loads(call(at + "/", {"jsonrpc": "2.0", "id": 1, "method": "tasks/get", "params": {"id": task["id"]}})[1])["result"] == task
    told = [json.loads(f[6:])["result"] for f in call(at + "/", message("message/stream", contextId="c"))[1].strip().split("\n\n")]
    assert [t.get("status", {}).get("state", t["kind"]) for t in told] == ["submitted", "working", "working", "working", "working", "artifact-update", "completed"]
    assert [len(t["status"]["message"]["parts"][0]["text"]) for t in told[2:5]] == [200, 200, 50] and all(t["contextId"] == "c" for t in told) and told[-1]["final"]
    for bad, code in ((b"{", agent.PARSE_ERROR), ({"id": 1}, agent.INVALID_REQUEST), (message("other"), agent.NO_METHOD), (message("message/send", " "), agent.BAD_PARAMS)):
        assert json.loads(call(at + "/", bad)[1])["error"]["code"] == code
    for method, given, code in (("tasks/get", "none", agent.NO_TASK), ("tasks/cancel", task["id"], agent.NOT_CANCELABLE)):
        assert json.loads(call(at + "/", {"jsonrpc": "2.0", "id": 1, "method": method, "params": {"id": given}})[1])["error"]["code"] == code


def test_tasks_fail_and_are_cancelled():
    failed = list(agent.Agent(Fake(fail=RuntimeError("down"))).answer(message("message/send")))[0]["result"]
    assert failed["status"]["state"] == "failed" and failed["status"]["message"]["parts"][0]["text"] == "down" and not failed["artifacts"]
    own = agent.Agent(Fake(), max_tasks=1)
    running = own.answer(message("message/stream"))
    task = next(running)["result"]
    assert next(running)["result"]["status"]["state"] == "working"
    assert list(own.answer({"jsonrpc": "2.0", "id": 2, "method": "tasks/cancel", "params": {"id": task["id"]}}))[0]["result"]["status"]["state"] == "failed"
    rest = [r["result"] for r in running]
    assert [r["status"]["state"] for r in rest] == ["failed"] and rest[0]["final"]
    list(own.answer(message("message/send")))
    assert len(own.tasks) == 1 and task["id"] not in own.tasks


def test_command_line(capsys):
    seen = []

    def build(settings):
        seen.append(settings)
        return Fake()

    assert cli.main(["-q", "q", "--top-k", "3", "--mmr-lambda", "0.2", "--trace"], build) == 0
    assert seen[0].top_k == 3 and seen[0].mmr_lambda == 0.2 and seen[0].max_chunks == 40
    out = capsys.readouterr().out
    assert "\n1. B › 1" in out and out.index("0.2000  #2  B › 2") < out.index("#1  B › 1") and "          a b\n" in out + "\n" and "c" * 300 + "…" in out
    assert cli.main(["-q", "q", "--format", "json"], build) == 0 and json.loads(capsys.readouterr().out) == RESULT
    assert cli.main(["-q", "q"], lambda s: Fake(found=False)) == 1
    for bad in ([], ["-q", "q", "--build", "x"]):
        with pytest.raises(SystemExit):
            cli.main(bad)


def test_a_real_search_over_http(spark, serve):
    at = serve(searcher(spark, [{"is_sufficient": True}]))
    status, body = call(at + "/query", {"question": "What?", "document_ids": [1]})
    got = json.loads(body)
    assert status == 200 and got["answer"] == "See [Book › 2]." and got["chunks"] and all(c["document_id"] == 1 and c["content"] and c["source"].startswith("Book") for c in got["chunks"])
    assert next(cli.told(got, trace=True)) == "See [Book › 2]."
