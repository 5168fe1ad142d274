"""Services, spoken to over a local stand-in."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from weftlink.functions import responses
from weftlink.operators import scorers, services

SAID = {}


class Service(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        SAID["last"] = (self.path, body, dict(self.headers))
        code, answer = SAID["reply"](body)
        text = json.dumps(answer).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(text)))
        self.end_headers()
        self.wfile.write(text)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_providers(url):
    services.set_up({p: {"url": url, "key": "k", "timeout": 5} for p in services.STYLES})
    one = 'Yes: {"Confidence": 0.9, "isMatch": true, "reason": "same"}'
    many = 'x {"results": [{"index": 1, "confidence": 0.2}, {"index": 1, "confidence": 0.3}, {"Index": 2, "Confidence": 0.7}]}'
    replies = {
        "ollama": lambda t: {"response": t, "prompt_eval_count": 5, "eval_count": 2}, "openai": lambda t: {"choices": [{"message": {"content": t}}], "usage": {"prompt_tokens": 5, "completion_tokens": 2, "total_tokens": 9}},
        "anthropic": lambda t: {"content": [{"text": t}], "usage": {"input_tokens": 5, "output_tokens": 2}},
    }
    for provider, wrap in replies.items():
        s = scorers.make_scorer(f"{'claude' if provider == 'anthropic' else provider}:m:1")
        SAID["reply"] = lambda body, wrap=wrap: (200, wrap(one))
        a = s.one("Ann", "Änn")
        assert (a.confidence, a.reason, a.calls, a.prompt, a.total) == (0.9, "same", 1, 5, 9 if provider == "openai" else 7) and SAID["last"][1]["model"] == "m:1"
        SAID["reply"] = lambda body, wrap=wrap: (200, wrap(many))
        got = s.many([("a", "b")] * 3)
        assert [x and x.confidence for x in got] == [None, 0.3, 0.7] and [x and x.calls for x in got] == [None, 1, 0]
        SAID["reply"] = lambda body, wrap=wrap: (200, wrap("nothing"))
        assert scorers.answered([("a", "b")], s, batched=True)[0].error == "The answer can't be read."
        SAID["reply"] = lambda body: (429, {"error": "too many"})
        assert scorers.answered([("a", "b"), ("c", "d")], s, batched=True)[1].error == scorers.QUOTA
        SAID["reply"] = lambda body: (500, {"error": "down"})
        assert scorers.answered([("a", "b")], s, batched=True)[0].error.startswith("HTTP 500")
    SAID["reply"] = lambda body: (200, replies["openai"](one))
    assert scorers.make_scorer("minimax:m").many([("a", "b")]) == [None] and scorers.answered([("a", "b")], scorers.make_scorer("minimax:m"), batched=True)[0].confidence == 0.9
    with pytest.raises(ValueError):
        services.set_up({"other": {}})


def test_answers_are_read_once(spark):
    """What stands in a lambda is worked out for each element again: the JSON of a batch isn't read there, nor twice to tell an error."""
    plan = spark.range(1).selectExpr("cast(id AS string) AS said").select(responses.parse_many(F.col("said")).alias("r"))
    assert plan._jdf.queryExecution().analyzed().toString().lower().count("from_json") == 1
    assert str(responses.parse_landmarks(F.col("said"), F.lit(800), F.lit(600))).count("try_parse_json") == 1
