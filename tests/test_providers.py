"""The model providers against a server on this machine."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from inkwell.operators import review
from inkwell.schema import Settings


@pytest.fixture
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization"), body))
            status, answer = (200, {"choices": [{"message": {"content": "issue_count=0"}}]}) if self.path == "/v1/chat/completions" else (200, {"response": "issue_count=1"}) if self.path == "/api/generate" else (401, {"error": {"message": "no such key"}})
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", seen
    http.shutdown()


def test_chat_provider(server):
    url, seen = server
    call = review.provider_of(Settings(llm_enabled=True, openai_base_url=f"{url}/v1/chat/completions", openai_model="m"), "secret")
    assert call("system", "user") == "issue_count=0"
    path, key, body = seen[0]
    assert (path, key, body["model"], body["temperature"], body["top_p"]) == ("/v1/chat/completions", "Bearer secret", "m", 0, 0.1)
    assert [m["role"] for m in body["messages"]] == ["system", "user"] and body["messages"][1]["content"] == "user"
    with pytest.raises(review.ProviderError, match="401: no such key"):
        review.openai_provider(f"{url}/other", "m", "wrong")("s", "u")


def test_generate_provider(server):
    url, seen = server
    call = review.provider_of(Settings(llm_enabled=True, provider="ollama", ollama_endpoint=f"{url}/", ollama_model="m"))
    assert call("system", "user") == "issue_count=1"
    path, _, body = seen[0]
    assert path == "/api/generate" and body["stream"] is False and body["options"] == {"temperature": 0, "top_p": 0.1, "top_k": 1} and body["prompt"] == "system\nuser"


def test_settings_choose_the_provider():
    full = {"llm_enabled": True, "openai_base_url": "http://x", "ollama_endpoint": "http://y", "ollama_model": "m"}
    assert review.provider_of(Settings(**full | {"llm_enabled": False}), "k") is None and review.provider_of(Settings(**full), "") is None
    assert review.provider_of(Settings(**full | {"openai_base_url": ""}), "k") is None and review.provider_of(Settings(**full | {"provider": "ollama", "ollama_model": ""})) is None
    assert callable(review.provider_of(Settings(**full), "k"))


def test_urls_and_error_texts_are_those_of_the_columns(spark):
    urls = ["https://openrouter.ai/v1", "https://openrouter.ai/v1/", "https://x.openrouter.ai/v1/models?a=1", "https://openrouter.ai/api/v1", "https://api.example.com/v1", "https://openrouter.ai/v1x", "no url", ""]
    bodies = ['{"error":{"message":"m"}}', '{"message":"n"}', '{"message":5}', "  raw ", " ", '{"error":"x","message":"n"}', "[1]"]
    df = spark.createDataFrame([(u, b) for u, b in zip(urls, [*bodies, ""])], "url string, body string")
    got = df.select(review.api_url(df["url"]), review.api_error(df["body"])).collect()
    assert [tuple(r) for r in got] == [(review.provider_url(u), review.error_text(b)) for u, b in zip(urls, [*bodies, ""])]
