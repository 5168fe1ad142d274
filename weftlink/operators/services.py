"""Scorers that ask a language-model service over HTTP. None is used unless it is set up with an address and chosen by name."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from dataclasses import dataclass

from ..functions.responses import ASK_MANY, ASK_ONE
from .scorers import Answer, QuotaExceeded, register

#: How each provider is spoken to; minimax answers one pair at a time.
STYLES = {"ollama": "generate", "openai": "chat", "zai": "chat", "minimax": "chat", "anthropic": "messages"}
SINGLE = ("minimax",)
QUOTA_SIGNS = ("quota", "usage limit", "insufficient balance")


def outer_json(text: str) -> dict | None:
    """The object from the first opening to the last closing brace, its keys in lower case; null if there is none."""
    m = re.search(r"\{.*\}", text, re.S)
    return {k.lower(): v for k, v in json.loads(m[0]).items()} if m else None


def read_one(text: str) -> tuple[float, str]:
    said = outer_json(text)
    if said is not None:
        return float(said.get("confidence") or 0.0), str(said.get("reason") or "")
    m = re.search(r'"confidence":\s*([0-9.]+)', text)
    if not m:
        raise ValueError("The answer can't be read.")
    return float(m[1]), ""


@dataclass
class HttpScorer:
    """A model of one provider at an address; timeout in seconds. Runs inside tasks."""

    provider: str
    model: str
    url: str
    key: str | None = None
    timeout: float = 60.0

    @property
    def name(self) -> str:
        return f"{self.provider}:{self.model}"

    def request(self, prompt: str) -> tuple[str, dict, dict]:
        """(path, headers, body) of a question."""
        style, messages = STYLES[self.provider], [{"role": "user", "content": prompt}]
        if style == "generate":
            return "/api/generate", {}, {"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": 0}}
        if style == "messages":
            return "/v1/messages", {"x-api-key": self.key or "", "anthropic-version": "2023-06-01"}, {"model": self.model, "max_tokens": 2048, "temperature": 0, "messages": messages}
        return "/chat/completions", {"Authorization": f"Bearer {self.key}"} if self.key else {}, {"model": self.model, "temperature": 0, "messages": messages}

    def ask(self, prompt: str) -> tuple[str, dict[str, int]]:
        path, headers, body = self.request(prompt)
        call = urllib.request.Request(self.url.rstrip("/") + path, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
        try:
            with urllib.request.urlopen(call, timeout=self.timeout) as reply:
                said = json.load(reply)
        except urllib.error.HTTPError as e:
            text = e.read().decode(errors="replace")
            if e.code in (402, 429) or any(s in text.lower() for s in QUOTA_SIGNS):
                raise QuotaExceeded(self.name) from e
            raise RuntimeError(f"HTTP {e.code}: {text[:200]}") from e
        style, used = STYLES[self.provider], said.get("usage") or {}
        if style == "generate":
            text, prompt_n, done_n = said.get("response", ""), said.get("prompt_eval_count"), said.get("eval_count")
        elif style == "messages":
            text, prompt_n, done_n = "".join(x.get("text", "") for x in said.get("content", [])), used.get("input_tokens"), used.get("output_tokens")
        else:
            text, prompt_n, done_n = said["choices"][0]["message"]["content"], used.get("prompt_tokens"), used.get("completion_tokens")
        total = used.get("total_tokens")
        counted = any(x is not None for x in (prompt_n, done_n, total))
        both = (prompt_n or 0) + (done_n or 0)
        return text, {"calls": int(counted), "prompt": prompt_n or 0, "completion": done_n or 0, "total": both if total is None else total}

    def one(self, a: str, b: str) -> Answer:
        text, used = self.ask(ASK_ONE + json.dumps({"name1": a, "name2": b}, ensure_ascii=False))
        return Answer(*read_one(text), **used)

    def many(self, pairs: list[tuple[str, str]]) -> list[Answer | None]:
        """Answers by index, the last of an index counts, None where there is none; the first one carries the call's usage."""
        if self.provider in SINGLE:
            return [None] * len(pairs)
        text, used = self.ask(ASK_MANY + json.dumps([{"index": k, "name1": a, "name2": b} for k, (a, b) in enumerate(pairs)], ensure_ascii=False))
        said = outer_json(text)
        rows = [{k.lower(): v for k, v in r.items()} for r in (said or {}).get("results") or []]
        if not rows:
            raise ValueError("The answer has no results.")
        found = {int(r["index"]): (float(r.get("confidence") or 0.0), str(r.get("reason") or "")) for r in rows if r.get("index") is not None}
        first = min((k for k in found if 0 <= k < len(pairs)), default=None)
        return [Answer(*found[k], **(used if k == first else {})) if k in found else None for k in range(len(pairs))]


def set_up(addresses: dict[str, dict]) -> None:
    """Make providers available to make_scorer: {provider: {url, key, timeout}}."""
    for provider, at in addresses.items():
        if provider not in STYLES:
            raise ValueError(f"unknown provider {provider}")
        register(provider, lambda model, p=provider, at=dict(at): HttpScorer(p, model, **at))
