"""Model servers on this machine (C11). No other host is ever contacted."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from dataclasses import dataclass
from urllib.parse import urlparse

LOOPBACK = ("127.0.0.1", "localhost", "::1", "[::1]")
SECONDS = 120.0
PORT = 11434
MODEL = "qwen2.5-coder:3b"


class ClientError(Exception):
    """Anything that keeps a model from answering."""


class NotLoopback(ClientError):
    """The host is not this machine."""


class Unreachable(ClientError):
    """No server answered."""


class BadResponse(ClientError):
    """The server answered without a usable text."""


def require_loopback(host: str | None) -> None:
    if host not in LOOPBACK:
        raise NotLoopback(f"refusing to contact {host!r}: only {', '.join(LOOPBACK[:3])} are allowed")


def post(url: str, body: dict, seconds: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    opener = urllib.request.build_opener(urllib.request.ProxyHandler({}))
    try:
        with opener.open(request, timeout=seconds) as r:
            text = r.read().decode("utf-8", "replace")
    except (urllib.error.URLError, OSError) as e:
        raise Unreachable(f"{url}: {e}") from e
    try:
        return json.loads(text)
    except ValueError as e:
        raise BadResponse(f"not JSON: {text[:200]!r}") from e


@dataclass
class NativeClient:
    """The server's own /api/generate endpoint."""

    host: str = "127.0.0.1"
    port: int = PORT
    model: str = MODEL
    seconds: float = SECONDS

    def __post_init__(self):
        require_loopback(self.host)

    def generate(self, prompt: str) -> str:
        host = f"[{self.host}]" if ":" in self.host and not self.host.startswith("[") else self.host
        got = post(f"http://{host}:{self.port}/api/generate", {"model": self.model, "prompt": prompt, "stream": False, "format": "json", "options": {"temperature": 0}}, self.seconds)
        text = got.get("response") if isinstance(got, dict) else None
        if not isinstance(text, str) or not text.strip():
            raise BadResponse(f"no usable response text: {got!r}")
        return text


@dataclass
class ChatClient:
    """A chat-completions endpoint."""

    base_url: str
    model: str = MODEL
    seconds: float = SECONDS

    def __post_init__(self):
        require_loopback(urlparse(self.base_url).hostname)

    def generate(self, prompt: str) -> str:
        got = post(self.base_url.rstrip("/") + "/chat/completions", {"model": self.model, "temperature": 0, "messages": [{"role": "user", "content": prompt}]}, self.seconds)
        try:
            text = got["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError) as e:
            raise BadResponse(f"unexpected shape: {got!r}") from e
        if not isinstance(text, str) or not text.strip():
            raise BadResponse(f"empty content: {got!r}")
        return text


def make_client(backend: str = "ollama", host: str = "127.0.0.1", port: int = PORT, base_url: str | None = None, model: str = MODEL, seconds: float = SECONDS):
    if backend == "ollama":
        return NativeClient(host, port, model, seconds)
    if backend == "openai":
        return ChatClient(base_url or f"http://{host}:{port}/v1", model, seconds)
    raise ValueError(f"unknown backend {backend!r}")
