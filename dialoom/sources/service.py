"""A text generator behind a chat-completions HTTP interface."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from dataclasses import dataclass

from dialoom.operators.regenerate import GenerationError

# Sampling temperature, reply length and timeout of a request.
TEMPERATURE = 0.7
REPLY_TOKENS = 2048
TIMEOUT_SECONDS = 60


@dataclass(frozen=True)
class ChatService:
    """Callable for ``regenerate_replies``: one user message in, the reply's text out.

    A refusal becomes a ``GenerationError`` with its status, which the retry policy reads.
    """

    url: str
    model: str
    api_key: str | None = None
    temperature: float = TEMPERATURE
    max_tokens: int = REPLY_TOKENS
    timeout: float = TIMEOUT_SECONDS

    def __call__(self, prompt: str) -> str:
        body = {
            "model": self.model,
            "messages": [{"role": "user", "content": prompt}],
            "temperature": self.temperature,
            "max_tokens": self.max_tokens,
        }
        headers = {"Content-Type": "application/json"}
        if self.api_key:
            headers["Authorization"] = f"Bearer {self.api_key}"
        request = urllib.request.Request(
            f"{self.url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers
        )
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.load(answer)["choices"][0]["message"]["content"]
        except urllib.error.HTTPError as error:
            raise GenerationError(error.code, str(error)) from error
