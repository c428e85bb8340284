"""Language models over HTTP as callables from prompt to text, for classification, decomposition and answers.

Two request shapes are common: a list of choices, and a list of content parts.  Both ask at temperature 0.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

SYSTEM = "Answer questions about a repository from the cited context only."
MAX_TOKENS = 1024


def _post(url: str, headers: dict[str, str], body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.load(reply)


def choices_model(url: str, model: str, key: str, system: str = SYSTEM, timeout: float = 60.0) -> Callable[[str], str]:
    """A model behind a chat endpoint that returns choices; no content is ''."""

    def ask(prompt: str) -> str:
        turns = [{"role": "system", "content": system}, {"role": "user", "content": prompt}]
        said = _post(url, {"Authorization": f"Bearer {key}"}, {"model": model, "temperature": 0, "messages": turns}, timeout)
        return said["choices"][0]["message"].get("content") or ""

    return ask


def parts_model(url: str, model: str, headers: dict[str, str], system: str = SYSTEM, timeout: float = 60.0) -> Callable[[str], str]:
    """A model behind a messages endpoint that returns content parts; texts are joined by line breaks.

    :param headers: what the endpoint asks for, such as its key and version.
    """

    def ask(prompt: str) -> str:
        body = {"model": model, "temperature": 0, "max_tokens": MAX_TOKENS, "system": system, "messages": [{"role": "user", "content": prompt}]}
        said = _post(url, headers, body, timeout)
        return "\n".join(p["text"] for p in said["content"] if p.get("text"))

    return ask
