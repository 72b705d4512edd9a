"""Model providers over HTTP, chat-completions style, and where their settings come from."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping

# Names of settings, first match wins, and their defaults.
KEY_NAMES, MODEL_NAMES, BASE_NAMES = ["OPENAI_API_KEY", "LLM_API_KEY"], ["OPENAI_MODEL", "LLM_MODEL"], ["OPENAI_BASE_URL", "LLM_BASE_URL"]
DEFAULT_MODEL, DEFAULT_BASE = "gpt-4o-mini", "https://api.openai.com/v1"


class ChatClient:
    """Asks for a JSON answer; a server that knows no such mode is asked again without it. Picklable, so a factory can carry it to executors."""

    def __init__(self, api_key: str, model: str = DEFAULT_MODEL, base_url: str | None = None, temperature: float = 0.0, timeout: float = 120.0):
        self.api_key, self.model, self.temperature, self.timeout = api_key, model, temperature, timeout
        self.url = f"{(base_url or DEFAULT_BASE).rstrip('/')}/chat/completions"

    def _post(self, body: dict) -> dict:
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)

    def complete(self, system_prompt: str, user_prompt: str) -> str:
        body = {"model": self.model, "temperature": self.temperature, "messages": [{"role": "system", "content": system_prompt}, {"role": "user", "content": user_prompt}]}
        try:
            answer = self._post({**body, "response_format": {"type": "json_object"}})
        except urllib.error.HTTPError as e:
            said = e.read().decode(errors="replace").lower()
            if "response_format" not in said and "json_object" not in said:
                raise
            answer = self._post(body)
        if not (content := answer["choices"][0]["message"]["content"]):
            raise RuntimeError("the model gave an empty answer")
        return content


def setting(names: list[str], *places: Mapping[str, str]) -> str | None:
    """The first non-empty value under one of the names; a name is looked up in the environment, then in each place."""
    return next((v for n in names for place in (os.environ, *places) if (v := place.get(n))), None)


def client_factory(api_key: str | None = None, model: str | None = None, base_url: str | None = None, secrets: Mapping[str, str] | None = None) -> Callable[[], ChatClient]:
    """A factory for ``extract.answers`` and ``links.classify_with_model``; arguments win over settings."""
    places = (secrets or {},)
    key = api_key or setting(KEY_NAMES, *places)
    if not key:
        raise ValueError(f"no API key: give one, or set {' or '.join(KEY_NAMES)}")
    chosen, base = model or setting(MODEL_NAMES, *places) or DEFAULT_MODEL, base_url or setting(BASE_NAMES, *places)
    return lambda: ChatClient(key, chosen, base)
