"""A client for chat completion services with the common HTTP interface, made on executors by `RemoteScreener`."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from dataclasses import dataclass

from ..operators.screening import Busy, FormatError, Reply, RequestError
from .pacing import seconds_of

# fixed values
MAX_TOKENS = {"coarse": 400, "targeted": 5000, "arbitration": 1200}
TIMEOUT = 120.0
#: services that don't know response_format answer with one of these
NO_FORMAT = (400, 404, 422)
#: answers that ask for another try, besides all from 500 on
BUSY = (408, 429)


def answer_text(response: dict) -> str:
    """What the first choice says: a text, or the texts of its parts; a choice that says nothing is blank."""
    match response:
        case {"choices": [{"message": {"content": str(said)}}, *_]}:
            return said
        case {"choices": [{"message": {"content": [*parts]}}, *_]}:
            said = [p["text"] for p in parts if isinstance(p, dict) and p.get("text") is not None]
            return "".join(map(str, said))
        case {"choices": [_, *_]}:
            return ""
    raise FormatError("no choices")


@dataclass(frozen=True)
class ChatClient:
    """client(prompt, api_key) -> Reply. Network failures are OSErrors, refusals RequestErrors, of which Busy ones are worth another try."""

    base_url: str
    model: str
    max_tokens: int
    temperature: float = 0.0
    timeout: float = TIMEOUT
    provider: str = ""

    def _post(self, body: dict, api_key: str) -> dict:
        data = json.dumps(body, ensure_ascii=False).encode()
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {api_key}"}
        with urllib.request.urlopen(urllib.request.Request(f"{self.base_url}/chat/completions", data, headers), timeout=self.timeout) as found:
            text = found.read().decode("utf-8", "replace")
        try:
            response = json.loads(text)
        except ValueError as x:
            raise FormatError(str(x)) from None
        if not isinstance(response, dict):
            raise FormatError("not an object")
        return response

    def __call__(self, prompt: str, api_key: str) -> Reply:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": self.temperature, "max_tokens": self.max_tokens}
        for more in ({"response_format": {"type": "json_object"}}, {}):
            try:
                response = self._post(body | more, api_key)
            except urllib.error.HTTPError as x:
                if more and x.code in NO_FORMAT:
                    continue
                said = f"HTTP {x.code} {x.reason}"
                if x.code in BUSY or x.code >= 500:
                    raise Busy(said, seconds_of(x.headers.get("Retry-After"), time.time())) from None
                raise RequestError(said) from None
            usage = response.get("usage")
            return Reply(answer_text(response), usage if isinstance(usage, dict) else {}, str(response.get("model") or self.model), self.provider)
        raise AssertionError
