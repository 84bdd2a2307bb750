"""Small control files that the driver reads: front matter, environment files, model slots."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field


def unquoted(s: str) -> str:
    s = s.strip()
    return s[1:-1] if len(s) > 1 and s[0] == s[-1] and s[0] in "\"'" else s


def front_matter(text: str) -> dict[str, str | list[str]]:
    """The keys between two --- lines: scalars, or lists of the "- " lines below an empty key."""
    rows = text.splitlines()
    if not rows or rows[0].strip() != "---":
        return {}
    out: dict[str, str | list[str]] = {}
    key = None
    for row in rows[1:]:
        if row.strip() == "---":
            break
        item = row.strip()
        if key is not None and item.startswith("- ") and not re.match(r"\S[^:]*:", row):
            if value := unquoted(item[2:]):
                out[key].append(value)  # type: ignore[union-attr]
            continue
        if ":" in row and (key is None or row[:1].strip()):
            name, _, value = (x.strip() for x in row.partition(":"))
            key = None if value else name
            out[name] = unquoted(value) if value else []
    return out


def first_sentence(text: str) -> str:
    """The first line of the body that isn't blank or a heading."""
    rows = text.splitlines()
    if rows and rows[0].strip() == "---":
        end = next((i for i, r in enumerate(rows[1:], 1) if r.strip() == "---"), len(rows))
        rows = rows[end + 1 :]
    return next((r.strip() for r in rows if r.strip() and not r.strip().startswith("#")), "")


def theme_names(value: object) -> list[str]:
    """Themes given as a list, as JSON text of a list, or as one name; each once."""
    if isinstance(value, str):
        try:
            parsed = json.loads(value)
        except ValueError:
            parsed = value
        value = parsed if isinstance(parsed, list) else [value]
    return list(dict.fromkeys(t for t in (unquoted(str(x)) for x in value or []) if t))


def environment(text: str) -> dict[str, str]:
    """NAME=value lines; variables of the process win."""
    pairs = (r.strip().removeprefix("export ").partition("=") for r in text.splitlines() if "=" in r and not r.lstrip().startswith("#"))
    return {k.strip(): unquoted(v) for k, _, v in pairs} | dict(os.environ)


def key_pool(pool: str, single: str = "") -> tuple[str, ...]:
    keys = [k.strip() for k in re.split(r"[,\n]", pool)] + [single.strip()]
    return tuple(dict.fromkeys(k for k in keys if k))


def base_url(url: str) -> str:
    return re.sub(r"/chat/completions$", "", url.strip().rstrip("/")).rstrip("/")


@dataclass(frozen=True)
class Slot:
    """A screener's settings; its keys stay out of tables, logs and printed forms."""

    name: str
    model: str
    keys: tuple[str, ...] = field(default=(), repr=False)
    per_key: int = 70
    timeout: int = 120
    retries: int = 5

    @property
    def workers(self) -> int:
        return self.per_key * max(1, len(self.keys))


def duration(seconds: int) -> str:
    for size, unit in ((86400, "天"), (3600, "小时"), (60, "分")):
        if seconds >= size:
            rest = seconds % size
            return f"{seconds // size}{unit}" + (duration(rest) if rest else "")
    return f"{seconds}秒"
