"""Names of runs, indexes and artifacts, and the sections of a configuration that name models."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path
from typing import Any
from zoneinfo import ZoneInfo

#: Longest name of a collection.
NAME_LIMIT = 63
_CHUNKS = re.compile(r"chunks_(?P<strategy>.+)_(?P<model>[^_]+)_t(?P<tokens>\d+)_o(?P<overlap>\d+)(?:_(?P<stamp>\d{8}-\d{4}))?$")


def slug(text: str, fallback: str = "index") -> str:
    plain = re.sub(r"[^A-Za-z0-9._-]+", "-", text).strip(".-_").lower()
    return re.sub(r"\.\.+", ".", plain) or fallback


def index_name(chunks_path: str, prefix: str) -> str:
    """prefix and the chunks' strategy, model and sizes, or the file's stem; at most NAME_LIMIT characters, none of them at an edge."""
    stem = Path(chunks_path.replace("\\", "/")).stem
    found = _CHUNKS.fullmatch(stem)
    rest = f"{found['strategy']}-{found['model']}-t{found['tokens']}-o{found['overlap']}" if found else stem
    return slug(f"{prefix}-{rest}")[:NAME_LIMIT].rstrip(".-_")


def child_of(root: str, name: str) -> Path:
    """root / name, which must lie inside of root."""
    base = Path(root).resolve()
    made = (base / name).resolve()
    if made == base or base not in made.parents:
        raise ValueError(f"{name!r} leaves {root}")
    return made


def fresh(path: Path) -> Path:
    """path, or path with the first free number where it is taken."""
    made, k = path, 1
    while made.exists():
        made, k = path.with_name(f"{path.stem}-{k}{path.suffix}"), k + 1
    return made


def stamp(now: datetime | None = None, zone: str = "Europe/Rome") -> str:
    return (now or datetime.now(ZoneInfo("UTC"))).astimezone(ZoneInfo(zone)).strftime("%Y%m%d-%H%M")


def short_model(name: str) -> str:
    return name.replace("\\", "/").rstrip("/").rsplit("/", 1)[-1]


def run_label(metadata: dict[str, Any]) -> str:
    """What tells a run from others, in a line."""
    parts = [" + ".join(metadata.get("components", [])), metadata.get("aggregation_strategy") if len(metadata.get("components", [])) > 1 else None]
    if weights := metadata.get("component_weights"):
        parts.append(", ".join(f"{k}={v:g}" for k, v in sorted(weights.items())))
    rerank = metadata.get("reranking") or {}
    parts.append(f"rerank {short_model(rerank['model'])}" if isinstance(rerank, dict) and rerank.get("enabled") and rerank.get("model") else None)
    return " | ".join(p for p in parts if p) or "run"


@dataclass(frozen=True)
class ModelConfig:
    """A model of a provider; keys that are not known go to the provider as they are."""

    provider: str
    model: str
    base_url: str = ""
    api_key_env: str = ""
    temperature: float | None = None
    top_p: float | None = None
    max_tokens: int | None = None
    system_prompt: str = ""
    extra_options: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def parse(cls, section: dict[str, Any]) -> ModelConfig:
        known = set(cls.__dataclass_fields__) - {"extra_options"}
        for name in ("provider", "model"):
            if not isinstance(section.get(name), str) or not section[name].strip():
                raise ValueError(f"{name} must be a string that is not empty")
        return cls(**{k: v for k, v in section.items() if k in known}, extra_options={k: v for k, v in section.items() if k not in known})

    def options(self) -> dict[str, Any]:
        """What a request carries besides messages; nothing that is not set."""
        given = {"model": self.model, "temperature": self.temperature, "top_p": self.top_p, "max_tokens": self.max_tokens}
        return {k: v for k, v in given.items() if v is not None} | self.extra_options
