"""Settings: TOML over defaults, then the environment, then blanks from a JSON file of another tool."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

PREFIX = "THREADLOOM_"


@dataclass(frozen=True)
class Server:
    url: str = ""
    email: str = ""
    api_key: str = ""

    def check(self) -> None:
        for f in fields(self):
            if not getattr(self, f.name):
                raise ValueError(f"server.{f.name} is missing (settings or {PREFIX}{f.name.upper()})")


@dataclass(frozen=True)
class Sync:
    concurrency: int = 4  # tasks that ask the server at a time
    requests_a_minute: int = 0  # of all tasks together; 0: any number
    streams: tuple[str, ...] = ()
    exclude_streams: tuple[str, ...] = ("social", "random")


@dataclass(frozen=True)
class Embeddings:
    enabled: bool = False
    provider: str = "local"  # or "ollama", a model server at `base`
    base: str = "http://localhost:11434"
    model: str = "hash"
    batch_size: int = 32
    sample_messages: int = 50


@dataclass(frozen=True)
class Config:
    archive: str = "~/.threadloom/archive"
    media_dir: str = "~/.threadloom/media"
    server: Server = field(default_factory=Server)
    sync: Sync = field(default_factory=Sync)
    embeddings: Embeddings = field(default_factory=Embeddings)


def _part(kind, values: dict):
    known = {f.name for f in fields(kind)}
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})


def _expanded(folder: str) -> str:
    return os.path.expanduser(folder) if folder.startswith("~") else folder


def load(path: str | os.PathLike = "~/.threadloom/config.toml", environ: dict[str, str] | None = None) -> Config:
    """A missing file gives the defaults; values that can't hold (concurrency below 1) become defaults."""
    file = Path(path).expanduser()
    d = tomllib.loads(file.read_text()) if file.exists() else {}
    c = Config(
        _expanded(d.get("archive") or Config.archive),
        _expanded(d.get("media_dir") or Config.media_dir),
        _part(Server, d.get("server", {})),
        _part(Sync, d.get("sync", {})),
        _part(Embeddings, d.get("embeddings", {})),
    )
    if c.sync.concurrency <= 0:
        c = replace(c, sync=replace(c.sync, concurrency=Sync.concurrency))
    env = os.environ if environ is None else environ
    own = {f.name: env[PREFIX + f.name.upper()] for f in fields(Server) if env.get(PREFIX + f.name.upper())}
    return replace(c, server=replace(c.server, **own))


def save(config: Config, path: str | os.PathLike) -> None:
    """The settings as a TOML file that only its owner can read."""
    lines = [f"{f.name} = {_toml(getattr(config, f.name))}" for f in fields(config) if isinstance(getattr(config, f.name), str)]
    for section in ("server", "sync", "embeddings"):
        own = getattr(config, section)
        lines += ["", f"[{section}]", *(f"{f.name} = {_toml(getattr(own, f.name))}" for f in fields(own))]
    file = Path(path).expanduser()
    file.parent.mkdir(parents=True, exist_ok=True)
    file.touch(mode=0o600)
    file.write_text("\n".join(lines) + "\n")


def _toml(value) -> str:
    return json.dumps(list(value) if isinstance(value, tuple) else value)


def fill_from_json(config: Config, path: str | os.PathLike, channel: str) -> Config:
    """Blank server settings from `channels.<channel>` of a JSON file, or from its top level."""
    d = json.loads(Path(path).expanduser().read_text())
    nested = d.get("channels", {}).get(channel) or {}
    names = {"url": ("url", "site", "realm"), "email": ("email",), "api_key": ("api_key", "apiKey")}
    new = {}
    for own, keys in names.items():
        if not getattr(config.server, own):
            new[own] = next((str(src[k]) for src in (nested, d) for k in keys if src.get(k)), "")
    return replace(config, server=replace(config.server, **new))
