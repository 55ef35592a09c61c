"""Wikis and settings: layered configuration and the registry of wikis. Driver side only."""

from __future__ import annotations

import json
import os
import re
import tomllib
from dataclasses import dataclass, field, replace

from lorespark.errors import ConfigError, NotFound


@dataclass(frozen=True)
class Settings:
    width: int = 110
    code: bool = True
    hidden: bool = False
    max_file_size: int = 16 * 1024 * 1024
    ignore: tuple[str, ...] = ()
    auto_update: bool = True


def layered(*layers: dict) -> Settings:
    """Later layers win; ignore globs add up; unknown keys are errors."""
    out = Settings()
    for layer in layers:
        for key, value in layer.items():
            if key not in Settings.__dataclass_fields__:
                raise ConfigError(f"unknown setting `{key}`")
            out = replace(out, **{key: (*out.ignore, *value) if key == "ignore" else value})
    return out


def expand(path: str, home: str | None = None) -> str:
    """A path with `~` or a leading `~/` as the home folder; other users' homes are not looked up."""
    home = home or os.environ.get("HOME") or os.path.expanduser("~")
    return home if path == "~" else home.rstrip("/") + path[1:] if path.startswith("~/") else path


def settings_of(*files: str, env: dict[str, str] | None = None) -> Settings:
    """Settings of TOML files, the later ones stronger and missing ones skipped, below those of the environment."""
    layers = []
    for path in map(expand, files):
        if os.path.exists(path):
            with open(path, "rb") as f:
                try:
                    layers.append(tomllib.load(f).get("index", {}))
                except tomllib.TOMLDecodeError as e:
                    raise ConfigError(f"{path}: {e}") from e
    return layered(*layers, environment(env=env))


def environment(prefix: str = "LORESPARK_", env: dict[str, str] | None = None) -> dict:
    """The layer that the environment gives."""
    found = {}
    for key, value in (os.environ if env is None else env).items():
        name = key.removeprefix(prefix).lower()
        if key.startswith(prefix) and name in Settings.__dataclass_fields__:
            kind = Settings.__dataclass_fields__[name].type
            found[name] = value.lower() in ("1", "true", "yes") if kind == "bool" else int(value) if kind == "int" else tuple(value.split(","))
    return found


@dataclass
class Wiki:
    name: str
    root: str
    mounts: list[str] = field(default_factory=list)


class Registry:
    """Wikis by name, with a default one. Removing or renaming a wiki keeps the mounts of others right."""

    def __init__(self, wikis: list[Wiki] | None = None, default: str | None = None):
        self.wikis: dict[str, Wiki] = {}
        self.default = default
        for w in wikis or []:
            self.add(w.name, w.root, w.mounts)

    @classmethod
    def load(cls, toml: str) -> Registry:
        data = tomllib.loads(toml)
        return cls([Wiki(w["name"], w["root"], list(w.get("mounts", []))) for w in data.get("wikis", [])], data.get("default_wiki"))

    def dump(self) -> str:
        """The registry as TOML that load reads."""
        quote = lambda s: json.dumps(s, ensure_ascii=False)
        out = [f"default_wiki = {quote(self.default)}\n"] if self.default else []
        for w in self.wikis.values():
            out.append(f"\n[[wikis]]\nname = {quote(w.name)}\nroot = {quote(w.root)}\nmounts = [{', '.join(map(quote, w.mounts))}]\n")
        return "".join(out)

    def save(self, path: str) -> None:
        """Replaces the file at once, so a reader sees the old registry or the new one."""
        path = expand(path)
        with open(f"{path}.new", "w") as f:
            f.write(self.dump())
        os.replace(f"{path}.new", path)

    def add(self, name: str, root: str, mounts: list[str] | None = None) -> None:
        if not name or not re.fullmatch(r"[^\s/:\x00]+", name):
            raise ConfigError(f"not a wiki name: `{name}`")
        if name in self.wikis:
            raise ConfigError(f"there is a wiki `{name}` already")
        self.wikis[name] = Wiki(name, expand(root), list(mounts or []))
        self.default = self.default or name

    def get(self, name: str) -> Wiki:
        if name not in self.wikis:
            raise NotFound(f"no wiki `{name}`")
        return self.wikis[name]

    def remove(self, name: str) -> None:
        self.get(name)
        del self.wikis[name]
        for w in self.wikis.values():
            w.mounts = [m for m in w.mounts if m != name]
        if self.default == name:
            self.default = next(iter(sorted(self.wikis)), None)

    def rename(self, old: str, new: str) -> None:
        w = self.get(old)
        self.add(new, w.root, w.mounts)
        del self.wikis[old]
        for other in self.wikis.values():
            other.mounts = [new if m == old else m for m in other.mounts]
        if self.default == old:
            self.default = new

    def mount(self, into: str, name: str) -> None:
        self.get(name)
        if name not in self.get(into).mounts:
            self.get(into).mounts.append(name)

    def unmount(self, into: str, name: str) -> None:
        self.get(into).mounts = [m for m in self.get(into).mounts if m != name]

    def search_order(self, start: str) -> list[Wiki]:
        """The wiki and what is mounted into it, breadth first, each once."""
        out, queue, seen = [], [start], {start}
        while queue:
            w = self.wikis.get(queue.pop(0))
            if w is None:
                continue
            out.append(w)
            queue += [m for m in w.mounts if m not in seen]
            seen |= set(w.mounts)
        return out

    def missing_mounts(self) -> list[tuple[str, str]]:
        return [(w.name, m) for w in self.wikis.values() for m in w.mounts if m not in self.wikis]

    def owner(self, path: str) -> Wiki | None:
        """The wiki with the longest root above a path."""
        return max((w for w in self.wikis.values() if path == w.root or path.startswith(w.root.rstrip("/") + "/")), key=lambda w: len(w.root), default=None)

    def select(self, name: str | None = None, everything: bool = False) -> list[Wiki]:
        if everything:
            return [self.wikis[n] for n in sorted(self.wikis)]
        if name or self.default:
            return [self.get(name or self.default)]
        raise NotFound("no wiki")
