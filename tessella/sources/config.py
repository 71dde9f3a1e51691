"""Settings from INI files, from a remote service with caches, and merged."""

from __future__ import annotations

import base64
import configparser
import hashlib
import hmac
import json
import os
import time
from collections.abc import Callable

SECTION = "configurations"


def load_ini(path: str) -> dict[str, str]:
    """The settings of the one section; all are texts."""
    parser = configparser.ConfigParser(interpolation=None)
    parser.optionxform = str
    if not parser.read(path, encoding="utf-8"):
        raise FileNotFoundError(path)
    if not parser.has_section(SECTION):
        raise ValueError(f"{path} has no section {SECTION}")
    return dict(parser.items(SECTION))


def save_ini(path: str, local: dict[str, str], remote: dict[str, str]) -> dict[str, str]:
    """Write local settings with the remote ones over them."""
    merged = local | remote
    parser = configparser.ConfigParser(interpolation=None)
    parser.optionxform = str
    parser[SECTION] = merged
    with open(path, "w", encoding="utf-8") as f:
        parser.write(f)
    return merged


def sign(secret: str, text: str) -> str:
    """HMAC-SHA1 of a text, in base 64."""
    return base64.b64encode(hmac.new(secret.encode(), text.encode(), hashlib.sha1).digest()).decode()


class RemoteSettings:
    """Settings by namespace and key: from memory, else the network, else a file cache, else a default.

    Keys that nothing had are remembered as missing for `missing_seconds`.
    """

    def __init__(self, fetch: Callable[[str], dict[str, str] | None], cache_dir: str, missing_seconds: float = 60.0, clock: Callable[[], float] = time.time):
        self.fetch, self.cache_dir, self.missing_seconds, self.clock = fetch, cache_dir, missing_seconds, clock
        self.known: dict[str, dict[str, str]] = {}
        self.missing: dict[str, float] = {}
        self.listeners: list[Callable[[str, str, str, str | None], None]] = []

    def _file(self, namespace: str) -> str:
        return os.path.join(self.cache_dir, f"{hashlib.md5(namespace.encode()).hexdigest()}.json")

    def get(self, key: str, default: str | None = None, namespace: str = "application") -> str | None:
        if key in self.known.get(namespace, {}):
            return self.known[namespace][key]
        mark = f"{namespace}{len(namespace)}{key}"
        if self.missing.get(mark, 0) > self.clock():
            return default
        values = self._load(namespace)
        if key in values:
            return values[key]
        self.missing[mark] = self.clock() + self.missing_seconds
        return default

    def _load(self, namespace: str) -> dict[str, str]:
        try:
            values = self.fetch(namespace)
        except OSError:
            values = None
        if values is not None:
            self.update(namespace, values)
            os.makedirs(self.cache_dir, exist_ok=True)
            with open(self._file(namespace), "w", encoding="utf-8") as f:
                json.dump(values, f, ensure_ascii=False)
            return values
        if os.path.exists(self._file(namespace)):
            with open(self._file(namespace), encoding="utf-8") as f:
                return json.load(f)
        return {}

    def update(self, namespace: str, new: dict[str, str]) -> list[tuple[str, str, str | None]]:
        """Take new settings; listeners hear of each change as (change, namespace, key, value)."""
        old = self.known.get(namespace, {})
        changes: list[tuple[str, str, str | None]] = []
        for key, value in old.items():
            if new.get(key) is None:
                changes.append(("delete", key, value))
            elif new[key] != value:
                changes.append(("update", key, new[key]))
        changes += [("add", key, value) for key, value in new.items() if old.get(key) is None]
        self.known[namespace] = dict(new)
        for change, key, value in changes:
            for listener in self.listeners:
                listener(change, namespace, key, value)
        return changes
