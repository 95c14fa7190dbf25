"""Configuration: a JSON file found in the usual places, checked on load."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from pathlib import Path

from siftlake.functions.text import SUFFIX_RULES
from siftlake.operators.enrich import Enrichment

DOMAIN = re.compile(r"[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+", re.I)


class ConfigError(ValueError):
    pass


@dataclass
class Config:
    breach_key: str | None = None
    suffix_rules: dict[str, list[str]] = field(default_factory=lambda: {k: [*v] for k, v in SUFFIX_RULES.items()})
    custom_passwords: list[str] = field(default_factory=list)
    working_directory: str = "/tmp/siftlake"
    enrichment: Enrichment = field(default_factory=Enrichment)

    def check(self) -> Config:
        if self.breach_key is not None and not re.fullmatch(r"[0-9a-fA-F]{32}", self.breach_key):
            raise ConfigError("the breach service key must be 32 hex digits")
        for canonical, others in self.suffix_rules.items():
            for domain in (canonical, *others):
                if not DOMAIN.fullmatch(domain):
                    raise ConfigError(f"not a domain: {domain!r}")
        return self


def search_path(given: str | None = None) -> list[Path]:
    home = Path(os.environ.get("XDG_CONFIG_HOME", Path.home() / ".config"))
    return [Path(p) for p in ([given] if given else ["siftlake.json", home / "siftlake" / "config.json", "/etc/siftlake/config.json"])]


def load(given: str | None = None) -> Config:
    """The first file of the search path, or defaults."""
    for path in search_path(given):
        if path.exists():
            raw = json.loads(path.read_text())
            hibp = raw.get("api_keys", {}).get("hibp", {})
            return Config(
                hibp.get("api_key") if hibp.get("enabled") else None,
                raw.get("email_suffix_substitutions", Config().suffix_rules), raw.get("custom_passwords", []),
                raw.get("working_directory", {}).get("path", Config().working_directory), Enrichment(**raw.get("enrichment", {})),
            ).check()
    if given:
        raise ConfigError(f"no such file: {given}")
    return Config()
