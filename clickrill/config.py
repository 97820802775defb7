"""Typed settings, read from `key=value` lines, with the key names of the job's configuration file."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Config:
    values: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Config:
        pairs = (line.partition("=") for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#"))
        return cls({k.strip(): v.strip() for k, _, v in pairs})

    @classmethod
    def read(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            return cls.parse(f.read())

    def text(self, key: str, default: str | None = None) -> str:
        if key not in self.values and default is None:
            raise KeyError(f"setting {key} is missing")
        return self.values.get(key, default)

    def integer(self, key: str, default: int | None = None) -> int:
        return int(self.text(key, None if default is None else str(default)))

    def jdbc(self, database: str | None = None) -> tuple[str, dict[str, str]]:
        """(url, properties) of a database: keys jdbc.<database>.url, .user, .password, .driver, or jdbc.url ... for the only one."""
        at = f"jdbc.{database}" if database else "jdbc"
        return self.text(f"{at}.url"), {k: self.values[f"{at}.{k}"] for k in ("user", "password", "driver") if self.values.get(f"{at}.{k}")}
