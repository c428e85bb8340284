"""Settings of a deployment, checked when they are made."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

ENVIRONMENTS = ("development", "test", "staging", "production")
LOG_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
#: Values that stand for a secret that was not set.
PLACEHOLDERS = ("", "change-me", "changeme", "secret", "placeholder")


@dataclass(frozen=True)
class Settings:
    environment: str = "development"
    log_level: str = "INFO"
    path_prefix: str = "/api/v1"
    rate_limit_per_minute: int = 60
    max_repository_mb: int = 100
    shared_folder: str = ""
    model_url: str = ""
    model_name: str = ""
    model_key: str = "change-me"
    token_minutes: int = 30
    refresh_days: int = 7

    def __post_init__(self) -> None:
        for name, allowed in (("environment", ENVIRONMENTS), ("log_level", LOG_LEVELS)):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        for name in ("rate_limit_per_minute", "max_repository_mb", "token_minutes", "refresh_days"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if not self.path_prefix.startswith("/"):
            raise ValueError("path_prefix must start with /")
        object.__setattr__(self, "path_prefix", self.path_prefix.rstrip("/") or "/")
        if self.model_url and not self.model_url.startswith(("http://", "https://")):
            raise ValueError("model_url must be an http or https address")
        if self.environment == "production" and self.model_key.lower() in PLACEHOLDERS:
            raise ValueError("production needs a real value for: model_key")

    @classmethod
    def from_environment(cls, prefix: str = "LODESTONE_") -> Settings:
        """Settings from variables such as LODESTONE_LOG_LEVEL; names are taken in any case, others are ignored."""
        given = {k.upper(): v for k, v in os.environ.items()}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{n: kind(given[f"{prefix}{n.upper()}"]) for n, kind in kinds.items() if f"{prefix}{n.upper()}" in given})
