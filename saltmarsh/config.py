"""Settings, read from the environment or a .env file, with all faults reported together."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields
from datetime import timedelta

_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
_PART = re.compile(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|μs|ms|s|m|h)")


def duration(value: str) -> timedelta:
    """Durations such as "1.5s", "2h45m" or "-300ms"; a bare "0" is allowed, other bare numbers aren't."""
    body = value[1:] if value[:1] in ("+", "-") else value
    if body == "0":
        return timedelta(0)
    if not body or not re.fullmatch(f"(?:{_PART.pattern})+", body):
        raise ValueError(f"not a duration: {value!r}")
    seconds = sum(float(n) * _UNITS[u] for n, u in _PART.findall(body))
    return timedelta(seconds=-seconds if value[0] == "-" else seconds)


@dataclass(frozen=True)
class Config:
    warehouse: str = "warehouse/saltmarsh"
    site_host: str = "example.org"
    cover_host: str = "cdn.example.net"
    start_url: str = "https://example.org/truyen?sort=rate&order=desc"
    catalog_max_page: int = 284
    request_interval: timedelta = timedelta(seconds=3)
    request_jitter: timedelta = timedelta(milliseconds=1500)
    workers: int = 1
    http_timeout: timedelta = timedelta(seconds=30)
    http_retries: int = 3
    max_response_bytes: int = 8 << 20
    user_agent: str = "SaltmarshArchiver/1.0 (rate-limited)"
    public_dir: str = "public"
    cover_max_bytes: int = 5 << 20
    max_job_attempts: int = 8
    idle_exit_after: timedelta = timedelta(0)
    robots_cache_ttl: timedelta = timedelta(hours=12)
    robots_failure_ttl: timedelta = timedelta(minutes=5)
    robots_max_bytes: int = 512 << 10
    lease: timedelta = timedelta(minutes=10)
    log_level: str = "info"

    def __post_init__(self) -> None:
        rules = {
            "warehouse must not be empty": bool(self.warehouse),
            f"start_url must be a /truyen page on https://{self.site_host}": self.start_url.startswith(f"https://{self.site_host}/truyen"),
            "catalog_max_page must lie in 1..10000": 1 <= self.catalog_max_page <= 10_000,
            "request_interval must be 1s at least": self.request_interval >= timedelta(seconds=1),
            "request_jitter must not be negative": self.request_jitter >= timedelta(0),
            "workers must lie in 1..8": 1 <= self.workers <= 8,
            "http_timeout must be 1s at least": self.http_timeout >= timedelta(seconds=1),
            "http_retries must lie in 1..5": 1 <= self.http_retries <= 5,
            "max_response_bytes must be 1024 at least": self.max_response_bytes >= 1024,
            "max_job_attempts must be 1 at least": self.max_job_attempts >= 1,
            "robots_cache_ttl must be 1m at least": self.robots_cache_ttl >= timedelta(minutes=1),
        }
        faults = [said for said, holds in rules.items() if not holds]
        if faults:
            raise ValueError("; ".join(faults))


def load(env: Mapping[str, str] | None = None) -> Config:
    """Settings named in capitals in the environment; empty ones keep their default."""
    env = os.environ if env is None else env
    found, faults = {}, []
    for field in fields(Config):
        raw = env.get(field.name.upper(), "").strip()
        if not raw:
            continue
        try:
            kind = type(field.default)
            found[field.name] = duration(raw) if kind is timedelta else kind(raw)
        except ValueError as fault:
            faults.append(f"{field.name}: {fault}")
    if faults:
        raise ValueError("; ".join(faults))
    if "log_level" in found:
        found["log_level"] = found["log_level"].lower()
    return Config(**found)


def dotenv(path: str, env: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE lines that don't override what is set; a missing file has none, another line is an error."""
    env = os.environ if env is None else env
    if not os.path.exists(path):
        return env
    with open(path, encoding="utf-8") as lines:
        for line in map(str.strip, lines):
            if not line or line.startswith("#"):
                continue
            key, sign, value = line.partition("=")
            if not sign:
                raise ValueError(f"not KEY=VALUE: {line!r}")
            env.setdefault(key.strip(), value.strip().strip("\"'`"))
    return env
