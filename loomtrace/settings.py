"""Settings of the driver: environment files, JSON overrides, the import approval, the processing signature."""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Iterable
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

from .functions.plain import normalize_label

# Versions that decide whether a session is processed again.
SCHEMA, ADAPTERS, REDACTION, CLASSIFICATION, RETAIN = "agent-session-v1", "0.2.0", "3", "3", "2"
# Replies that are tried again, and the wait after a rate limit that names none.
RETRYABLE = frozenset({408, 425, 429, 500, 502, 503, 504})
RATE_LIMIT_MS = 1_000


def read_environment(text: str) -> dict[str, str]:
    """``NAME=value`` lines; comments and other lines are skipped, one pair of quotes around a value goes."""
    out = {}
    for line in map(str.strip, text.splitlines()):
        if m := re.fullmatch(r"([A-Z][A-Z0-9_]*)=(.*)", line):
            value = m[2]
            out[m[1]] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def merge_overrides(given: object, defaults: dict, prefix: str = "") -> dict:
    """Defaults with overrides of the same shape; an unknown key or another type is an error."""
    if not isinstance(given, dict):
        raise ValueError(f"{prefix or 'config'} must be an object")
    out = dict(defaults)
    for key, value in given.items():
        name = f"{prefix}.{key}" if prefix else key
        if key not in defaults:
            raise ValueError(f"unknown config key: {name}")
        known = defaults[key]
        if isinstance(known, dict):
            value = merge_overrides(value, known, name)
        elif isinstance(known, list):
            if not isinstance(value, list) or not all(isinstance(x, str) and x.strip() for x in value):
                raise ValueError(f"{name} must contain non-empty strings")
        elif isinstance(known, bool) != isinstance(value, bool) or not isinstance(value, (int, float) if isinstance(known, (int, float)) else type(known)) or value == "" or (isinstance(value, str) and not value.strip()):
            raise ValueError(f"{name} must be a {type(known).__name__}")
        out[key] = value
    return out


def read_approval(path: str) -> dict | None:
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        value = json.load(f)
    if not isinstance(value, dict):
        raise ValueError(f"import approval is not an object: {path}")
    return value


def check_approval(approval: dict | None, provider: str | None, model: str | None) -> dict:
    """The approval, if it allows imports with the active provider and model."""

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise PermissionError(f"import is paused: {what}")

    def number(name: str, low: float, high: float = math.inf, *, above: bool = False) -> bool:
        v = approval.get(name)
        fine = isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)
        return v is None and name not in ("maxEstimatedCostUsd",) or fine and (v > low if above else v >= low) and v <= high

    need(approval is not None, "no approval")
    need(bool(provider) and provider not in ("unknown", "none"), "no active provider")
    need(approval.get("provider") == provider, "another provider is approved")
    need(approval.get("model") in (model, "*"), "another model is approved")
    need(approval.get("privacy") in ("remote-redacted", "local"), "privacy must be remote-redacted or local")
    try:
        datetime.fromisoformat(str(approval.get("approvedAt")))
    except ValueError:
        need(False, "approvedAt must be an ISO date")
    need("maxEstimatedInputTokens" in approval and number("maxEstimatedInputTokens", 0, above=True), "maxEstimatedInputTokens must be positive or null")
    need(number("maxEstimatedCostUsd", 0), "maxEstimatedCostUsd must not be negative")
    for name in ("inputUsdPerMillionTokens", "outputUsdPerMillionTokens", "outputTokenMultiplier", "minFreeBytes"):
        need(number(name, 0), f"{name} must not be negative")
    need(number("maxFailureRate", 0, 1, above=True), "maxFailureRate must be in (0, 1]")
    return approval


def processing_signature(excluded_labels: Iterable[str]) -> str:
    """What a session was processed under; another signature has it processed again."""
    labels = json.dumps(sorted(map(normalize_label, excluded_labels)), ensure_ascii=False, separators=(",", ":"))
    return f"{SCHEMA}|{ADAPTERS}|{REDACTION}|classification:{CLASSIFICATION}|retain:{RETAIN}|exclusions:{labels}"


def retry_after_ms(value: str | None, now: datetime | None = None) -> int | None:
    """Milliseconds that a Retry-After header asks for: seconds or a date; None if it is neither."""
    if not value:
        return None
    try:
        seconds = float(value)
        return max(0, round(seconds * 1000)) if math.isfinite(seconds) else None
    except ValueError:
        pass
    try:
        at = parsedate_to_datetime(value)
    except (TypeError, ValueError):
        return None
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    return max(0, int(((at - (now or datetime.now(UTC))).total_seconds()) * 1000))


def retry_delay_ms(attempt: int, status: int | None, retry_after: str | None = None, base_ms: int = 500, most_ms: int = 30_000, left_ms: int | None = None) -> int | None:
    """Wait before the next attempt (``attempt`` counts from 0); None if the reply is final.

    No status is a failed transport.  Delays double, a rate limit names its own, and none
    is longer than the limit or the time left.
    """
    if status is not None and status not in RETRYABLE:
        return None
    wait = base_ms * 2**attempt
    if status == 429:
        asked = retry_after_ms(retry_after)
        wait = RATE_LIMIT_MS if asked is None else asked
    return min(wait, most_ms, *([max(0, left_ms)] if left_ms is not None else []))
