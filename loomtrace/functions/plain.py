"""Scalar functions on Python values, for session parsers and query literals."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import uuid
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

from .constants import CALENDAR, EARLIER, EPOCH, HARNESS_BLOCKS, ID_NAMESPACE, INJECTED_BLOCKS, JS_SPACE, MEMORY_TOOLS, RECENT, REDACTIONS, STOP_WORDS, TEXT_BLOCKS

_TRIM = re.compile(rf"\A{JS_SPACE}+|{JS_SPACE}+\Z")
_INJECTED = [re.compile(p.replace(r"\z", r"\Z"), re.I | re.S) for p in INJECTED_BLOCKS]
_HARNESS = [re.compile(p, re.I | re.S) for p in HARNESS_BLOCKS]
_RULES = [(name, re.compile(p, sum({"i": re.I, "m": re.M, "s": re.S}[f] for f in flags)), to) for name, flags, p, to, _ in REDACTIONS]


def trim(text: str) -> str:
    return _TRIM.sub("", text)


def text_or_none(value: object) -> str | None:
    """A string with something besides white space, trimmed."""
    return trim(value) or None if isinstance(value, str) else None


def normalize_text(text: str) -> str:
    return trim(text.replace("\r\n", "\n").replace("\r", "\n"))


def strip_injected(text: str) -> str:
    for p in _INJECTED:
        text = p.sub("", text)
    return trim(re.sub(r"\n{3,}", "\n\n", text))


def strip_harness(text: str) -> str:
    for p in _HARNESS:
        text = p.sub("", text)
    return trim(text)


def redact(text: str) -> tuple[str, int, list[str]]:
    """Redacted text, effective replacements, and names of the rules that made them."""
    text, n, names = text.replace("\r\n", "\n").replace("\r", "\n"), 0, []
    for name, pattern, template in _RULES:

        def put(m: re.Match, name=name, template=template) -> str:
            nonlocal n
            if name == "SECRET_ASSIGNMENT":
                if "[REDACTED:" in m[5]:
                    return m[0]
                quote = m[5][0] if m[5][0] in "\"'" else ""
                out = f"{m[1]}{m[2]}{m[3]}{m[4]}{quote}[REDACTED:SECRET]{quote}"
            else:
                out = re.sub(r"\$(\d)", lambda g: m[int(g[1])] or "", template)
            if out != m[0]:
                n += 1
                if name not in names:
                    names.append(name)
            return out

        text = pattern.sub(put, text)
    return text, n, names


def shorten(text: str, limit: int = 800) -> str:
    """Redacted one-line text of at most ``limit`` bytes, or one byte less and an ellipsis."""
    text = trim(re.sub(rf"{JS_SPACE}+", " ", redact(text)[0].replace("\n", " ")))
    if len(text.encode()) <= limit:
        return text
    return text.encode()[: limit - 1].decode("utf-8", "ignore") + "…"


def action_text(tool: object, given: object) -> str:
    """What a tool call did, in a few words."""
    name, args = text_or_none(tool) or "unknown tool", given if isinstance(given, dict) else {}
    pick = lambda *keys: next((shorten(t) for k in keys if (t := text_or_none(args.get(k)))), None)
    path, command, query, url = pick("path", "file_path", "filePath"), pick("command", "cmd"), pick("query", "pattern", "search"), pick("url", "uri")
    verbs = (
        (("read", "cat", "view_file"), "Read", path, ""),
        (("write", "edit", "apply_patch", "patch"), "Write" if name == "write" else "Edit", path, ""),
        (("bash", "shell", "command", "terminal", "exec", "run_command"), "Run", command, " shell command"),
        (("grep", "rg", "search", "find", "glob"), "Search", query, ""),
        (("web_fetch", "fetch", "browser", "open_url"), "Fetch", url, " URL"),
    )
    for names, verb, target, without in verbs:
        if name.lower() in names:
            return verb + (f" {target}" if target is not None else without)
    if name.lower() in MEMORY_TOOLS:
        return "Search prior memory"
    target = next((t for t in (path, command, query, url) if t is not None), None)
    return f"Use {shorten(name)}" if target is None else f"{name} {target}"


def text_parts(content: object) -> list[str]:
    if isinstance(content, str):
        content = [content]
    parts = []
    for block in content if isinstance(content, list) else []:
        if isinstance(block, dict) and block.get("type") in TEXT_BLOCKS:
            block = block.get("text")
        if isinstance(block, str) and trim(block):
            parts.append(block)
    return parts


def _first(*values: object) -> object:
    return next((v for v in values if v is not None), None)


def tool_blocks(content: object) -> list[tuple[str, object]]:
    """(name, input) of the tool and function blocks of a message."""
    found = []
    for block in content if isinstance(content, list) else []:
        kind = block.get("type") if isinstance(block, dict) else None
        if not isinstance(kind, str) or not re.search("tool|function", kind, re.I):
            continue
        inner = block.get("function") if isinstance(block.get("function"), dict) else {}
        name = _first(block.get("name"), block.get("toolName"), block.get("tool_name"), inner.get("name"))
        given = _first(block.get("input"), block.get("arguments"), block.get("parameters"), inner.get("arguments"))
        if isinstance(given, str):
            try:
                given = json.loads(given)
            except ValueError:
                pass
        if isinstance(name, str):
            found.append((name, given))
    return found


def calls_memory(content: object) -> bool:
    """Does any block name the memory search, in any case?"""
    for block in content if isinstance(content, list) else []:
        if isinstance(block, dict):
            inner = block.get("function") if isinstance(block.get("function"), dict) else {}
            name = _first(block.get("name"), block.get("toolName"), block.get("tool_name"), inner.get("name"))
            if isinstance(name, str) and name.lower() == "memory_search":
                return True
    return False


def iso(value: object, fallback: str) -> str:
    """ISO-8601 UTC with milliseconds; numbers below 1e10 are seconds, else milliseconds."""
    try:
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            at = datetime.fromtimestamp(value if value < 1e10 else value / 1000, UTC)
        elif isinstance(value, str):
            try:
                at = datetime.fromisoformat(value)
            except ValueError:
                at = parsedate_to_datetime(value)
            at = at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)
        else:
            return fallback
    except (ValueError, TypeError, OverflowError, OSError):
        return fallback
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def file_timestamp(source: str, name: str) -> str:
    """Start of a session from its file name, else the epoch."""
    if source == "pi" and (m := re.match(r"(\d{4}-\d\d-\d\dT)(\d\d)-(\d\d)-(\d\d)-(\d{3})Z", name)):
        return f"{m[1]}{m[2]}:{m[3]}:{m[4]}.{m[5]}Z"
    if source == "codex" and (m := re.search(r"rollout-(\d{4}-\d\d-\d\d)T(\d\d)-(\d\d)-(\d\d)-[0-9a-f-]{20,}\.jsonl$", name, re.I)):
        return f"{m[1]}T{m[2]}:{m[3]}:{m[4]}Z"
    if source == "claude" and (m := re.match(r"(\d{4}-\d\d-\d\d)", name)):
        return f"{m[1]}T00:00:00.000Z"
    return EPOCH


def document_id(source: str, session: str) -> str:
    return f"agent-session:{source}:{session}"


def fallback_id(source: str, key: str, started: str) -> str:
    return "fallback-" + hashlib.sha256(f"{source}\n{key}\n{started}".encode()).hexdigest()[:32]


def operation_id(*parts: str) -> str:
    return str(uuid.uuid5(uuid.UUID(ID_NAMESPACE), "\n".join(parts)))


def nfkc_lower(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower()


def normalize_label(text: str) -> str:
    return trim(unicodedata.normalize("NFKC", text)).lower()


def query_terms(query: str) -> list[str]:
    words = re.findall(r"[\w-]+", nfkc_lower(query))
    return list(dict.fromkeys(w for w in words if len(w) > 1 and w not in STOP_WORDS))[:16]


def explicit_terms(query: str) -> list[str]:
    """Terms written as names, or with three digits in a row."""
    names = {w.lower() for w in re.findall(r"\b[A-Z][A-Za-z0-9_-]+\b", query, re.A)} - CALENDAR
    return [t for t in query_terms(query) if t in names or re.search(r"\d{3}", t, re.A)]


def wants_recent(query: str) -> bool:
    return bool(re.search(RECENT, query, re.I | re.A)) and not re.search(EARLIER, query, re.I | re.A)


def canonical_line(turn: dict) -> str:
    """One line of a canonical document: fixed key order, absent fields left out."""
    keys = ("role", "content", "timestamp", "native_entry_id", "parent_entry_id", "provenance")
    return json.dumps({k: turn[k] for k in keys if turn.get(k) is not None}, ensure_ascii=False, separators=(",", ":"))
