"""Session classification: one table of rules a source, for Columns and for single sessions."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rules in order; a rule holds if all of its flags do.  What none names is primary.
RULES: dict[str, tuple[tuple[tuple[str, ...], str, str], ...]] = {
    "pi": (
        (("nested", "legacy"), "subagent", "pi-child-layout-and-session-info-subagent-name"),
        (("parent", "generated"), "subagent", "pi-parent-session-and-generated-agent-name"),
        (("parent", "legacy"), "subagent", "pi-parent-session-and-session-info-subagent-name"),
        (("parent", "task"), "subagent", "pi-parent-session-and-task-child-layout"),
        (("parent",), "ambiguous", "pi-parent-session-without-agent-marker"),
        (("nested",), "ambiguous", "pi-child-layout-without-subagent-name"),
        (("legacy",), "ambiguous", "pi-agent-name-without-child-marker"),
        (("generated",), "ambiguous", "pi-agent-name-without-child-marker"),
        ((), "primary", "pi-primary-session"),
    ),
    "codex": (
        (("unrecognized",), "ambiguous", "codex-unrecognized-session-metadata"),
        (("explicit",), "subagent", "codex-explicit-subagent-thread-source"),
        (("marked",), "ambiguous", "codex-incomplete-subagent-marker"),
        (("object_source",), "ambiguous", "codex-unrecognized-object-source"),
        (("odd_thread",), "ambiguous", "codex-unrecognized-thread-source"),
        (("odd_source",), "ambiguous", "codex-unrecognized-source"),
        ((), "primary", "codex-primary-session"),
    ),
    "claude": (
        (("sidechain",), "subagent", "claude-explicit-sidechain"),
        (("agent", "placed"), "subagent", "claude-agent-id-and-agent-path"),
        (("agent",), "ambiguous", "claude-incomplete-sidechain-marker"),
        (("placed",), "ambiguous", "claude-incomplete-sidechain-marker"),
        ((), "primary", "claude-primary-session"),
    ),
    "opencode": (
        (("incapable",), "ambiguous", "opencode-missing-classification-columns"),
        (("parent", "generated"), "subagent", "opencode-parent-and-generated-subagent-title"),
        (("parent",), "ambiguous", "opencode-parent-without-generated-subagent-title"),
        (("generated",), "ambiguous", "opencode-generated-subagent-title-without-parent"),
        ((), "primary", "opencode-root-session"),
    ),
}
# Names and places that mark an agent's session; all but the layout in any case.
LEGACY_NAME, GENERATED_NAME, GENERATED_TITLE = r"\Asubagent-", r"\A[a-z][a-z0-9_-]*#[0-9a-f]{8}\Z", r" \(@[^()]+ subagent\)\Z"
CHILD_LAYOUT, TASK_LAYOUT, AGENT_FILE = r"\A[^/]+/(?:.*/)?run-\d+/session\.jsonl\Z", r"(?:\A|/)tasks(?:/|\Z)", r"(?:\A|/)agent-[^/]*\Z"


def verdict(source: str, flags: Mapping[str, object]) -> tuple[str, str]:
    """Kind and reason of one session."""
    return next((kind, reason) for names, kind, reason in RULES[source] if all(flags[n] for n in names))


def _by_rules(source: str, flags: Mapping[str, Column]) -> Column:
    out = None
    for names, kind, reason in RULES[source]:
        made = F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))
        if not names:
            return out.otherwise(made)
        test = F.lit(True)
        for n in names:
            test = test & F.coalesce(flags[n], F.lit(False))
        out = (F if out is None else out).when(test, made)
    return out


def _found(pattern: str, text: Column, *, any_case: bool = True) -> Column:
    return F.rlike(text, F.lit(("(?i)" if any_case else "") + pattern.replace(r"\Z", r"\z")))


def found(pattern: str, text: str | None, *, any_case: bool = True) -> bool:
    return bool(text and re.search(pattern, text, re.I if any_case else 0))


def pi(relative_path: Column, name: Column, parent: Column) -> Column:
    """By folder layout, session name and parent session."""
    return _by_rules("pi", {"legacy": _found(LEGACY_NAME, name), "generated": _found(GENERATED_NAME, name), "nested": _found(CHILD_LAYOUT, relative_path, any_case=False), "task": _found(TASK_LAYOUT, relative_path, any_case=False), "parent": parent.isNotNull()})


def codex(recognized: Column, explicit: Column, parent: Column, role: Column, nickname: Column, object_source: Column, thread_source: Column, source_name: Column) -> Column:
    return _by_rules("codex", {"unrecognized": ~recognized, "explicit": explicit, "marked": parent.isNotNull() | role.isNotNull() | nickname.isNotNull(), "object_source": object_source, "odd_thread": thread_source != "user", "odd_source": ~source_name.isin("exec", "cli")})


def claude(path: Column, sidechain: Column, agent: Column) -> Column:
    return _by_rules("claude", {"sidechain": sidechain, "agent": agent.isNotNull(), "placed": _found(AGENT_FILE, path, any_case=False) | F.lower(path).contains("/subagents/")})


def opencode(capable: Column, parent: Column, title: Column) -> Column:
    return _by_rules("opencode", {"incapable": ~capable, "parent": parent.isNotNull(), "generated": _found(GENERATED_TITLE, title)})


def _kind(kind: str, reason: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))


def effective(structural: Column, label: Column, excluded_labels: list[str], tombstone: Column) -> Column:
    """Configured exclusion first, then a recorded one, then the structural verdict.  ``label`` is normalized."""
    return (
        F.when(F.coalesce(label.isin(excluded_labels), F.lit(False)), _kind("configured-exclusion", "configured-exact-session-label"))
        .when(F.coalesce(tombstone, F.lit(False)), _kind("configured-exclusion", "persisted-configured-exclusion"))
        .otherwise(structural)
    )


def merged(kinds: Column) -> Column:
    """Fold of (position, kind, reason) structs: equal kinds keep the first, others conflict."""

    def step(done: Column, x: Column) -> Column:
        conflict = F.concat(F.lit("conflicting-artifact-classifications:"), done["kind"], F.lit(":"), x["kind"])
        return F.when(done["kind"].isNull(), F.struct(x["kind"].alias("kind"), x["reason"].alias("reason"))).when(done["kind"] == x["kind"], done).otherwise(F.struct(F.lit("ambiguous").alias("kind"), conflict.alias("reason")))

    return F.aggregate(F.array_sort(kinds), F.expr("cast(struct(null as kind, null as reason) as struct<kind:string,reason:string>)"), step)
