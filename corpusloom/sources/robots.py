"""robots.txt: parsed once on the driver, applied as a column."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def rules(text: str, agent: str) -> list[tuple[bool, str]]:
    """(allowed, pattern) of the group for ``agent``: the first named group within the agent's name, else that of *.

    Of successive agent lines the last one owns the rules that follow; a group may be continued later.
    """
    groups: dict[str, list[tuple[bool, str]]] = {}
    held: list[tuple[bool, str]] = []
    for line in text.splitlines():
        name, sign, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not sign:
            continue
        if name == "user-agent":
            held = groups.setdefault(value.lower(), [])
        elif name in ("allow", "disallow"):
            held.append((name == "allow", value))
    agent = agent.lower()
    return next((found for name, found in groups.items() if name != "*" and name in agent), groups.get("*", []))


def load(get: Callable[[str, dict], tuple[int, dict, bytes]], host: str, agent: str) -> list[tuple[bool, str]]:
    """The rules of a host for ``agent`` through ``get``; no rules, so that all is allowed, if there is no file or it fails."""
    try:
        status, _, body = get(f"https://{host}/robots.txt", {"User-Agent": agent})
    except OSError:
        return []
    return rules(body.decode("utf-8", "replace"), agent) if status == 200 else []


def pattern(rule: str) -> str:
    """A rule's pattern as a regular expression: * is any text, a $ at the end is the end."""
    body, end = (rule[:-1], "$") if rule.endswith("$") else (rule, "")
    return "^" + ".*".join(re.sub(r"([.+?^${}()|\[\]\\])", r"\\\1", part) for part in body.split("*")) + end


def allowed(path: Column, found: list[tuple[bool, str]]) -> Column:
    """Whether ``path`` may be fetched: the longest matching pattern decides, allow on a tie, yes without a match."""
    decision = F.lit(True)
    for allow, rule in sorted((r for r in found if r[1]), key=lambda r: (len(r[1]), r[0])):
        decision = F.when(path.rlike(pattern(rule)), F.lit(allow)).otherwise(decision)
    return decision
