"""Recovery of damaged JSON, and text diffs. These need a parser, so they are Arrow-batched Python."""

from __future__ import annotations

import difflib
import json
import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def balanced_object(text: str) -> str | None:
    """The first {...} whose braces balance, strings taken into account."""
    start = text.find("{")
    depth, inside, escaped = 0, False, False
    for i in range(start, len(text)) if start >= 0 else ():
        c = text[i]
        if escaped:
            escaped = False
        elif c == "\\" and inside:
            escaped = True
        elif c == '"':
            inside = not inside
        elif not inside and c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[start : i + 1]
    return None


def _inside_strings(text: str, repair) -> str:
    return re.sub(r'"(?:[^"\\]|\\.)*"', lambda m: repair(m[0]), text, flags=re.DOTALL)


def recover_json(text: str | None) -> str | None:
    """Canonical JSON (sorted keys) of an object in text, or null.

    Tried in turn: the text without code fences; its outermost balanced object; then
    that with trailing commas, bad escapes and raw control characters mended."""
    if not text:
        return None
    bare = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text)
    found = balanced_object(bare)
    tries = [bare, found]
    if found:
        mended = _inside_strings(found, lambda s: re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", s))
        mended = _inside_strings(mended, lambda s: re.sub(r"[\x00-\x1f]", lambda c: json.dumps(c[0])[1:-1], s))
        tries.append(re.sub(r",(\s*[}\]])", r"\1", mended))
    for candidate in tries:
        try:
            value = json.loads(candidate) if candidate else None
        except ValueError:
            continue
        if isinstance(value, dict):
            return json.dumps(value, sort_keys=True, ensure_ascii=False)
    return None


def diff(before: str | None, after: str | None) -> str:
    """A unified diff of two texts, empty if they are equal."""
    return "".join(difflib.unified_diff((before or "").splitlines(True), (after or "").splitlines(True), "before", "after"))


def patch(content: str, change: str) -> str | None:
    """content with a unified diff applied, null if a hunk's old lines are nowhere. A hunk is
    looked for from its stated line outwards, so shifted texts still take it."""
    lines, shift = content.splitlines(True), 0
    hunks: list[tuple[int, list[str], list[str]]] = []
    for line in change.splitlines(True):
        if m := re.match(r"@@ -(\d+)(?:,\d+)? \+\d+(?:,\d+)? @@", line):
            hunks.append((int(m[1]), [], []))
        elif hunks and line[:1] in (" ", "-", "+"):
            if line[0] != "+":
                hunks[-1][1].append(line[1:])
            if line[0] != "-":
                hunks[-1][2].append(line[1:])
    for at, old, new in hunks:
        start = max(0, at - 1) + shift
        spots = sorted(range(len(lines) - len(old) + 1), key=lambda i, s=start: (abs(i - s), i))
        spot = next((i for i in spots if lines[i : i + len(old)] == old), None)
        if spot is None:
            return None
        lines[spot : spot + len(old)] = new
        shift += len(new) - len(old)
    return "".join(lines)


@pandas_udf(StringType())
def recover_json_udf(text: pd.Series) -> pd.Series:
    return text.map(recover_json, na_action=None)


@pandas_udf(StringType())
def diff_udf(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([diff(a, b) for a, b in zip(before, after, strict=True)])
