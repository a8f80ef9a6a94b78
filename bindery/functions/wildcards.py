"""Shell wildcards and ignore rules as regular expressions."""

from __future__ import annotations


def class_end(glob: str, start: int) -> int:
    """Where the character class opened at ``start`` closes, or -1; a first ``]`` is a member."""
    first = start + 1 + (glob[start + 1 : start + 2] in ("!", "^"))
    return glob.find("]", first + 1)


def check_ranges(body: str) -> None:
    """Raise ``ValueError`` for a range that runs backwards, such as ``z-a``."""
    i = 0
    while i < len(body):
        if body[i + 1 : i + 2] == "-" and i + 2 < len(body):
            if body[i] > body[i + 2]:
                raise ValueError(f"bad range {body[i : i + 3]}")
            i += 2
        i += 1


def segment_regex(glob: str, any_char: str) -> str:
    """One name or path segment; ``any_char`` is what ``?`` and ``*`` may stand for."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        close = class_end(glob, i) if ch == "[" else -1
        if ch == "*":
            out.append(any_char + "*")
        elif ch == "?":
            out.append(any_char)
        elif ch == "[" and close > 0:
            body = glob[i + 1 : close]
            invert = body[0] in "!^"
            body = body[1:] if invert else body
            check_ranges(body)
            for special in "\\[]&^":
                body = body.replace(special, "\\" + special)
            out.append(f"[{'^' if invert else ''}{body}]")
            i = close
        else:
            if ch == "\\" and i + 1 < len(glob):
                i += 1
                ch = glob[i]
            out.append(ch if ch.isalnum() or ch in "_ /" else "\\" + ch if ch.isascii() else ch)
        i += 1
    return "".join(out)


def rule_regex(line: str) -> tuple[str, bool] | None:
    """An ignore-file line as ``(regex over the relative path, negated)``.

    The file-level rules are git's: ``#`` comments, ``!`` keeps, a slash at the
    start or inside anchors the rule to the root, a slash at the end means
    folders only, ``**`` spans folders. A matching folder covers all below it.
    A rule that cannot be read raises ``ValueError``.
    """
    rule = line.rstrip("\r\n")
    while rule.endswith(" ") and not rule.endswith("\\ "):
        rule = rule[:-1]
    if not rule or rule.startswith("#"):
        return None
    negated = rule.startswith("!")
    rule = rule[1:] if negated else rule
    folders_only = rule.endswith("/")
    anchored = "/" in rule[:-1]
    parts = [p for p in rule.split("/") if p]
    if not parts:
        return None
    out = [] if anchored or parts[0] == "**" else ["(?:.*/)?"]
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out.append(".+" if last else "(?:.*/)?")
        else:
            out.append(segment_regex(part, "[^/]") + ("" if last else "/"))
    tail = "/.*" if folders_only else "(?:/.*)?"
    return r"(?s)\A" + "".join(out) + tail + r"\z", negated
