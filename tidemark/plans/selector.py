"""Selector strings: ``{a="x", b!~"y"}``, ``name{...}`` and bare names."""

from __future__ import annotations

import re

from .model import EQ, Matcher, QueryError, Selector

_PART = re.compile(r"""\s*([A-Za-z_:][A-Za-z0-9_:.-]*)\s*(=~|!~|!=|=)\s*"((?:[^"\\]|\\.)*)"\s*(,|$)""", re.S)
_NAME = re.compile(r"[A-Za-z_:][A-Za-z0-9_:.-]*\Z")


def parse(text: str) -> Selector:
    """Quotes may hold commas, braces and operators; ``\\"`` and ``\\\\`` stand for the character after the backslash."""
    text = text.strip()
    head, brace, rest = text.partition("{")
    head = head.strip()
    if not text or (head and not _NAME.match(head)) or (brace and not rest.endswith("}")):
        raise QueryError(f"not a selector: {text!r}")
    found = [Matcher(EQ, "__name__", head)] if head else []
    body, at = rest[:-1] if brace else "", 0
    while body[at:].strip():
        part = _PART.match(body, at)
        if not part:
            raise QueryError(f"not a matcher: {body[at:]!r}")
        name, op, value, _ = part.groups()
        found.append(Matcher(op, name, re.sub(r"\\(.)", r"\1", value, flags=re.S)))
        at = part.end()
    return Selector(tuple(found))
