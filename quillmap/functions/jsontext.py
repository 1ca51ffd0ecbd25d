"""JSON texts of any depth: the standard parser, and loops in its place where nesting is too deep for recursion."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)|true|false|null|NaN|-?Infinity")


def parse(text: str):
    """The value of a JSON text; ValueError if it isn't one."""
    try:
        return json.loads(text)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str):
    """A loop over tokens with the open containers on a stack; ``place`` is what may come next."""
    stack: list[tuple[list | dict, str | None]] = []
    at, place, value, key = 0, "value", None, None
    while True:
        at = _SPACE.match(text, at).end()
        c = text[at : at + 1]
        if place == "done":
            if c:
                raise ValueError(f"more text at {at}")
            return value
        if place in ("value", "first") and c and c in "[{":
            stack.append(([] if c == "[" else {}, key))
            at, place, key = at + 1, "first" if c == "[" else "first key", None
            continue
        if place in ("first key", "key"):
            if c == '"':
                key, at = scanstring(text, at + 1, True)
                at = _SPACE.match(text, at).end()
                if text[at : at + 1] != ":":
                    raise ValueError(f"no colon at {at}")
                at, place = at + 1, "value"
                continue
            if c != "}" or place == "key":
                raise ValueError(f"no key at {at}")
        if c in ("]", "}") and c and place in ("first", "first key", "end") and stack and isinstance(stack[-1][0], list if c == "]" else dict):
            (value, key), at = stack.pop(), at + 1
        elif place == "end" and c == ",":
            at, place = at + 1, "value" if isinstance(stack[-1][0], list) else "key"
            continue
        elif place in ("value", "first") and c == '"':
            value, at = scanstring(text, at + 1, True)
        elif place in ("value", "first") and (found := _ATOM.match(text, at)):
            value, at = json.loads(found.group()), found.end()
        else:
            raise ValueError(f"nothing known at {at}")
        if not stack:
            place = "done"
            continue
        inside = stack[-1][0]
        if isinstance(inside, list):
            inside.append(value)
        else:
            inside[key] = value
        key, place = None, "end"


def canonical(value) -> str | None:
    """A text that is equal for equal values: numbers by value, members in order of their names; None for null."""
    if value is None or isinstance(value, str):
        return value
    out: list[str] = []
    stack: list = [(False, value)]
    while stack:
        done, v = stack.pop()
        if done:
            out.append(v)
        elif isinstance(v, (list, dict)):
            inner: list = []
            for n, x in enumerate(v if isinstance(v, list) else sorted(v.items())):
                head = "," if n else ""
                if isinstance(v, dict):
                    head, x = f"{head}{json.dumps(x[0])}:", x[1]
                inner += [(True, head), (False, x)]
            stack.append((True, "]" if isinstance(v, list) else "}"))
            stack += reversed(inner)
            out.append("[" if isinstance(v, list) else "{")
        else:
            whole = isinstance(v, float) and v.is_integer() and abs(v) < 1e300
            out.append(json.dumps(int(v) if whole else v))
    return "".join(out)
