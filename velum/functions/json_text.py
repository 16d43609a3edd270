"""Strings inside JSON texts: where they stand, and texts rewritten in chosen ones with all other bytes as they were."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

Path = tuple[str | int, ...]

_token = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\.)*")|([{}\[\],:])|([^\s{}\[\],:"]+))')
_plain = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\Z|true\Z|false\Z|null\Z")


def string_leaves(text: str) -> list[tuple[Path, int, int]]:
    """(path, start, end) of every string value of a JSON text, keys aside, quotes included; ValueError if it isn't JSON.

    A path holds the keys and indices that lead to the value. Nesting is kept in a list, so its depth doesn't matter.
    """
    out: list[tuple[Path, int, int]] = []
    path: list[str | int] = []
    kinds: list[str] = []
    state, at = "value", 0  # value, item (a value or the end), key, member (a key or the end), colon, after
    while m := _token.match(text, at):
        string, mark, plain = m.groups()
        at = m.end()
        if state in ("value", "item") and not (state == "item" and mark == "]"):
            if mark in ("{", "["):
                kinds.append(mark)
                path.append("" if mark == "{" else 0)
                state = "member" if mark == "{" else "item"
                continue
            if string is not None:
                out.append((tuple(path), m.start(1), m.end(1)))
            elif plain is None or not _plain.match(plain):
                raise ValueError("not a JSON value")
            state = "after"
        elif state in ("key", "member") and string is not None:
            path[-1], state = json.loads(string), "colon"
        elif state == "colon" and mark == ":":
            state = "value"
        elif state == "after" and mark == "," and kinds:
            state = "key" if kinds[-1] == "{" else "value"
            if state == "value":
                path[-1] += 1
        elif kinds and ((kinds[-1] == "{" and mark == "}" and state in ("after", "member")) or (kinds[-1] == "[" and mark == "]" and state in ("after", "item"))):
            kinds.pop()
            path.pop()
            state = "after"
        else:
            raise ValueError("not JSON")
    if state != "after" or kinds or text[at:].strip(" \t\n\r"):
        raise ValueError("not JSON")
    return out


def value(text: str, start: int, end: int) -> str:
    """The string that stands at a place of string_leaves()."""
    return json.loads(text[start:end])


def rewrite(text: str, changed: Mapping[int, str], leaves: list[tuple[Path, int, int]]) -> str:
    """`text` with new strings for the leaves numbered in `changed`."""
    out, last = [], 0
    for n in sorted(changed):
        _, start, end = leaves[n]
        out += [text[last:start], json.dumps(changed[n], ensure_ascii=False)]
        last = end
    return "".join([*out, text[last:]])


def chosen(text: str, leaves: list[tuple[Path, int, int]], shape: str) -> list[int]:
    """Numbers of the leaves that hold text of people, by the `shape` of the JSON.

    request: messages of any role but assistant (their content, or its blocks of type text), and the parts with text of
    contents and of the system instruction; content: the text blocks of one message; all: every string.
    """
    if shape == "all":
        return list(range(len(leaves)))
    about: dict[Path, set[str]] = {}
    for path, a, b in leaves:
        if path and path[-1] in ("type", "role"):
            about.setdefault(path, set()).add(value(text, a, b))

    def block(path: Path) -> bool:
        return len(path) == 2 and isinstance(path[0], int) and path[1] == "text"

    def typed(path: Path) -> bool:
        return "text" in about.get((*path[:-1], "type"), ())

    def asked(path: Path) -> bool:
        match path:
            case ("messages", int(i), "content", *rest):
                own = about.get(("messages", i, "role"), {""})
                return own != {"assistant"} and (not rest or (block(tuple(rest)) and typed(path)))
            case ("contents", int(), "parts", int(), "text") | ("systemInstruction", "parts", int(), "text"):
                return True
        return False

    if shape == "content":
        return [n for n, (path, _, _) in enumerate(leaves) if block(path) and typed(path)]
    if shape != "request":
        raise ValueError(f"unknown shape {shape}")
    return [n for n, (path, _, _) in enumerate(leaves) if asked(path)]
