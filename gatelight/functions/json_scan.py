"""Finding JSON in free text in one pass: a scanner without recursion."""

from __future__ import annotations

import json
import re

#: Values nested deeper than this are no replies.
MOST_DEPTH = 500
_SPACE = r"[ \t\n\r]*"
_STRING = r'"[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*"'
_PLAIN = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null|NaN|-?Infinity"
_TOKEN = re.compile(f"{_SPACE}(?:(?P<sign>[][{{}}:,])|(?P<string>{_STRING})|(?P<plain>{_PLAIN}))")
# What may come next: a value, a value or the end of an array, a key, a key or the end of an object, a colon, a comma or an end.
_VALUE, _VALUE_OR_END, _KEY, _KEY_OR_END, _COLON, _COMMA_OR_END = range(6)


def _scan(text: str, at: int, closed: dict[int, tuple[int, int]], open_: set[int]) -> None:
    """Reads the value that starts with a bracket at ``at``, up to its end or to the first thing that does not fit.

    Every bracket opened on the way ends up in ``closed`` (start -> end, height) or in
    ``open_``; what failed here fails for those left open just as well.
    """
    stack: list[list] = []  # start, its sign, height so far
    want = _VALUE
    while True:
        token = _TOKEN.match(text, at)
        if token is None:
            break
        at, sign = token.end(), token["sign"]
        if sign in ("{", "[") and want in (_VALUE, _VALUE_OR_END):
            stack.append([at - 1, sign, 1])
            want = _KEY_OR_END if sign == "{" else _VALUE_OR_END
        elif (sign == "}" and stack[-1][1] == "{" and want in (_KEY_OR_END, _COMMA_OR_END)) or (sign == "]" and stack[-1][1] == "[" and want in (_VALUE_OR_END, _COMMA_OR_END)):
            start, _, height = stack.pop()
            closed[start] = at, height
            if not stack:
                return
            stack[-1][2] = max(stack[-1][2], height + 1)
            want = _COMMA_OR_END
        elif sign == "," and want == _COMMA_OR_END:
            want = _KEY if stack[-1][1] == "{" else _VALUE
        elif sign == ":" and want == _COLON:
            want = _VALUE
        elif token["string"] is not None and want in (_KEY, _KEY_OR_END):
            want = _COLON
        elif sign is None and want in (_VALUE, _VALUE_OR_END):
            want = _COMMA_OR_END
        else:
            break
    open_.update(start for start, _, _ in stack)


def _decoded(text: str) -> tuple[bool, object]:
    try:
        return True, json.loads(text)
    except (ValueError, RecursionError):
        return False, None


def first_json(text: str) -> str | None:
    """The text's JSON: the whole of it, else its first object, else its first array. None where it holds none.

    No place is read again as part of a value that failed, so the time grows with the length
    of the text; only a bracket inside a string of a failed value is tried by itself.
    """
    text = text.strip()
    sound, value = _decoded(text)
    closed: dict[int, tuple[int, int]] = {}
    open_: set[int] = set()
    for sign in "{[" if not sound else "":
        at = text.find(sign)
        while at >= 0 and not sound:
            if at not in open_ and at not in closed:
                _scan(text, at, closed, open_)
            end, height = closed.get(at, (0, 0))
            if end and height <= MOST_DEPTH:
                sound, value = _decoded(text[at:end])
            at = text.find(sign, at + 1)
    return json.dumps(value, ensure_ascii=False) if sound else None
