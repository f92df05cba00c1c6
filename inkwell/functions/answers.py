"""JSON out of what models answer: whole, wrapped in talk, or cut off."""

from __future__ import annotations

import json
import re

_THINKING = re.compile(r"<think>.*?</think>", re.S)
#: What moves a scan of JSON up or down a level; strings are passed over whole.
_STEP = re.compile(r'"(?:[^"\\]|\\.)*"|[][{}]', re.S)


def body_of(raw: str) -> str:
    """An answer without thinking, and without what stands around its first fenced block."""
    text = _THINKING.sub("", raw.strip()).strip()
    around = text.split("```")
    return around[1].strip().removeprefix("json").strip() if len(around) > 2 else text


def whole_items(text: str, begin: int) -> list[dict]:
    """The objects of the array that begins at `begin`, up to its end or the first that is cut off or broken."""
    items, depth, opened = [], 0, 0
    for step in _STEP.finditer(text, begin):
        if step[0] in ("[", "{"):
            depth += 1
            if depth == 2:
                opened = step.start()
        elif step[0] in ("]", "}"):
            depth -= 1
            if depth == 0:
                break
            if depth == 1 and text[opened] == "{":
                try:
                    items.append(json.loads(text[opened : step.end()], strict=False))
                except ValueError:
                    break
    return items


def array_under(text: str, key: str) -> int:
    """Where the first array under a key begins, at whatever depth the key is; -1 if there is none."""
    found = re.search(rf'"{re.escape(key)}"\s*:\s*\[', text)
    return found.end() - 1 if found else -1


def salvage(raw: str | None, keys: list[str]) -> str | None:
    """The value in an answer, as JSON: all of it, else its last object (from the last brace before a quote to the last
    closing one), else {key: items} with the whole objects of the array under the first of `keys` that has any, else of
    an array before any object. Strings may hold raw line breaks and tabs where nothing else can be read. Null where there is no
    object at all."""
    text = body_of(raw or "")
    if "{" not in text:
        return None
    begin = text.rfind('{"') if '{"' in text else text.find("{")
    for strict in (True, False):
        for part in (text, text[begin : text.rfind("}") + 1]):
            try:
                return json.dumps(json.loads(part, strict=strict), ensure_ascii=False)
            except ValueError:
                pass
        for key in keys:
            at = array_under(text, key)
            if at >= 0 and (items := whole_items(text, at)):
                return json.dumps({key: items}, ensure_ascii=False)
        if 0 <= (at := text.find("[")) < text.find("{") and (items := whole_items(text, at)):
            return json.dumps(items, ensure_ascii=False)
    return None
