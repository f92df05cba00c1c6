"""Marks, glosses and raised characters of classical texts, told from the text proper."""

from __future__ import annotations

import functools
import re

#: Ideographs, syllables of the gloss script, and marks (full width, half width, quotation marks).
HAN = "一-鿿㐀-䶿\U00020000-\U0002a6df豈-﫿\U0002f800-\U0002fa1f"
HANGUL = "가-힣"
MARKS = "。，；：？！《》〈〉「」『』·" ".,;:?!()" "“”‘’"
#: Letters of a gloss, spaces of a raised character, and letters of its context at most.
GLOSS, RAISED, CONTEXT = 4, 3, 10
WIDE = str.maketrans(".,;:?!", "。，；：？！")

_RAISED = re.compile(rf"^( {{1,{RAISED}}})([{HAN}])", re.M)
_HAN_LAST = re.compile(rf"[{HAN}]\Z")


@functools.cache
def _patterns(marks: str, take_marks: bool, take_glosses: bool) -> tuple[re.Pattern, re.Pattern]:
    """Runs of a text by kind; a gloss that stands between an ideograph and what may follow it."""
    mark = f"[{re.escape(marks)}]" if marks and take_marks else r"(?!)"
    gloss = f"[{HANGUL}]+" if take_glosses else r"(?!)"
    apart = f"{re.escape(marks) if take_marks else ''}{HANGUL if take_glosses else ''} \\n\\r\\t"
    follow = f"[{HAN}{re.escape(marks)} \\n]"
    return re.compile(rf"(?P<mark>{mark})|(?P<gloss>{gloss})|(?P<text>[^{apart}]+)|[ \n\r\t]+"), re.compile(rf"(?<=[{HAN}])[{HANGUL}]{{1,{GLOSS}}}(?=\Z|{follow})")


def find_glosses(text: str, marks: str = MARKS) -> list[tuple[int, str, str, str]]:
    """(place, gloss, letter before, letter behind) of the glosses: up to GLOSS syllables after an ideograph, before
    another one, a mark, a space, a line break or the end; longer stretches of syllables are none."""
    return [(m.start(), m[0], text[m.start() - 1], text[m.end() : m.end() + 1]) for m in _patterns(marks, True, True)[1].finditer(text)]


def raised(text: str) -> list[tuple[int, int, str, str]]:
    """(place, spaces, letter, context) of ideographs raised by 1 to RAISED spaces at the beginning of a line."""
    return [(m.start(), len(m[1]), m[2], text[m.end(1) : m.end(1) + CONTEXT].split("\n")[0]) for m in _RAISED.finditer(text)]


def clean(text: str, marks: str = MARKS, take_marks: bool = True, take_glosses: bool = True) -> dict:
    """The text proper, and marks and glosses with the place of the letter of it that they stand behind (0 at the
    beginning). Syllables are glosses where the letter before them in the text proper is an ideograph, in pieces of up
    to GLOSS; else they are text themselves."""
    out, size, on_han = [], 0, False
    found, glosses = [], []
    if text.strip():
        for run in _patterns(marks, take_marks, take_glosses)[0].finditer(text):
            kind, at, part = run.lastgroup, max(0, size - 1), run[0]
            if kind == "mark":
                found.append({"pos": at, "text": part.translate(WIDE), "original": part})
            elif kind == "gloss" and on_han:
                glosses += [{"pos": at, "text": part[i : i + GLOSS]} for i in range(0, len(part), GLOSS)]
            elif kind:
                out.append(part)
                size += len(part)
                on_han = bool(_HAN_LAST.search(part))
    lifted = [{"raw_pos": i, "spaces": n, "letter": c, "context": around} for i, n, c, around in raised(text)] if size or found else []
    return {"clean": "".join(out), "marks": found, "glosses": glosses, "raised": lifted}
