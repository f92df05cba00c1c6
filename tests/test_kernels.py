"""Kernels on single texts: line differences, answers of models, glosses."""

import itertools
import json
import random

import pytest

from inkwell.functions import glosses as gl
from inkwell.functions.answers import salvage
from inkwell.functions.line_diff import line_operations

KEYS = ["annotations", "marks"]


def scripts(a, b):
    """All scripts of two sequences, each read from the end."""
    if not a and not b:
        yield ()
        return
    if a and b and a[-1] == b[-1]:
        yield from ((("unchanged", a[-1]), *rest) for rest in scripts(a[:-1], b[:-1]))
    if b:
        yield from ((("added", b[-1]), *rest) for rest in scripts(a, b[:-1]))
    if a:
        yield from ((("removed", a[-1]), *rest) for rest in scripts(a[:-1], b))


def test_line_operations_are_the_first_of_the_shortest():
    rank = {"unchanged": 0, "added": 1, "removed": 2}
    for a, b in itertools.product(("".join(x) for n in range(5) for x in itertools.product("xy", repeat=n)), repeat=2):
        best = min(scripts(a, b), key=lambda s: (len(s), [rank[k] for k, _ in s]))
        assert line_operations(list(a), list(b)) == list(best[::-1])


def test_line_operations_of_long_texts_rebuild_both():
    rng = random.Random(4)
    a = [str(rng.randrange(300)) for _ in range(20_000)]
    b = a[:5000] + ["new"] * 30 + a[5100:12_000] + a[12_050:19_000] + a[3000:3100]
    ops = line_operations(a, b)
    assert [x for k, x in ops if k != "added"] == a and [x for k, x in ops if k != "removed"] == b
    assert sum(k == "unchanged" for k, _ in ops) >= 18_850
    assert [k for k, _ in line_operations("1 2 3 x y".split(), "x y 1 . 2 . 3".split())].count("unchanged") == 3


@pytest.mark.parametrize("raw,want", [
    ('{"annotations": []}', {"annotations": []}),
    ('<think>{"marks": [1]}</think>\n```json\n{"marks": [{"start": 1}]}\n``` bye', {"marks": [{"start": 1}]}),
    ('I say {"translation": "x", "notes": "}"} ok', {"translation": "x", "notes": "}"}),
    ('I say {"translation": "x", "notes": {"n": 1}} ok', None),  # the last object is none by itself
    ('{"notes":[1,2],"annotations":[{"h":"a"},{"h":"b"},{"h":"c', {"annotations": [{"h": "a"}, {"h": "b"}]}),
    ('{"x": {"marks" : [ {"a": [1, {"b": "]"}]} , 7, {"a": 2}, {"a"', {"marks": [{"a": [1, {"b": "]"}]}, {"a": 2}]}),
    ('{"annotations": [{"t": "line\nbreak\t"}, {"t": "b"}, {"t', {"annotations": [{"t": "line\nbreak\t"}, {"t": "b"}]}),
    ('{"translation": "a\nb"}', {"translation": "a\nb"}),
    ('{"annotations": [{"h": "a"}, {"h": bad}, {"h": "c"}, {"', {"annotations": [{"h": "a"}]}),
    ('{"other": [{"h": "a"}, {"', None), ("no JSON at all", None), ("", None), (None, None), ("<think>{}</think>", None), ('{"marks": [1, 2, {"', None),
])
def test_answers(raw, want):
    got = salvage(raw, KEYS)
    assert (json.loads(got) if got else None) == want


@pytest.mark.parametrize("text,clean,marks,glosses", [
    ("天地之道。忠恕而已矣，", "天地之道忠恕而已矣", [(3, "。"), (8, "，")], []),
    ("天地之道. 忠恕而已矣, ", "天地之道忠恕而已矣", [(3, "。"), (8, "，")], []),
    ("天地之道는忠恕而已矣니", "天地之道忠恕而已矣", [], [(3, "는"), (8, "니")]),
    ("天地之道는. 忠恕而已矣니，", "天地之道忠恕而已矣", [(3, "。"), (8, "，")], [(3, "는"), (8, "니")]),
    ("夫子之道하니忠恕而已矣니라", "夫子之道忠恕而已矣", [], [(3, "하니"), (8, "니라")]),
    ("，天", "天", [(0, "，")], []), ("하늘 天하", "하늘天", [], [(2, "하")]), ("天1는", "天1는", [], []), ("天 가나다라마", "天", [], [(0, "가나다라"), (0, "마")]),
    ("   \n\n  ", "", [], []), ("", "", [], []), ("\U00020000는", "\U00020000", [], [(0, "는")]),
])
def test_clean(text, clean, marks, glosses):
    got = gl.clean(text)
    assert (got["clean"], [(m["pos"], m["text"]) for m in got["marks"]], [(g["pos"], g["text"]) for g in got["glosses"]]) == (clean, marks, glosses)


def test_clean_may_keep_marks_or_glosses():
    assert gl.clean("天地之道。忠恕", take_marks=False)["clean"] == "天地之道。忠恕" and gl.clean("天地之道는忠恕", take_glosses=False)["clean"] == "天地之道는忠恕"
    assert gl.clean("天。는", take_marks=False)["clean"] == "天。는"  # the mark stands between


def test_glosses_need_something_to_follow():
    found = lambda t: [(i, g) for i, g, *_ in gl.find_glosses(t)]
    assert found("天地之道는忠恕") == [(4, "는")] and found("天가나다라마地") == [] and found("天는abc") == [] and found("天는\t") == []
    assert found("天니라") == [(1, "니라")] and found("天는.\n地도 人은") == [(1, "는"), (5, "도"), (8, "은")] and found("는天") == []
    assert gl.find_glosses("天는。") == [(1, "는", "天", "。")]


def test_raised_letters():
    assert gl.raised("天地之道\n 臣聞天地\n   王\n    四\n 하\n") == [(5, 1, "臣", "臣聞天地"), (11, 3, "王", "王")]
    assert gl.raised("  天" + "地" * 20) == [(0, 2, "天", "天" + "地" * 9)]
    assert [r["spaces"] for r in gl.clean("天地\n 臣聞")["raised"]] == [1] and gl.clean("天地\n 臣聞")["clean"] == "天地臣聞"
