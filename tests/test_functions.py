import pandas as pd
import pytest

from inkwell import functions
from inkwell.functions import plugins


def test_kernels_work_in_sql(spark):
    assert "align_chars" in functions.register(spark)
    row = spark.sql("SELECT similarity('abcd', 'abxd') AS r, nfc('é') AS n, size(align_chars('ab', 'b')) AS k").first()
    assert (row.r, row.n, row.k) == (0.75, "é", 2)


def test_engines_fall_back_and_isolate_errors(spark):
    def picky(prompts: pd.Series) -> pd.Series:
        if (prompts == "bad").any():
            raise ValueError("bad prompt")
        return prompts.map(lambda p: None if p == "skip" else f"picky {p}")

    registry = plugins.Registry()
    registry.add("picky", picky)
    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "skip")], "id long, prompt string").coalesce(1)
    alone = {r.id: r for r in plugins.ask(df, "id", "prompt", registry.choose("picky")).collect()}
    assert alone[1].answer == "picky ok" and alone[2].error == "ValueError: bad prompt" and alone[3].answer is None
    registry.add("echo", plugins.echo)
    both = {r.id: (r.answer, r.engine, r.error) for r in plugins.ask(df, "id", "prompt", registry.choose()).collect()}
    assert both == {1: ("picky ok", "picky", None), 2: ("BAD", "echo", None), 3: ("SKIP", "echo", None)}
    assert plugins.compare(df.where("id = 1"), "id", "prompt", registry.choose()).first().asDict() == {"id": 1, "picky": "picky ok", "echo": "OK"}
    with pytest.raises(KeyError):
        registry.choose("none")
    with pytest.raises(ValueError):
        registry.add("echo", plugins.echo)
