"""Engines (recognisers, language models, fetchers) behind one seam: a batch of requests in, a batch of answers out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

Engine = Callable[[pd.Series], pd.Series]
ANSWER = "answer string, engine string, error string"


class Registry:
    """Engines by name in order of preference."""

    def __init__(self) -> None:
        self.engines: dict[str, Engine] = {}

    def add(self, name: str, engine: Engine) -> None:
        if name in self.engines:
            raise ValueError(f"engine {name} is registered already")
        self.engines[name] = engine

    def choose(self, forced: str | None = None) -> dict[str, Engine]:
        """The forced engine alone, else all in order."""
        if forced is None:
            return dict(self.engines)
        if forced not in self.engines:
            raise KeyError(f"no engine {forced}; there are {', '.join(self.engines) or 'none'}")
        return {forced: self.engines[forced]}


def ask(requests: DataFrame, key: str, prompt: str, engines: dict[str, Engine]) -> DataFrame:
    """key, answer, engine, error: each request's answer from the first engine that has one.

    An engine answers a batch; where it raises, the batch's rows go to it one by one, so that one bad row costs no
    other. Rows no engine answers keep the last error.
    """
    schema = requests.select(key).schema.simpleString()[7:-1].replace(":", " ") + ", " + ANSWER

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame({key: batch[key], "answer": None, "engine": None, "error": None}, dtype=object)
            for name, engine in engines.items():
                left = out.index[out["answer"].isna()]
                if not len(left):
                    break
                try:
                    got = pd.Series(list(engine(batch.loc[left, prompt])), index=left, dtype=object)
                    out.loc[left, "answer"] = got
                except Exception:  # noqa: BLE001  an engine may raise anything
                    for i in left:
                        try:
                            out.at[i, "answer"] = next(iter(engine(batch.loc[[i], prompt])))
                        except Exception as e:  # noqa: BLE001
                            out.at[i, "error"] = f"{type(e).__name__}: {e}"
                done = left[out.loc[left, "answer"].notna()]
                out.loc[done, "engine"] = name
                out.loc[done, "error"] = None
            yield out

    return requests.select(key, prompt).mapInPandas(run, schema)


def compare(requests: DataFrame, key: str, prompt: str, engines: dict[str, Engine]) -> DataFrame:
    """key and one column per engine: all engines' answers side by side."""
    out = requests.select(key)
    for name, engine in engines.items():
        out = out.join(ask(requests, key, prompt, {name: engine}).select(key, F.col("answer").alias(name)), key, "left")
    return out


def echo(prompts: pd.Series) -> pd.Series:
    """The stub engine: says what it was asked, in upper case."""
    return prompts.str.upper()


class Readers:
    """Data sources by the name they are read by: the seam through which readers of other formats plug in."""

    def __init__(self) -> None:
        self.sources: dict[str, type[DataSource]] = {}

    def add(self, source: type[DataSource]) -> None:
        if source.name() in self.sources:
            raise ValueError(f"a reader {source.name()} is registered already")
        self.sources[source.name()] = source

    def register(self, spark: SparkSession) -> list[str]:
        """Make all of them formats of spark.read; returns their names."""
        for source in self.sources.values():
            spark.dataSource.register(source)
        return sorted(self.sources)
