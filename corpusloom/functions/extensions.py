"""Extension points: reward functions by name, an injected generator, a handler that may take state."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.functions.metrics import accuracy_rewards
from corpusloom.functions.text import follows_format

Reward = Callable[[Column, Column], Column]
#: Name -> (completion, answer) -> reward column.
REWARDS: dict[str, Reward] = {
    "accuracy": lambda completion, answer: accuracy_rewards(completion, answer),
    "format": lambda completion, answer: follows_format(completion).cast("double"),
}


def register_reward(name: str, reward: Reward) -> None:
    REWARDS[name] = reward


def rewards(rows: DataFrame, names: list[str], completion: str, answer: str) -> DataFrame:
    """The rows with one column per named reward."""
    return rows.withColumns({f"reward_{n}": REWARDS[n](F.col(completion), F.col(answer)) for n in names})


def generated(rows: DataFrame, context: str, generator: Callable[[list[str | None]], list[str]], out: str = "prediction") -> DataFrame:
    """The rows with the texts that an injected batch generator makes of a context column."""
    names = [c for c in rows.columns if c != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != out) + f", `{out}` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield df[names].assign(**{out: generator(df[context].tolist())})

    return rows.mapInPandas(run, schema)


def accepts_state(handler: Callable) -> bool:
    """Whether a handler takes ``state`` by name or as a second position."""
    parameters = inspect.signature(handler).parameters.values()
    if any(p.name == "state" or p.kind is p.VAR_KEYWORD for p in parameters):
        return True
    return sum(p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) for p in parameters) >= 2


def call_handler(handler: Callable, text: str, state: dict | None) -> object:
    if not accepts_state(handler):
        return handler(text)
    names = inspect.signature(handler).parameters
    return handler(text, state=state) if "state" in names or not any(p.kind is p.POSITIONAL_OR_KEYWORD for p in list(names.values())[1:2]) else handler(text, state)


def handled(rows: DataFrame, handler: Callable, text: str, state: str, out: str = "handled", kind: str = "long") -> DataFrame:
    """Rows with the answer of an injected handler, which may take the state (a struct column, as a dict) or not."""
    schema = rows.select(F.lit(None).cast(kind).alias(out)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield df.drop(columns=[state]).assign(**{out: [call_handler(handler, t, s) for t, s in zip(df[text], df[state], strict=True)]})

    return rows.mapInPandas(run, StructType([*(f for f in rows.schema if f.name != state), *schema]))
