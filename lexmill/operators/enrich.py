"""Enrichment: requests answered from a table, by a plug-in, or by the offline default, within a budget."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import fixed


def retrying(call: Callable[[str], str | None], tries: int = 3, longest: float = 60.0, sleep=time.sleep) -> Callable[[str], str | None]:
    """``call`` with exponential backoff; None when all tries fail."""

    def ask(request: str) -> str | None:
        for attempt in range(tries):
            try:
                return call(request)
            except Exception:
                if attempt + 1 < tries:
                    sleep(min(2.0**attempt, longest))
        return None

    return ask


def within_budget(requests: DataFrame, limit: int, key_col: str = "key") -> DataFrame:
    """The distinct requests that may be sent: the first ``limit`` by key (a budget, not a sample of the result)."""
    return requests.select(key_col).distinct().orderBy(key_col).limit(limit)


def answer(requests: DataFrame, call: Callable[[str], str | None], key_col: str = "key", parallel: int = 8) -> DataFrame:
    """(key, response): each distinct request sent once, from at most ``parallel`` tasks."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "response": [call(k) for k in batch["key"]]}, dtype="object")

    return requests.select(F.col(key_col).alias("key")).distinct().coalesce(parallel).mapInPandas(ask, "key string, response string")


def with_answers(rows: DataFrame, answers: DataFrame, key_col: str, out_col: str, default: Column) -> DataFrame:
    """Rows with the response of their key, else the default."""
    a = answers.select(F.col("key").alias("_k"), F.col("response").alias("_r"))
    return rows.join(a, F.col(key_col) == F.col("_k"), "left").withColumn(out_col, F.coalesce("_r", default)).drop("_k", "_r")


def generic_meaning(word: Column) -> Column:
    return F.concat(word, F.lit(fixed.GENERIC_MEANING))


def verdict(c: Column) -> Column:
    """A yes or no from a JSON answer, else whether the text says true; no answer counts as fit."""
    parsed = F.from_json(c, "fits boolean")["fits"]
    return F.coalesce(parsed, F.lower(c).contains("true"), F.lit(True))


def cost(log: DataFrame, prompt_col: str = "prompt_tokens", completion_col: str = "completion_tokens") -> DataFrame:
    """(n_requests, prompt_tokens, completion_tokens, cost): 0.15 and 0.60 for a million."""
    p, c = F.coalesce(F.sum(prompt_col), F.lit(0)), F.coalesce(F.sum(completion_col), F.lit(0))
    return log.agg(F.count("*").alias("n_requests"), p.alias("prompt_tokens"), c.alias("completion_tokens"), ((p * 0.15 + c * 0.60) / 1e6).alias("cost"))
