"""Extraction by a language model: prompts as columns, the model on the workers, errors as rows."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordance.functions.fields import template
from accordance.functions.values import response_json

#: A model: prompts in, for each a response and its number of output tokens. It may raise.
Generator = Callable[[list[str]], list[tuple[str, int]]]
_OUT = "response string, tokens long, seconds double, attempts int, error string"


def prompt(text: Column, system: str, user: str, suffix: str = "") -> Column:
    """System text and user text with {schema} and {text} filled in, the schema first: a report may hold ``{schema}``."""
    schema = json.dumps(template(), indent=2, ensure_ascii=False)
    before, _, after = user.replace("{schema}", schema).partition("{text}")
    return F.concat(F.lit(f"{system}\n\n{before}"), F.coalesce(text, F.lit("")), F.lit(after + suffix))


def within_tokens(prompts: DataFrame, make: Callable[[], object], most: int) -> DataFrame:
    """``prompts`` with prompt cut to its first ``most`` tokens and n_tokens, how many it had.

    ``make`` builds a tokenizer with encode(text) -> ids and decode(ids) -> text, once a task.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = make()
        for rows in batches:
            ids = [tokenizer.encode(t or "") for t in rows["prompt"]]
            texts = [t if len(x) <= most else tokenizer.decode(x[:most]) for t, x in zip(rows["prompt"], ids)]
            yield rows.assign(prompt=texts, n_tokens=[len(x) for x in ids])

    columns = [c for c in prompts.columns if c != "n_tokens"]
    schema = prompts.select(*columns).schema.add("n_tokens", "long")
    return prompts.select(*columns).mapInPandas(cut, schema)


#: The model that this worker process has, by what made it.
_model: dict[str, Generator] = {}


def _of_worker(name: str, make: Callable[[], Generator]) -> Generator:
    """The worker's model; another one that it had goes first, since two may not fit."""
    if name not in _model:
        _model.clear()
        _model[name] = make()
    return _model[name]


def generate(prompts: DataFrame, make: Callable[[], Generator], key: str = "doc_id", attempts: int = 3, batch: int = 8) -> DataFrame:
    """key, response, tokens, seconds, attempts and error of every prompt.

    ``make`` builds the model once a worker process, for as long as that lives, whatever the number of tasks; what it closes
    over must be the same for the same model. Prompts of like length go to the model together. A batch that raises, or has another number of responses than
    prompts, is tried again one by one, each up to ``attempts`` times in all; what still fails is a row with the error, not a failed job.
    """

    name = hashlib.sha256(cloudpickle.dumps(make)).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _of_worker(name, make)

        def one(text: str, error: str):
            begun = time.monotonic()
            for attempt in range(2, attempts + 1):  # the batch was the first
                try:
                    response, tokens = model([text])[0]
                    return response, tokens, time.monotonic() - begun, attempt, None
                except Exception as e:  # whatever the model raises is the row's error
                    error = f"{type(e).__name__}: {e}"[:2000]
            return None, 0, time.monotonic() - begun, attempts, error

        for rows in batches:
            found, order = [], rows["prompt"].str.len().fillna(0).argsort(kind="stable").to_numpy()
            for at in range(0, len(rows), batch):
                texts, begun = rows["prompt"].iloc[order[at : at + batch]].tolist(), time.monotonic()
                try:
                    made = model(texts)
                    if len(made) != len(texts):
                        raise ValueError(f"{len(made)} responses to {len(texts)} prompts")
                    each = (time.monotonic() - begun) / len(texts)
                    found += [(r, n, each, 1, None) for r, n in made]
                except Exception as e:
                    found += [one(t, f"{type(e).__name__}: {e}"[:2000]) for t in texts]
            made = pd.DataFrame(found, columns=["response", "tokens", "seconds", "attempts", "error"], index=order).sort_index()
            yield pd.concat([rows[[key]].reset_index(drop=True), made], axis=1)

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, "prompt").mapInPandas(run, f"{key} {kind}, {_OUT}")


def records(responses: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """key and raw (the JSON text) of responses that hold an object; and the dead letters, with their reason and response."""
    cut = responses.withColumn("raw", F.coalesce(response_json(F.col("response")), F.lit("")))
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("raw")).startswith("OBJECT"), F.lit(False))
    reason = F.coalesce("error", F.when(F.col("raw") == "", "no braces").otherwise("no JSON"))
    return cut.where(is_object & F.col("error").isNull()).select(key, "raw"), cut.where(~is_object | F.col("error").isNotNull()).select(key, reason.alias("reason"), "response")
