"""Model-backed steps behind an interface: rows that need a model are split off, sent in batches, checked, and joined back.

A provider is a function of a list of prompts. The offline one is deterministic, so pipelines run and test without a
model.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[str]], list[str | None]]


def offline(prompts: list[str]) -> list[str | None]:
    """The most frequent longest word of a prompt: a stand-in answer that depends on the text alone."""
    out: list[str | None] = []
    for p in prompts:
        words = re.findall(r"[^\W\d_]{4,}", p.lower())
        out.append(max(sorted(set(words)), key=lambda w: (words.count(w), len(w))) if words else None)
    return out


def cascade(providers: list[Provider], valid: Callable[[str], bool]) -> Provider:
    """Asks providers in turn until an answer is valid; if none is, the last answer; if all fail, the last error."""

    def ask(prompts: list[str]) -> list[str | None]:
        out: list[str | None] = [None] * len(prompts)
        open_, error, answered = list(range(len(prompts))), None, False
        for provider in providers:
            if not open_:
                break
            try:
                answers = provider([prompts[i] for i in open_])
            except Exception as e:
                error = e
                continue
            answered = True
            for i, a in zip(open_, answers):
                out[i] = a if a is not None else out[i]
            open_ = [i for i in open_ if out[i] is None or not valid(out[i])]
        if open_ and not answered and error is not None:
            raise error
        return out

    return ask


def complete(rows: DataFrame, id_col: str, prompt: Column, provider: Provider, batch: int = 64) -> DataFrame:
    """(id, answer) of rows; prompts go to the provider in batches, within the tasks that hold them."""

    def run(parts):
        for pdf in parts:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({"id": part["id"], "answer": provider(part["prompt"].fillna("").tolist())})

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), prompt.alias("prompt")).mapInPandas(run, f"id {kind}, answer string").withColumnRenamed("id", id_col)


def fill(rows: DataFrame, id_col: str, known: Column, prompt: Column, provider: Provider) -> DataFrame:
    """Rules first, the model for the rest: adds label, from known where it is not null and else from the provider."""
    ruled = rows.withColumn("label", known)
    asked = complete(ruled.where("label is null"), id_col, prompt, provider)
    return ruled.join(asked, id_col, "left").withColumn("label", F.coalesce("label", "answer")).drop("answer")


def up_to_date(rows: DataFrame, results: DataFrame, key: str, digest: Column) -> DataFrame:
    """Rows whose stored result has another digest, or none: what must be computed again."""
    stored = results.select(key, F.col("source_hash").alias("stored"))
    return rows.withColumn("source_hash", digest).join(stored, key, "left").where(~F.col("source_hash").eqNullSafe(F.col("stored"))).drop("stored")
