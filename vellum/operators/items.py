"""Items out of chunks: a table function that asks a provider for each cluster of fields, checks answers and asks again."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Questions asked of a provider before a cluster of a chunk is given up.
ATTEMPTS = 3
#: (chunk, cluster, attempt) -> the answer, a JSON list of objects with value and quote.
Provider = Callable[[str, str, int], str]


class OfflineProvider:
    """A stand-in without a model: words of a field that a chunk holds. One chunk length in five fails once, one in 35 always."""

    def __init__(self, words: dict[str, tuple[str, ...]]):
        self.words = words

    def __call__(self, chunk: str, cluster: str, attempt: int) -> str:
        if len(chunk) % 35 == 0 or len(chunk) % 5 == 0 and attempt == 1:
            return "I am sorry, [{"
        low = chunk.lower()
        return json.dumps([{"value": w, "quote": chunk[low.index(w) : low.index(w) + len(w)]} for w in self.words[cluster] if w in low])


def checked(answer: str, chunk: str) -> list[dict] | None:
    """The items of an answer that is a list of objects with a value and a quote from the chunk; else null."""
    try:
        rows = json.loads(answer)
    except ValueError:
        return None
    good = isinstance(rows, list) and all(isinstance(r, dict) and isinstance(r.get("value"), str) and r["value"].strip() and isinstance(r.get("quote"), str) and r["quote"].lower() in chunk.lower() for r in rows)
    return rows if good else None


def answers(chunk: str | None, provider: Provider, clusters: tuple[str, ...]) -> Iterator[tuple]:
    """(field, place, value, quote, attempts) of each item; a cluster that is given up has one row without a value."""
    for cluster in clusters if chunk else ():
        for attempt in range(1, ATTEMPTS + 1):
            try:
                rows = checked(provider(chunk, cluster, attempt), chunk)
            except OSError:  # what a service at a distance raises
                rows = None
            if rows is not None:
                yield from ((cluster, i, r["value"].strip(), r["quote"], attempt) for i, r in enumerate(rows))
                break
        else:
            yield cluster, 0, None, None, ATTEMPTS


def extract(chunks: DataFrame, chunk: str, provider: Provider, clusters: tuple[str, ...]) -> DataFrame:
    """chunks with (field, place, value, quote, attempts) of every item that the provider finds in them.

    A lateral join with a table function: chunks are spread as they lie, an answer is checked where it is made, and only
    what fails is asked again. Null and empty chunks have no items; rows without a value tell what was given up.
    """

    @F.udtf(returnType="field string, place int, value string, quote string, attempts int")
    class Items:
        def eval(self, text: str):
            yield from answers(text, provider, clusters)

    return chunks.lateralJoin(Items(F.col(chunk).outer()))
