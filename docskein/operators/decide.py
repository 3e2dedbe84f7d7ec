"""Decisions that a model would take, behind one interface.

A provider adds a JSON ``payload`` to request rows.  Rules are columns, so
that they cost no shuffle; recorded decisions are joined by request id; a live
call runs in Arrow batches with bounded retries.  Everything after a provider
is deterministic.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docskein.functions.iri import stable_id


class RuleProvider:
    """``rules``: for each kind a function of the requests' columns."""

    def __init__(self, rules: dict[str, Callable[[], Column]]) -> None:
        self.rules = rules

    def attach(self, kind: str, requests: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
        payload = self.rules[kind]()
        return requests.withColumn("payload", payload if where is None else F.when(where, payload))


class ReplayProvider:
    """``recorded``: (request_id, payload); a request without one gets null."""

    def __init__(self, recorded: DataFrame) -> None:
        self.recorded = recorded.select("request_id", "payload")

    def attach(self, kind: str, requests: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
        rid = stable_id(F.lit(kind), *[F.col(k) for k in keys])
        asked = requests.withColumn("request_id", rid if where is None else F.when(where, rid))
        return asked.join(self.recorded, "request_id", "left").drop("request_id")


#: Errors that a later try may not meet: the network's and the service's.  What a
#: service library raises for a full quota is added by its user.
TRANSIENT = (OSError, TimeoutError)


class LiveProvider:
    """``call(kind, dict of keys) -> JSON string``; a call that keeps failing leaves
    null and its ``cause`` (the error's type and text), so one bad request costs no
    other and is told apart from the rest.

    A call that raises one of ``retry_on`` is tried ``retries`` more times, ``delay``
    seconds apart and doubling up to ``longest``; the whole of that is done
    ``attempts`` times, with min(2 ** n, 10) seconds (times ``delay``) in between.
    Any other error is the program's own: it is told at once.  Requests are dealt
    to ``in_flight`` tasks, each of which makes one call at a time: no more than
    that many calls are under way, however large the cluster."""

    def __init__(self, call: Callable[[str, dict], str], *, retries: int = 5, delay: float = 1.0, longest: float = 60.0, attempts: int = 1, in_flight: int = 8, retry_on: tuple[type[BaseException], ...] = TRANSIENT) -> None:
        self.call, self.retries, self.delay, self.longest = call, retries, delay, longest
        self.attempts, self.in_flight, self.retry_on = attempts, in_flight, retry_on

    def attach(self, kind: str, requests: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
        call, retries, delay, longest, attempts, retry_on = self.call, self.retries, self.delay, self.longest, self.attempts, self.retry_on
        nothing = F.lit(None).cast("string")
        asked = requests.withColumns({"payload": nothing, "cause": nothing, "_ask": F.lit(True) if where is None else F.coalesce(where, F.lit(False))})

        def one(row: dict) -> tuple[str | None, str | None]:
            cause = None
            for n in range(attempts):
                for k in range(retries + 1):
                    try:
                        return call(kind, row), None
                    except Exception as e:  # the provider's own errors are of any type
                        cause = f"{type(e).__name__}: {e}"[:500]
                        if not isinstance(e, retry_on):
                            return None, cause
                    if k < retries:
                        time.sleep(min(delay * 2**k, longest))
                if n + 1 < attempts:
                    time.sleep(delay * min(2**n, 10))
            return None, cause

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                told = [one(dict(zip(keys, r))) if ask else (None, None) for ask, r in zip(b["_ask"], b[keys].itertuples(index=False, name=None))]
                b["payload"], b["cause"] = [p for p, _ in told], [c for _, c in told]
                yield b

        return asked.repartition(self.in_flight).mapInPandas(run, asked.schema).drop("_ask")
