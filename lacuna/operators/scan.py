"""Decisions that depend on what was decided before, for cases of any length.

``scanned`` hands the records of a case to a step function one by one, in order. Records are dealt by case, sorted within their partition and streamed
through in Arrow batches; what the function remembers is carried from batch to batch. The work is linear in the records, and a task
holds one batch and the function's own state, never a whole case.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[..., Iterable[tuple]]


def scanned(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], made: str, begin: Callable[[], Step | tuple[Step, Step]]) -> DataFrame:
    """keys and the columns ``made`` (a DDL string) of all tuples that the steps give.

    ``begin`` makes a new step function for each value of the keys; it is called with ``columns`` of each record, in the order of ``order``. Missing numbers come as NaN.
    ``begin`` may give a pair instead: the step function and one without arguments, which is called after the last record of the key.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], made])
    names = [*keys, *[x.split()[0] for x in made.split(",")]]
    n = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, step, close = None, None, None
        for b in batches:
            found: list[tuple] = []
            for record in b.itertuples(index=False, name=None):
                key = tuple(None if x != x else x for x in record[:n])
                if key != held:
                    found += [(*held, *x) for x in close()] if close else []
                    started = begin()
                    held, (step, close) = key, started if isinstance(started, tuple) else (started, None)
                found += [(*key, *x) for x in step(*record[n:])]
            yield pd.DataFrame(found, columns=names)
        if close:
            yield pd.DataFrame([(*held, *x) for x in close()], columns=names)

    # by a hash of the keys: Spark drops a repartition by the keys alone over a union whose sides are dealt by them, and then merges the small partitions of each side on its own
    sorted_rows = rows.select(*keys, *dict.fromkeys([*columns, *order])).repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)
    return sorted_rows.select(*keys, *columns).mapInPandas(run, schema)


def kept_changes(settings: list[tuple[float, float]]) -> Callable[[], Step]:
    """hold, gap, sec, value, reason of records (sec, value) that differ by 1 or more from the last kept one, or come ``gap`` later and not within ``hold``."""

    def begin() -> Step:
        last: list[tuple[float, float] | None] = [None] * len(settings)

        def step(sec: float, value: float) -> Iterator[tuple]:
            for i, (hold, gap) in enumerate(settings):
                s = last[i]
                if s is None:
                    reason = "initial"
                elif abs(value - s[1]) >= 1:
                    reason = "change"
                elif sec - s[0] >= gap and sec - s[0] >= hold:
                    reason = "timer"
                else:
                    continue
                last[i] = (sec, value)
                yield hold, gap, sec, value, reason

        return step

    return begin


def anchors(width: float | None = None) -> Callable[[], Step]:
    """For each record (sec, ...) the second at which its block began: blocks span at most ``width`` from their first record; without one the second column is each record's own."""

    def begin() -> Step:
        anchor: float | None = None
        given = width

        def step(sec: float, *rest) -> Iterator[tuple]:
            nonlocal anchor
            width, *rest = (given, *rest) if given is not None else rest
            if anchor is None or sec > anchor + width + 1e-9:
                anchor = sec
            yield (anchor, *rest)

        return step

    return begin


def adaptive(rule: str, base: int, close: int, hold: int, low: float, drop: float) -> Callable[[], Step]:
    """bin and whether the sample there fires, for the bins (bin, value) at which an adaptive schedule samples."""

    def begin() -> Step:
        following, until, before = 0, -1, float("nan")

        def step(bin: int, value: float) -> Iterator[tuple]:
            nonlocal following, until, before
            if bin < following:
                return
            fires = value < low or (rule == "trend" and before - value >= drop)  # false where one is missing
            if fires:
                until = max(until, bin + hold)
            following, before = bin + (close if bin < until else base), value
            yield bin, fires

        return step

    return begin


def steady_increases(most_gap: float, stay: float, tiny: float) -> Callable[[], Step]:
    """sec, kind, previous, value of increases (sec, value) that are kept up until a record ``stay`` later, without long gaps.

    Increases that are still open have ever higher rates to stay above, the latest the highest: a record that is too low ends the last ones of the queue, one that is late
    enough confirms the first ones. Each increase enters and leaves the queue once.
    """

    def begin() -> Step:
        opened: deque[tuple[float, float, float]] = deque()  # previous rate, sec, value
        at, rate = float("nan"), float("nan")

        def step(sec: float, value: float) -> Iterator[tuple]:
            nonlocal at, rate
            if value != value or sec - at > most_gap:
                opened.clear()
            while opened and not value > opened[-1][0] + tiny:
                opened.pop()
            if rate >= 0 and value > rate + tiny and 0 < sec - at <= most_gap:
                opened.append((rate, sec, value))
            while opened and sec >= opened[0][1] + stay:
                previous, began, reached = opened.popleft()
                yield began, "start" if previous == 0 else "increase", previous, reached
            at, rate = sec, value

        return step

    return begin


def digest_of_lines() -> tuple[Step, Step]:
    """SHA-256 of the records' texts, one a line; a missing text is no line. Only the state of the digest is held."""
    digest, lines = hashlib.sha256(), 0

    def step(text: str | None) -> Iterable[tuple]:
        nonlocal lines
        if isinstance(text, str):
            digest.update(b"\n" * (lines > 0) + text.encode())
            lines += 1
        return ()

    return step, lambda: [(digest.hexdigest(),)]
