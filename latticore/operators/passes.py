"""Iterative fits as runs that ask for sums: a run yields its state, is sent the sums of all rows at it, and returns its result.

A run knows nothing of where the rows are: it may go alone over arrays, or many runs share one pass over a distributed table.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Generator, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame


def alone(run: Generator, sums: Callable) -> dict:
    """The result of a run whose sums are at hand."""
    state = next(run)
    while True:
        try:
            state = run.send(sums(state))
        except StopIteration as end:
            return end.value


#: Rows that are worth a task in a pass, and rows of a task at the most (unless the table has fewer partitions).
TASK_ROWS, MOST_ROWS = 250, 1_000_000
#: Bytes of sums that come to the driver at once; more are added up in tasks first.
SUM_BYTES = 64 << 20


def dealt(rows: DataFrame) -> tuple[DataFrame, int]:
    """The (persisted) rows in no more partitions than they are worth, without a shuffle, and how many those are at the most."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(-(-n // TASK_ROWS), cores if n < MOST_ROWS // 10 else max(2 * cores, -(-n // MOST_ROWS))))
    return rows.coalesce(tasks), tasks


def summed(rows: DataFrame, tasks: int, sums: Callable, add: Callable, shared, size: int | None = None) -> tuple[list, int]:
    """One job: sums(frame, shared value) of all frames, a list, added up item by item in the order of the partitions; and how many bytes one such list takes.

    Lists of all partitions come to the driver where they are known to be small (`size`, of an earlier pass), else they are added up in tasks before.
    """

    def plus(a: list | None, b: list) -> list:
        return [add(u, v) for u, v in zip(a or [None] * len(b), b)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            if len(f):
                total = plus(total, sums(f, shared.value))
        if total is not None:
            yield pd.DataFrame({"i": [TaskContext.get().partitionId()], "s": [pickle.dumps(total)]})

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = pd.concat([f for f in frames if len(f)] or [pd.DataFrame({"i": [], "s": []})]).sort_values("i")
        total = None
        for s in parts["s"]:
            total = plus(total, pickle.loads(s))
        if total is not None:
            yield pd.DataFrame({"i": [int(parts["i"].iloc[0])], "s": [pickle.dumps(total)]})

    parts = rows.mapInPandas(run, "i int, s binary")
    groups = 1 if size is None else max(1, SUM_BYTES // max(size, 1))
    if tasks > groups:
        parts = parts.repartition(groups, "i").mapInPandas(merge, "i int, s binary")
    out, most = None, 0
    for r in sorted(parts.collect(), key=lambda r: r.i):
        most = max(most, len(r.s))
        out = plus(out, pickle.loads(r.s))
    return out, most


def together(runs: Sequence[Generator], rows: DataFrame, columns: Sequence[str], weight: str | None, sums: Callable, add: Callable) -> list[dict]:
    """The results of all runs: each pass gives every run still open its sums, a row of them from each partition of the (persisted) rows, all partitions in one job.

    sums(x, w, state) are additive statistics of rows, add(a, b) adds two of them (a may be None).
    """
    columns = list(columns)
    rows, tasks = dealt(rows)
    size = None

    def one_pass(states: list) -> list:
        nonlocal size
        shared = rows.sparkSession.sparkContext.broadcast(states)
        out, size = summed(rows, tasks, of_frame, add, shared, size)
        shared.unpersist()
        return out or [None] * len(states)

    def of_frame(f: pd.DataFrame, states: list) -> list:
        x, w = f[columns].to_numpy(float, na_value=np.nan), f[weight].to_numpy(float) if weight else np.ones(len(f))
        return [sums(x, w, s) for s in states]

    results: dict[int, dict] = {}
    at = {i: next(run) for i, run in enumerate(runs)}
    while at:
        for i, s in zip(list(at), one_pass(list(at.values()))):
            try:
                at[i] = runs[i].send(s)
            except StopIteration as end:
                results[i] = end.value
                del at[i]
    return [results[i] for i in range(len(runs))]
