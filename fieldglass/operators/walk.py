"""Walks over many small groups in a stream of Arrow batches.

Rows are dealt by key and sorted by Spark; a task then reads its groups one after the other, without a call into Python
for each group. A group that runs over a batch's end waits for the next batch, so a group must fit in memory: objects
of one frame, frames of one match.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of whole groups, each with the groups' first rows and the end."""
    held: list[pd.DataFrame] = []  # of the last group
    for pdf in batches:
        if not len(pdf):
            continue
        new = np.zeros(len(pdf), bool)
        for k in keys:
            v = pdf[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
            new[0] |= bool(held) and v[0] != held[-1][k].iloc[-1]
        at = np.flatnonzero(new)
        if not len(at):  # the last group goes on
            held.append(pdf)
            continue
        whole = pd.concat([*held, pdf.iloc[: at[-1]]], ignore_index=True)
        before = sum(map(len, held))
        if len(whole):
            ends = at + before
            yield whole, ends if ends[0] == 0 else np.concatenate([[0], ends])
        held = [pdf.iloc[at[-1] :]]
    if held:
        yield pd.concat(held, ignore_index=True), np.array([0, sum(map(len, held))])


def larger(batches: Iterator[pd.DataFrame], rows: int = 200_000) -> Iterator[pd.DataFrame]:
    """The same rows in fewer batches, for walks that take a step in many groups at once."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def dealt(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def labelled(df: DataFrame, keys: list[str], order: list[str | Column], columns: list[str], label: Callable[..., list[int]]) -> DataFrame:
    """df with ``cluster``, a number for each row from label(arrays of a group's columns); rows under 0 are dropped."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, at in groups(batches, keys):
            arrays = [pdf[c].to_numpy() for c in columns]
            out = np.empty(len(pdf), np.int64)
            for a, b in zip(at[:-1], at[1:], strict=True):
                out[a:b] = label(*(x[a:b] for x in arrays))
            pdf = pdf.assign(cluster=out)
            yield pdf[out >= 0]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return dealt(df, keys, order).mapInPandas(run, f"{fields}, cluster long")


def alike(at: np.ndarray, numbers: Callable[[int], int], most: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of one size and their rows (a group's rows are at[k] to at[k + 1]), about ``most`` numbers at once of numbers(size) for each."""
    size = np.diff(at)
    for n in np.unique(size[size > 0]).tolist():
        of = np.flatnonzero(size == n)
        step = max(1, most // max(1, numbers(n)))
        for k in range(0, len(of), step):
            yield of[k : k + step], at[of[k : k + step], None] + np.arange(n)


def labelled_alike(df: DataFrame, keys: list[str], order: list[str | Column], label: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int = 4_000_000) -> DataFrame:
    """df with ``cluster``, from label(x, y), whose rows are groups of one size: all groups of a size are labelled at once."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, at in groups(batches, keys):
            x, y, out = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), np.zeros(len(pdf), np.int64)
            for _, rows in alike(at, lambda n: n * n, most):
                if rows.shape[1] > 1:
                    out[rows] = label(x[rows], y[rows])
            yield pdf.assign(cluster=out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return dealt(df, keys, order).mapInPandas(run, f"{fields}, cluster long")


def made(df: DataFrame, keys: list[str], order: list[str | Column], columns: list[str], rows: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """The rows that rows(arrays of a group's columns) gives for each group, after the group's keys."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, at in groups(batches, keys):
            arrays, first = [pdf[c].to_numpy() for c in columns], [pdf[k].to_numpy() for k in keys]
            out = [(*(f[a] for f in first), *r) for a, b in zip(at[:-1], at[1:], strict=True) for r in rows(*(x[a:b] for x in arrays))]
            yield pd.DataFrame(out, columns=names)

    return dealt(df, keys, order).mapInPandas(run, schema)


def made_alike(df: DataFrame, keys: list[str], rows: Callable[[pd.DataFrame, np.ndarray], tuple[np.ndarray, dict[str, np.ndarray]]], schema: str) -> DataFrame:
    """The rows that rows(pdf, at) gives for a batch of whole groups, after their groups' keys; it also gives each row's group. df must be dealt."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, at in groups(larger(batches, 100_000), keys):
            of, columns = rows(pdf, at)
            yield pd.DataFrame({k: pdf[k].to_numpy()[at[of]] for k in keys} | columns)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    return df.mapInPandas(run, f"{fields}, {schema}")


def descending(name: str) -> Column:
    return F.col(name).desc()
