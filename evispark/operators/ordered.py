"""Operators whose result depends on the order of rows: they run per group, with the order given by a position column.

A group is one request, document or fact, which bounds its size; what can be done without the order is done before.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DUPLICATE_OVERLAP = 0.75


def dedupe_any_key(df: DataFrame, group: str, position: str, keys: Sequence[str]) -> DataFrame:
    """Rows of each group in order, but those that share any non-null key with a row kept before.

    Rows that are dropped contribute no keys, so this is no transitive closure.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: set = set()
        keep = []
        for row in pdf.sort_values(position, kind="stable")[[position, *keys]].itertuples():
            own = {(k, v) for k, v in zip(keys, row[2:], strict=True) if isinstance(v, str) and v}
            if own and own & seen:
                continue
            seen |= own
            keep.append(row.Index)
        return pdf.loc[keep]

    return df.groupBy(group).applyInPandas(run, df.schema)


def dedupe_adjacent(df: DataFrame, group: str, position: str, text: str, kind: str | None = None, least: float = DUPLICATE_OVERLAP) -> DataFrame:
    """Of text rows whose words overlap the last kept one by more than ``least`` (Jaccard), the longer stays in its place."""
    words = lambda s: set(re.findall(r"[a-z0-9]+", s.lower()))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(position, kind="stable").to_dict("records")
        plain = lambda r: (kind is None or r[kind] in ("text", "title")) and bool((r[text] or "").strip())
        out: list[dict] = []
        for r in rows:
            last = out[-1] if out else None
            if last is not None and plain(r) and plain(last):
                a, b = words(r[text]), words(last[text])
                if a and b and len(a & b) / len(a | b) > least:
                    if len(r[text]) > len(last[text]):
                        out[-1] = r
                    continue
            out.append(r)
        return pd.DataFrame(out, columns=pdf.columns)

    return df.groupBy(group).applyInPandas(run, df.schema)


def merge_facts(df: DataFrame, keys: Sequence[str], position: str, confidence: str, source: str) -> DataFrame:
    """Facts of equal keys merged in order: rows without a source join the first fact, those with one a fact of that source
    or one without; higher confidence wins and takes over a source that it lacks.

    Most facts have few rows, so a task reads all of its rows in order of keys and positions instead of group by group; it
    holds the facts of one key at a time.
    """

    def merged(rows: Iterator[dict]) -> list[dict]:
        facts: list[dict] = []
        at: dict[str | None, int] = {}
        for r in rows:
            none = not isinstance(r[source], str)
            key = None if none else r[source]
            # A fact is known by the source that it came with, for good.
            where = at.get(key, 0 if none and facts else at.get(None))
            if where is None:
                at[key] = len(facts)
                facts.append(r)
                continue
            found = facts[where]
            if r[confidence] is not None and found[confidence] is not None and r[confidence] > found[confidence]:
                kept = found[source]
                facts[where] = r
                if none:
                    r[source] = kept
            elif not isinstance(found[source], str) and not none:
                found[source] = r[source]
        return facts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def rows() -> Iterator[dict]:
            nonlocal schema
            for batch in batches:
                schema = batch.schema
                for at in range(0, batch.num_rows, 10_000):
                    yield from batch.slice(at, 10_000).to_pylist()

        out: list[dict] = []
        for _, group in itertools.groupby(rows(), lambda r: tuple(r[k] for k in keys)):
            out += merged(group)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return df.repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_last(position)).mapInArrow(run, df.schema)
