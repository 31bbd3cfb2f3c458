"""Spans that contain other spans, by one sweep over both in order of their starts.

Spans of a key are dealt into bins of text, so that a long document is no single task's; a point (itself a span) goes to the
bin of its start, a span to every bin that it touches.  In a bin the sweep keeps open spans that no other open span makes
useless, ordered by end: for the narrowest one, wider spans that end earlier are dropped, so the first that ends late enough
is the answer and is found by bisection.  No point is paired up with the spans of its key.

Results: intervals are half open.  Empty spans contain nothing, and a point without a start or end lies in none.  Of equally narrow spans the one of
the smaller start wins, then the smaller id; of spans of the first start, the smaller id.  Points that nothing contains have no row.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Characters of text in a bin.
BIN = 1 << 15


class Open:
    """Open spans (end, width or 0, start, id) by end; ``narrowest`` or the first by start."""

    def __init__(self, narrowest: bool) -> None:
        self.narrowest = narrowest
        self.ends: list[int] = []
        self.spans: list[tuple] = []

    def add(self, start: int, end: int, name: object) -> None:
        past = bisect_right(self.ends, start)  # nothing that comes now lies in these
        del self.ends[:past], self.spans[:past]
        rank = (end - start, start, name) if self.narrowest else (start, name)
        i = bisect_left(self.ends, end)
        # One that ends as late and ranks better makes this one useless.
        if i < len(self.ends) and self.spans[i][0] <= rank:
            return
        j = i + (i < len(self.ends) and self.ends[i] == end)
        while i and self.spans[i - 1][0] > rank:
            i -= 1
        self.ends[i:j] = [end]
        self.spans[i:j] = [(rank, name)]

    def holding(self, end: int) -> object | None:
        i = bisect_left(self.ends, end)
        return self.spans[i][1] if i < len(self.ends) else None


def containing(points: DataFrame, spans: DataFrame, key: Sequence[str], narrowest: bool = True, width: int = BIN) -> DataFrame:
    """(key, point, span): for each point (key, point, start, stop) the span (key, span, start, stop) that contains it.

    Ids are long.  A point of no length lies in a span that holds its start.
    """
    size = F.lit(width)
    of = F.struct(*key).alias("_key")
    a = spans.filter("start < stop").select(of, F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))).alias("_bin"), F.lit(0).alias("_side"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.col("span").cast("long").alias("id"))
    b = points.filter("start IS NOT NULL AND stop IS NOT NULL").select(of, F.floor(F.col("start") / size).alias("_bin"), F.lit(1).alias("_side"), F.col("start").cast("long").alias("start"), F.greatest("stop", F.col("start") + 1).cast("long").alias("stop"), F.col("point").cast("long").alias("id"))
    both = a.unionByName(b)
    # Spans before points of the same start.
    order = ["_key", "_bin", "start", "_side", "stop", "id"]
    kind = both.schema["_key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("_key", "_bin", "start", "_side", "stop", "id")
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in names), strict=True))
        out: list[tuple] = []
        for (where, _), group in itertools.groupby(rows, lambda r: (r[0], r[1])):
            held = Open(narrowest)
            for _, _, start, side, stop, name in group:
                if side == 0:
                    held.add(start, stop, name)
                elif (found := held.holding(stop)) is not None:
                    out.append((where, name, found))
            if len(out) >= 10_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    key_type = to_arrow_type(kind)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        keys, points_, spans_ = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(points_, pa.int64()), pa.array(spans_, pa.int64())], ["_key", "point", "span"])

    swept = both.repartition("_key", "_bin").sortWithinPartitions(*order).mapInArrow(run, f"_key {kind.simpleString()}, point long, span long")
    return swept.select("_key.*", "point", "span")


def projected(points: DataFrame, pairs: DataFrame, key: Sequence[str], width: int = BIN) -> DataFrame:
    """Points (key, point, start, stop) on another track, by the narrowest pair (key, span, start, stop, o_start, o_stop) that
    contains them: (key, point, span, o_from, o_to), cut at the pair's end there.
    """
    found = containing(points, pairs, key, True, width)
    j = found.join(points.select(*key, "point", "start", "stop"), [*key, "point"]).join(pairs.select(*key, "span", F.col("start").alias("_s"), "o_start", "o_stop"), [*key, "span"])
    begin = F.col("o_start") + F.col("start") - F.col("_s")
    return j.select(*key, "point", "span", F.least(begin, "o_stop").alias("o_from"), F.least(begin + F.col("stop") - F.col("start"), "o_stop").alias("o_to"))
