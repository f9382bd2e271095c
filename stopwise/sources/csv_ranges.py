"""CSV records that span lines, found in byte ranges of large files side by side.

Quotes decide where a record ends, so what a line break means depends on all before
it. But a line only maps the state before it, inside a quoted field or not, to the
state after it, and such maps compose: every range is read once for its own map,
the maps of a file's ranges are composed in order, and then every range knows the
state it starts in and puts its lines together. A record that reaches over the end of
a range is left in parts, one a range, and joined afterwards.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A quoted field that is closed, after the line's start or a comma; doubled quotes are content.
_CLOSED = r'(^|,)"[^"]*+(?:""[^"]*+)*+"(?!")'
_WHOLE, _BEGUN, _CONTINUED = 0, 1, 2


def ends_open(line: Column, inside: bool) -> Column:
    """Whether a quoted field is open after the line, if one was (``inside``) or was
    not before it."""
    quoted = F.concat(F.lit('"'), line) if inside else line
    left = F.regexp_replace(quoted, _CLOSED, "$1")
    return F.when(line.contains('"'), left.rlike('(^|,)"')).otherwise(F.lit(inside))


def text_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """``file``, ``start`` (the byte range's), ``value`` and the two outcomes of every line,
    in the order of the files within each task."""
    lines = spark.read.text(files)
    value = F.col("value")
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        "value",
        ends_open(value, False).alias("from_outside"),
        ends_open(value, True).alias("from_inside"),
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Consecutive rows of one range."""
    files, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    low = 0
    for row in range(1, batch.num_rows + 1):
        if row == batch.num_rows or (files[row], starts[row]) != (files[low], starts[low]):
            yield (files[low], starts[low]), batch.slice(low, row - low)
            low = row


def _states(part: pa.RecordBatch, state: bool) -> np.ndarray:
    """The state after every line, from that before the first."""
    outside, inside = (part.column(name).to_numpy(zero_copy_only=False) for name in ("from_outside", "from_inside"))
    after = np.empty(len(outside), bool)
    low = 0
    for row in np.flatnonzero(outside | ~inside).tolist():  # the lines that are not without effect
        after[low:row] = state
        state = bool(inside[row] if state else outside[row])
        after[row] = state
        low = row + 1
    after[low:] = state
    return after


def _range_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, start, from_outside, from_inside``: the map of every range of the task."""
    maps: dict[tuple[str, int], list[bool]] = {}
    for batch in batches:
        for place, part in _runs(batch):
            known = maps.setdefault(place, [False, True])
            maps[place] = [bool(_states(part, s)[-1]) for s in known]
    columns = [[f for f, _ in maps], [s for _, s in maps], *([m[i] for m in maps.values()] for i in (0, 1))]
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
    names = ["file", "start", "from_outside", "from_inside"]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


_MAPS = "file string, start long, from_outside boolean, from_inside boolean"


def ranges_inside(lines: DataFrame) -> set[tuple[str, int]]:
    """The ranges that start inside a quoted field; only these reach the driver.

    The state after a range is that of its last map that does not depend on the
    state before, turned round by every one since that swaps the two.
    """
    maps = lines.drop("value").mapInArrow(_range_maps, _MAPS)
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("from_outside") == F.col("from_inside")
    swaps = F.col("from_outside") & ~F.col("from_inside")
    counted = maps.withColumn("swaps", F.sum(swaps.cast("int")).over(Window.partitionBy("file").orderBy("start")))
    last = F.last(F.when(fixed, F.struct("from_outside", "swaps")), ignorenulls=True).over(before)
    since = F.coalesce(F.max("swaps").over(before), F.lit(0)) - F.coalesce(last["swaps"], F.lit(0))
    inside = F.coalesce(last["from_outside"], F.lit(False)) != (since % 2 == 1)
    return {(r.file, r.start) for r in counted.select("file", "start", inside.alias("inside")).filter("inside").collect()}


def records(spark: SparkSession, files: list[str]) -> DataFrame:
    """``file``, ``start``, ``place`` and ``record`` of every record of the files, blank
    ones left out; a file's records are in the order of ``start`` and ``place``."""
    lines = text_lines(spark, files)
    inside = ranges_inside(lines)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, state, places = None, False, 0
        held: list[str] = []  # lines of a record that is not closed yet
        kind = _WHOLE  # or _CONTINUED, if it began in a range before

        def left_open() -> list[tuple]:
            if not held:
                return []
            return [(*where, places, _BEGUN if kind == _WHOLE else _CONTINUED, "\n".join(held))]

        for batch in batches:
            rows = []
            for place, part in _runs(batch):
                if place != where:
                    rows += left_open()
                    where, state, places, held = place, place in inside, 0, []
                    kind = _CONTINUED if state else _WHOLE
                after = _states(part, state)
                for text, open_after in zip(part.column(2).to_pylist(), after.tolist()):
                    held.append(text)
                    if not open_after:
                        rows.append((*where, places, kind, "\n".join(held)))
                        places, held, kind = places + 1, [], _WHOLE
                state = bool(after[-1])
            yield _batch(rows)
        yield _batch(left_open())

    found = lines.select("file", "start", "value", "from_outside", "from_inside").mapInArrow(put_together, _PARTS)
    parts = found.filter(F.col("kind") != _WHOLE)
    chain = F.sum((F.col("kind") == _BEGUN).cast("int")).over(Window.partitionBy("file").orderBy("start", "place"))
    pieces = F.array_sort(F.collect_list(F.struct("start", "place", "record")))
    joined = parts.withColumn("chain", chain).groupBy("file", "chain").agg(pieces.alias("pieces"))
    first = F.col("pieces")[0]
    whole = joined.select(
        "file",
        first["start"].alias("start"),
        first["place"].alias("place"),
        F.array_join(F.col("pieces")["record"], "\n").alias("record"),
    )
    all_records = found.filter(F.col("kind") == _WHOLE).drop("kind").unionByName(whole)
    return all_records.filter(F.length(F.trim("record")) > 0)


_PARTS = "file string, start long, place long, kind int, record string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    columns = zip(*rows) if rows else [[]] * len(kinds)
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _PARTS.split(", ")])
