"""Bloom filters of stored keys, as a table of blocks.

The keys of a file are spread over a power of two of blocks by one hash; in each
of a block's eight words two more hashes set a bit each. A key that may be in the
file has all its sixteen bits in its block, so looking keys up is a join with the
blocks, without Python, and no file's filter is ever held whole. With sixteen keys
a block a key that is not there passes about once in a million.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise import schemas

KEYS_PER_BLOCK = 16
BLOCK = "path string, level int, block long, " + ", ".join(f"word_{i} long" for i in range(8))
_WORDS = [f"word_{i}" for i in range(8)]
_PLACE = ["block_hash", "first_hash", "second_hash"]


def _hashed(keys: DataFrame) -> DataFrame:
    """Three hashes of the key; a zero has one sign, as in comparisons."""
    types = dict(keys.dtypes)
    parts = [F.col(c) + F.lit(0.0) if types[c] == "double" else F.col(c) for c in schemas.KEY]
    return keys.withColumns({name: F.xxhash64(F.lit(i), *parts) for i, name in enumerate(_PLACE)})


def _block() -> Column:
    return F.expr("block_hash & (shiftleft(1L, level) - 1)")


def _bits(word: int) -> Column:
    """The key's two bits in a word."""
    one, two = (f"shiftleft(1L, cast(shiftright({h}, {6 * word}) & 63 as int))" for h in _PLACE[1:])
    return F.expr(f"{one} | {two}")


def build(keys: DataFrame, files: DataFrame) -> DataFrame:
    """The filter blocks (``BLOCK``) of ``keys``, which have the key's columns and
    ``path``; ``files`` has each path once, with its ``row_count``."""
    level = F.greatest(F.ceil(F.log2(F.col("row_count") / KEYS_PER_BLOCK)), F.lit(0)).cast("int")
    sized = _hashed(keys).join(files.select("path", level.alias("level")), "path")
    placed = sized.withColumn("block", _block())
    words = [F.bit_or(_bits(i)).alias(w) for i, w in enumerate(_WORDS)]
    return placed.groupBy("path", "level", "block").agg(*words)


def _sought(keys: DataFrame, levels: DataFrame) -> DataFrame:
    """Block and bits of every key at each of its date's ``levels``.

    A date has few levels, so these are broadcast and the keys stay spread: left to
    the planner, which takes narrow keys for small, all keys may become rows of the
    one task that has the levels.
    """
    date = dict(zip(schemas.DATE_PARTITION, ("year", "month", "day")))
    hashed = _hashed(keys.select(*schemas.KEY)).withColumnsRenamed(date).select(*date.values(), *_PLACE).distinct()
    sought = hashed.join(F.broadcast(levels), [*date.values()]).withColumn("block", _block())
    return sought.select(*date.values(), "level", "block", *[_bits(i).alias(f"own_{i}") for i in range(8)])


def files_with(keys: DataFrame, files: DataFrame, blocks: DataFrame) -> list[str]:
    """The paths of ``files`` (``path``, ``year``, ``month``, ``day``) that may hold one of
    the ``keys`` of their date; ``blocks`` are those of these and other files."""
    date = dict(zip(schemas.DATE_PARTITION, ("year", "month", "day")))
    dated = blocks.join(files, "path")
    marked = _sought(keys, dated.select(*date.values(), "level").distinct())
    met = dated.join(marked, [*date.values(), "level", "block"])
    own = [F.col(f"own_{i}") for i in range(8)]
    held = [F.col(w).bitwiseAND(o) == o for w, o in zip(_WORDS, own)]
    return sorted(r.path for r in met.filter(reduce(and_, held)).select("path").distinct().collect())
