"""Scalar expressions, all built from native Spark functions."""

from stopwise.functions.scalars import (
    adjusted_hour,
    clock_part,
    coordinate_sum,
    delay_seconds,
    parse_timestamp,
    typed_null,
    whole_minutes,
)

__all__ = [
    "adjusted_hour",
    "clock_part",
    "coordinate_sum",
    "delay_seconds",
    "parse_timestamp",
    "typed_null",
    "whole_minutes",
]
