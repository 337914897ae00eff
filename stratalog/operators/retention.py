"""Retention policies: which floor they select.  Segments are the files of a log: (base, bytes, events)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POLICIES = ("keep_from", "keep_latest_events", "keep_newer_than", "target_log_bytes")


@dataclass(frozen=True)
class Segment:
    base: int
    end: int
    bytes: int
    path: str = ""


def effective_floor(segments: list[Segment], requested: int, floor: int) -> int:
    """A floor is the beginning of a segment: the last one that isn't beyond the requested position."""
    return max([floor, *(s.base for s in segments if s.base <= requested)])


def latest_events_floor(head: int, floor: int, keep: int) -> int:
    return head - min(keep, head - floor)


def newer_than_floor(log: DataFrame, cutoff_nanos: int, head: int) -> int:
    """The earliest position whose time is at or after the cutoff (times need not ascend); the head if there is none."""
    found = log.where(F.col("ts_nanos") >= cutoff_nanos).agg(F.min("position")).first()[0]
    return head if found is None else found


def bytes_floor(segments: list[Segment], target: int, floor: int) -> tuple[int, bool]:
    """The earliest segment from which the log is at most `target` bytes, and whether that can be had; the last segment
    is indivisible."""
    total, chosen, met = 0, None, True
    for s in sorted(segments, key=lambda s: -s.base):
        total += s.bytes
        if chosen is None:
            chosen, met = s.base, total <= target
        elif total <= target:
            chosen = s.base
        else:
            break
    return (floor if chosen is None else max(chosen, floor)), met


def segment_suffixes(segments: DataFrame) -> DataFrame:
    """segments (base, bytes): adds `suffix`, the bytes from each on.  Segments are files, few beside their rows."""
    w = Window.orderBy(F.desc("base")).rowsBetween(Window.unboundedPreceding, 0)
    return segments.withColumn("suffix", F.sum("bytes").over(w))
