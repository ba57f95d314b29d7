"""Stateful filters of members on streams, with the semantics of the batch filters.

Rows need a key and, within a micro-batch, an arrival number: Spark keeps no order of its own.
State lives in the state store and is as durable as the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType, TimestampNTZType


class _Latest(StatefulProcessor):
    """Keeps the greatest value of a column for each key; passes rows that exceed it."""

    def __init__(self, column: str, arrival: str):
        self.column, self.arrival = column, arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", StructType([StructField("v", TimestampNTZType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values(self.arrival, kind="stable")
        known = self.state.get()
        best = pd.Timestamp(known[0]) if known is not None else None
        passed = []
        for at, value in zip(frame.index, frame[self.column], strict=True):
            if best is None or value > best:
                best = value
                passed.append(at)
        if best is not None:
            self.state.update((best.to_pydatetime(),))
        yield frame.loc[passed]

    def close(self) -> None:
        pass


class _Changed(StatefulProcessor):
    """Keeps the last digest of each key; passes rows with another one."""

    def __init__(self, column: str, arrival: str):
        self.column, self.arrival = column, arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("digest", StructType([StructField("v", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values(self.arrival, kind="stable")
        known = self.state.get()
        last = known[0] if known is not None else None
        passed = []
        for at, value in zip(frame.index, frame[self.column], strict=True):
            if value != last:
                last = value
                passed.append(at)
        self.state.update((last,))
        yield frame.loc[passed]

    def close(self) -> None:
        pass


class _First(StatefulProcessor):
    """Remembers that a key has been met; passes its first row."""

    def __init__(self, arrival: str):
        self.arrival = arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("met", StructType([StructField("v", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values(self.arrival, kind="stable")
        met = self.state.exists()
        self.state.update(("1",))
        yield frame.iloc[: 0 if met else 1]

    def close(self) -> None:
        pass


def exactly_once(members: DataFrame, key: str = "member_id", watermark: tuple[str, str] | None = None, arrival: str = "arrival_seq") -> DataFrame:
    """The first arrival of each member; with a watermark (column, delay) any one of those in a micro-batch,
    and the state is bounded by the delay."""
    if watermark is None:
        return members.groupBy(key).transformWithStateInPandas(_First(arrival), members.schema, "Append", "None")
    return members.withWatermark(*watermark).dropDuplicatesWithinWatermark([key])


def latest_state(members: DataFrame, key: str = "version_of", timestamp: str = "ts", arrival: str = "arrival_seq") -> DataFrame:
    """Members newer than all before of the same entity; ``timestamp`` is a wall-clock time."""
    return members.groupBy(key).transformWithStateInPandas(_Latest(timestamp, arrival), members.schema, "Append", "None")


def changed(members: DataFrame, key: str = "member_id", digest: str = "hash", arrival: str = "arrival_seq") -> DataFrame:
    """Members whose digest differs from the last one of the same key."""
    return members.groupBy(key).transformWithStateInPandas(_Changed(digest, arrival), members.schema, "Append", "None")
