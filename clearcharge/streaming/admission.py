"""Admission per address: at most n admitted attempts in any hour, rejected ones not counted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clearcharge import fixed_values as fv
from clearcharge.operators import positions
from clearcharge.session import materialise

OUTPUT = "address string, attempt_id bigint, ts timestamp, admitted boolean, wait_seconds bigint"
STATE = "recent array<double>"


def admit(attempts: list[tuple[int, float]], recent: list[float], limit: int, window: float = fv.ADMISSION_WINDOW_SECONDS) -> tuple[list[tuple[bool, int]], list[float]]:
    """Decide attempts (id, epoch seconds) in time order; `recent` holds admitted times and
    never grows past `limit`."""
    said = []
    for _, now in attempts:
        recent = [t for t in recent if now - t < window]
        if len(recent) >= limit:
            said.append((False, round(window - (now - recent[0])) or 1))
        else:
            recent.append(now)
            said.append((True, 0))
    return said, recent


def admission_stream(attempts: DataFrame, limit: int) -> DataFrame:
    """`attempts`: address, attempt_id, ts. State per address is its last admitted times, so
    an address with most of the attempts streams through in batches and keeps `limit` numbers."""
    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ts", "attempt_id"])
        seconds = rows["ts"].astype("datetime64[us]").astype("int64") / 1e6
        said, recent = admit(list(zip(rows["attempt_id"], seconds)), recent, limit)
        state.update((recent,))
        yield rows[["attempt_id", "ts"]].assign(address=key[0], admitted=[a for a, _ in said], wait_seconds=[w for _, w in said])[
            ["address", "attempt_id", "ts", "admitted", "wait_seconds"]]

    return attempts.groupBy("address").applyInPandasWithState(fold, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def _walk(times: np.ndarray, recent: list[int], limit: int, window: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Decide attempts at rising times (microseconds): whether each is admitted, the time of the admitted one that
    stands in the way otherwise, and the admitted times that still count at the end. After a refusal the next attempt
    that can be admitted is looked up, so the steps are as many as the admissions."""
    admitted, blocked_by = np.zeros(len(times), bool), np.zeros(len(times), np.int64)
    at = 0
    while at < len(times):
        now = int(times[at])
        while recent and now - recent[0] >= window:
            recent = recent[1:]
        if len(recent) < limit:
            admitted[at] = True
            recent = [*recent, now]
            at += 1
        else:
            free = at + int(np.searchsorted(times[at:], recent[0] + window))
            blocked_by[at:free] = recent[0]
            at = free
    return admitted, blocked_by, recent


def admission_batch(attempts: DataFrame, limit: int, window: float = fv.ADMISSION_WINDOW_SECONDS, part_rows: int | None = None) -> DataFrame:
    """The same decisions over landed attempts.

    An address is cut into parts by time, so one with all the attempts spreads over tasks. Every part is first decided
    as if nothing had been admitted before it; a part whose start differs from what the part before left is decided
    again, until nothing differs. Decisions of a quiet hour forget what came before, so a few rounds settle all parts
    but in an address that is at its limit without end; there a round settles at least one more part of it."""
    span = int(window * 1_000_000)
    rows = positions.dealt(attempts.select("address", "attempt_id", "ts"), ["address"], [F.col("ts"), F.col("attempt_id")], part_rows)
    rows = rows.withColumn("t", F.unix_micros("ts"))
    starts = materialise(rows.groupBy("address", "_part").agg(F.min("t").alias("first")), "admission-parts")

    def ends(key: tuple, times: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        recent = [int(x) for x in entries["recent"].iloc[0]] if len(entries) else []
        _, _, left = _walk(np.sort(times["t"].to_numpy()), recent, limit, span)
        return pd.DataFrame({"address": [key[0]], "_part": [key[1]], "recent": [recent], "left": [left]})

    def decided_by(entries: DataFrame, fn, ddl: str, some: DataFrame) -> DataFrame:
        return some.groupBy("address", "_part").cogroup(entries.groupBy("address", "_part")).applyInPandas(fn, ddl)

    none = F.array().cast("array<bigint>")
    ddl = "address string, _part int, recent array<bigint>, left array<bigint>"
    known = materialise(decided_by(starts.select("address", "_part", none.alias("recent")), ends, ddl, rows.select("address", "_part", "t")), "admission-ends")
    before = F.lag("left").over(Window.partitionBy("address").orderBy("_part"))
    while True:
        entering = known.join(starts, ["address", "_part"]).withColumn("entering", F.coalesce(before, none))
        entering = entering.withColumn("entering", F.filter("entering", lambda x: F.col("first") - x < span))
        wrong = materialise(entering.filter(F.col("entering") != F.col("recent")).select("address", "_part", F.col("entering").alias("recent")), "admission-wrong")
        if wrong.limit(1).count() == 0:
            break
        some = rows.select("address", "_part", "t").join(wrong.select("address", "_part"), ["address", "_part"], "left_semi")
        again = decided_by(wrong, ends, ddl, some)
        known = materialise(known.join(wrong.select("address", "_part"), ["address", "_part"], "left_anti").unionByName(again), "admission-ends")

    def decisions(key: tuple, part: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["t", "attempt_id"])
        times = part["t"].to_numpy()
        admitted, blocked_by, _ = _walk(times, [int(x) for x in entries["recent"].iloc[0]], limit, span)
        wait = np.where(admitted, 0, np.maximum(np.rint((span - (times - blocked_by)) / 1e6), 1)).astype(np.int64)
        return part[["address", "attempt_id", "ts"]].assign(admitted=admitted, wait_seconds=wait)

    return decided_by(known.select("address", "_part", "recent"), decisions, OUTPUT, rows.select("address", "_part", "attempt_id", "ts", "t"))
