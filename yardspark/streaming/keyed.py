"""Keyed state in order of event time.

Rows wait in state until the watermark is past them; then a step function sees those of a key in order, whatever the
order and the batches in which they came. State lasts until a time that the step names: an event-time timer then ends
it or turns it into another one, so that what a stream keeps does not grow with its history. A row whose time the
watermark has passed when its batch begins is late and left out. The watermark begins at 1970, so times are later.

Keys are dealt over a fixed number of groups, and a group has one timer. Waiting rows stand in state as one block of
columns for each batch that brought some, so a batch costs a few calls of the state for each group that it touches, and
not some for each row, key and timer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a step and an expiry return: the state (none: nothing is kept), rows of output without the key, and the event
#: time in microseconds until which the state lasts (none: for good).
Outcome = tuple[tuple | None, list[tuple], int | None]
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _forget(key: tuple, state: tuple, at: int) -> Outcome:
    return None, [], None


#: Groups over which the keys are dealt; each holds the rows and the states of its keys.
GROUPS = 256
_GROUP = "key_group"
#: Rows of a block of waiting rows.
_BLOCK = 200_000


class InOrder(StatefulProcessor):
    """step(key, state, t, rows) sees all rows of one time; expire(key, state, until) what is left when its time is over.

    A `whole` step(key, state, until, rows) sees all rows of a key that are due as a table in no order, with event_us, and
    itself ends the state whose time is over; its output is a table as well.
    """

    def __init__(self, keys: list[str], columns: list[str], held: T.StructType, out: T.StructType, step: Callable[..., Outcome], expire: Callable[..., Outcome], whole: bool = False):
        self.keys, self.columns, self.kinds, self.out, self.step, self.expire, self.whole = keys, columns, held, out, step, expire, whole

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "block binary")
        self.held = handle.getListState("held", self.kinds)
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        if self.whole:
            rows = self._unpacked(rows, passed)
        parts = [p.loc[p["event_us"] > passed, [*self.keys, *self.columns]] for p in rows]
        if not parts:
            return iter(())
        new = pd.concat([p for p in parts if len(p)] or parts[:1], ignore_index=True)
        if len(new):
            self.waiting.appendList(_blocks(new))
            self._wake(int(new["event_us"].min()))
        return iter(())

    def _unpacked(self, packs: Iterator[pd.DataFrame], passed: int) -> Iterator[pd.DataFrame]:
        """The rows of packs that hold late ones; the others wait as they are."""
        sound, first = [], None
        for p in packs:
            for at, block in zip(p["first_us"].tolist(), p["block"], strict=True):
                if at > passed:
                    sound.append((bytes(block),))
                    first = at if first is None else min(first, at)
                else:
                    yield pa.ipc.open_stream(block).read_pandas()
        if sound:
            self.waiting.appendList(sound)
            self._wake(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        blocks = [pa.ipc.open_stream(b).read_pandas() for (b,) in self.waiting.get()] if self.waiting.exists() else []
        waiting = pd.concat(blocks, ignore_index=True) if blocks else None
        states = {}
        if self.held.exists():
            n = len(self.keys)
            states = {tuple(r[:n]): (r[n], tuple(r[n + 1 :])) for r in self.held.get()}
        out: list[tuple] = []
        later = []
        if waiting is not None:
            due = waiting["event_us"] <= passed
            rest = waiting[~due]
            if self.whole:
                yield from self._run_whole(waiting[due], states)
            else:
                self._run(waiting[due], states, out)
            if not len(rest):
                self.waiting.clear()
            else:
                later.append(int(rest["event_us"].min()))
                if len(rest) < len(waiting) or len(blocks) > 1:
                    self.waiting.put(_blocks(rest))
        for k, (until, state) in list(states.items()):
            while state is not None and until is not None and until <= passed:
                state, more, until = self.expire(k, state, until)
                out += [(*k, *r) for r in more]
            if state is None:
                del states[k]
            else:
                states[k] = (until, state)
                if until is not None:
                    later.append(until)
        if states:
            self.held.put([(*k, until, *state) for k, (until, state) in states.items()])
        elif self.held.exists():
            self.held.clear()
        if later:
            self._wake(min(later))
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass

    def _run(self, due: pd.DataFrame, states: dict, out: list[tuple]) -> None:
        """The steps of the rows that are due, key by key in order of time."""
        due = due.sort_values([*self.keys, *self.columns[:2]], kind="stable")
        keys = list(zip(*(_plain(due[c]) for c in self.keys), strict=True))
        times, rows = due["event_us"].tolist(), list(zip(*(_plain(due[c]) for c in self.columns[1:]), strict=True))
        i = 0
        while i < len(times):
            key, t, j = keys[i], times[i], i + 1
            while j < len(times) and times[j] == t and keys[j] == key:
                j += 1
            until, state = states.get(key, (None, None))
            while state is not None and until is not None and until < t:
                state, more, until = self.expire(key, state, until)
                out += [(*key, *r) for r in more]
            state, more, until = self.step(key, state, t, rows[i:j])
            out += [(*key, *r) for r in more]
            states[key] = (until, state)
            i = j

    def _run_whole(self, due: pd.DataFrame, states: dict) -> Iterator[pd.DataFrame]:
        for key, rows in due.groupby(self.keys, sort=False):
            until, state = states.get(key, (None, None))
            state, out, until = self.step(key, state, until, rows)
            states[key] = (until, state)
            yield out.assign(**dict(zip(self.keys, key, strict=True)))[self.out.names]

    def _wake(self, at: int) -> None:
        """The group's timer: the earliest time that was asked for."""
        at, old = -(-at // 1000), self.timer.get()[0] if self.timer.exists() else None
        if old is not None and old <= at:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=self.out.names, dtype=object)
        for f in self.out.fields:
            if isinstance(f.dataType, T.TimestampType):
                frame[f.name] = pd.to_datetime(frame[f.name].astype("int64"), unit="us", utc=True)
        return frame


def _blocks(rows: pd.DataFrame) -> list[tuple]:
    """The rows as Arrow streams."""
    out = []
    for start in range(0, len(rows), _BLOCK):
        batch, sink = pa.RecordBatch.from_pandas(rows.iloc[start : start + _BLOCK], preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as stream:
            stream.write_batch(batch)
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task, a bounded number at a time, as blocks of each group's rows with their earliest time."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        rows = rows.take(pc.sort_indices(rows, [(_GROUP, "ascending")])).combine_chunks()
        groups, firsts = np.unique(rows[_GROUP].to_numpy(), return_index=True)
        rows, out = rows.drop_columns([_GROUP]), []
        for group, a, z in zip(groups.tolist(), firsts.tolist(), [*firsts.tolist(), len(rows)][1:], strict=True):
            part, sink = rows.slice(a, z - a), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as stream:
                stream.write_table(part)
            out.append((group, pc.min(part["event_us"]).as_py(), sink.getvalue().to_pybytes()))
        return pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], [_GROUP, "first_us", "block"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= _BLOCK:
            yield packed(held)
            held, n = [], 0
    if held:
        yield packed(held)


def _plain(column: pd.Series) -> list:
    """Python values, None for what is missing."""
    return column.astype(object).where(column.notna(), None).tolist() if column.hasnans else column.tolist()


def in_order(stream: DataFrame, keys: list[str], order: str, fields: list[str], state: str, out: str, step: Callable[..., Outcome], expire: Callable[..., Outcome] = _forget, late: str = "1 minute", stamp: str = "ts", only: Column | None = None, whole: bool = False) -> DataFrame:
    """(keys, out): what step and expire make of the rows (order, fields) of each key in order of `stamp`, then `order`.

    state, out: columns of the state and of the output, such as "at long"; times in output of the kind timestamp are
    given in microseconds. whole: a step gets all rows of a key that are due, as a table. only: rows that count; others,
    such as a clock's, just move the watermark. Output comes when the watermark is past it, in append mode. Sets the
    session's state store to the one that has timers (RocksDB).
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    rows = stream.withWatermark(stamp, late)
    # one condition that names the event time: parts of it that do not would be moved in front of the watermark
    sound = [F.col(c).isNotNull() for c in (stamp, *keys)] + ([F.coalesce(only, F.lit(False))] if only is not None else [])
    rows = rows.filter(F.array_min(F.array(*sound)))
    rows = rows.select(*keys, stamp, F.unix_micros(stamp).alias("event_us"), order, *fields)
    rows = rows.withColumn(_GROUP, F.pmod(F.hash(*keys), F.lit(GROUPS)))
    own = [rows.schema[k] for k in keys]
    held = T.StructType([*own, T.StructField("until", T.LongType()), *T._parse_datatype_string(state).fields])
    schema = T.StructType([*own, *T._parse_datatype_string(out).fields])
    worker = InOrder(keys, ["event_us", order, *fields], held, schema, step, expire, whole)
    if whole:  # Spark hands rows to keyed state one by one, blocks of them as they are
        rows = rows.select(_GROUP, *keys, "event_us", order, *fields).mapInArrow(_pack, f"{_GROUP} int, first_us long, block binary")
    return rows.groupBy(_GROUP).transformWithStateInPandas(worker, schema, "append", "EventTime")
