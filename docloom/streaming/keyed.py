"""Keyed streaming state with event-time timers: throttle, debounce, last value, bounded queues.

Rows wait in the state of their group of keys until the watermark has passed them; then they are taken in the order of
time, whatever files or micro-batches they came in. So the results are those of the batch forms, as long as rows come
no later than `late` after newer ones (later ones are dropped by the watermark). A group (one of GROUPS, by a hash of the key) holds the rows of the
last `late` as Arrow tables, and what the operator carries for each key; a timer removes that too when it can no longer matter. So state is
read and written a few times a group and micro-batch, however many keys there are, and keys are worked on together.

Rows are of scalar columns. Whole numbers and the like go through Python as text, as pandas would make nullable ones
floats. Queries need the RocksDB state store: `started` sets it for the query it starts. Rows without a time
have no place in the order and are left out. The last `late` of a stream comes out when newer rows
have moved the watermark past it.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.types import BinaryType, DoubleType, IntegralType, LongType, StringType, StructField, StructType

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
NEVER = np.iinfo(np.int64).max


@contextlib.contextmanager
def _store(spark) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def started(writer: DataStreamWriter) -> StreamingQuery:
    """writer.start() with the state store that these operators need; the session keeps its own."""
    with _store(writer._spark):
        return writer.start()


#: Groups into which keys are hashed; each has one state. A group's rows of the last `late` are held in Python when they come out.
GROUPS = 1024
#: Rows in an element of a group's state.
PART = 10_000
_ELEMENT = StructType([StructField("first", LongType()), StructField("data", BinaryType())])


def _stored(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _loaded(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


class Carrier:
    """How rows travel: doubles and strings as they are, all else as text; with each its key as text (KEY) and a time in
    microseconds (AT) at which it is due."""

    KEY, AT = "__key", "__at"

    def __init__(self, fields: StructType, ts: str, order: list[str]) -> None:
        self.ts, self.order, self.fields = ts, order, fields
        self.whole = {o for o in order if isinstance(fields[o].dataType, IntegralType)}
        kind = lambda f: LongType() if f.name == ts else f.dataType if isinstance(f.dataType, DoubleType) else StringType()
        self.sent = StructType([StructField(f.name, kind(f)) for f in fields])
        self.held = pa.schema([(f.name, {LongType: pa.int64(), DoubleType: pa.float64()}.get(type(f.dataType), pa.string())) for f in self.sent]
                              + [(self.KEY, pa.string()), (self.AT, pa.int64())])

    def outbound(self, rows: DataFrame, key: str, at: Column, late: str) -> DataFrame:
        """rows as Python gets them, with their group; the time itself goes along for the watermark."""
        timed = rows.withColumns({self.KEY: _said(key), self.AT: at}).withWatermark(self.ts, late).where(F.col(self.ts).isNotNull())
        micros = F.unix_micros(F.col(self.ts).cast("timestamp"))
        sent = [micros.alias("__micros") if f.name == self.ts else F.col(f.name).cast(f.dataType).alias(f.name) for f in self.sent]
        group = F.pmod(F.xxhash64(key, *([self.AT] if self.shared else [])), F.lit(GROUPS)).alias("__group")
        return timed.select(group, self.ts, *sent, self.KEY, self.AT)

    #: Whether rows of a key that are due at different times may be in different groups.
    shared = False

    def inbound(self, rows: DataFrame) -> DataFrame:
        at = F.timestamp_micros(F.col(self.ts))
        return rows.select(*[(at if f.name == self.ts else F.col(f.name)).cast(f.dataType).alias(f.name) for f in self.fields])

    def taken(self, pdf: pd.DataFrame) -> pd.DataFrame:
        """What came in, in the columns that are held, by place: Spark renames those that begin with an underscore."""
        return pdf.iloc[:, 2:].set_axis(self.held.names, axis=1)

    def stored(self, pdf: pd.DataFrame) -> list[tuple[int, bytes]]:
        """pdf as elements of the state, with the first time at which one of its rows is due."""
        parts = [pdf.iloc[i : i + PART] for i in range(0, len(pdf), PART)]
        return [(int(p[self.AT].min()), _stored(pa.Table.from_pandas(p, self.held, preserve_index=False))) for p in parts]

    def loaded(self, elements: list) -> pd.DataFrame:
        tables = [_loaded(bytes(data)) for _, data in elements]
        return pa.concat_tables([self.held.empty_table(), *tables]).to_pandas()

    def line(self, pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        """pdf in the order of key, time and order, nulls first, and where each key begins, with the end."""
        ranks = []
        for o in reversed(self.order):
            own = pdf[o].notna().to_numpy()
            if o in self.whole:
                rank = np.zeros(len(pdf), np.int64)
                rank[own] = pdf[o].to_numpy(object)[own].astype(np.int64)
            else:
                rank = pd.factorize(pdf[o], sort=True)[0]
            ranks += [rank, own]
        codes = pd.factorize(pdf[self.KEY])[0]
        place = np.lexsort((*ranks, pdf[self.ts].to_numpy(), codes))
        codes = codes[place]
        cuts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1], [True]])) if len(codes) else np.zeros(1, np.int64)
        return pdf.iloc[place].reset_index(drop=True), cuts


def _said(key: str):
    """A key as text that is never null: pandas would make nullable whole numbers floats."""
    return F.to_json(F.struct(F.col(key).alias("k")))


class Grouped(StatefulProcessor):
    """Rows of a group of keys wait until the watermark has passed the time at which they are due; one timer a group."""

    rows: Carrier

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ELEMENT)
        self.alarm = handle.getValueState("alarm", StructType([StructField("ms", LongType())]))

    def _ring(self, first: int) -> None:
        """Sets the group's timer to the microsecond first, NEVER: to none."""
        at = None if first == NEVER else -(-first // 1000)
        now = self.alarm.get()[0] if self.alarm.exists() else None
        if at == now:
            return
        if now is not None:
            self.handle.deleteTimer(now)
            self.alarm.clear()
        if at is not None:
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def _ring_before(self, first: int) -> None:
        """As _ring, unless the timer is earlier."""
        self._ring(min(first, self.alarm.get()[0] * 1000) if self.alarm.exists() else first)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        first = NEVER
        for pdf in rows:
            if len(pdf):
                new = self.rows.stored(self.rows.taken(pdf))
                self.waiting.appendList(new)
                first = min(first, *(f for f, _ in new))
        if first < NEVER:
            self._ring_before(first)
        return iter(())

    def _due(self, passed: int) -> tuple[pd.DataFrame, int]:
        """The rows that are due, taken out of the state, and the time of the first one that stays."""
        held = [(e[0], bytes(e[1])) for e in self.waiting.get()] if self.waiting.exists() else []
        pdf = self.rows.loaded([e for e in held if e[0] <= passed])
        due = (pdf[self.rows.AT] <= passed).to_numpy()
        rest = [e for e in held if e[0] > passed] + self.rows.stored(pdf[~due])
        if due.any():
            self.waiting.put(rest) if rest else self.waiting.clear()
        return pdf[due], min((f for f, _ in rest), default=NEVER)

    def close(self) -> None:
        pass


class InOrder(Grouped):
    """Hands the rows to `step` in the order of time, key by key, when the watermark has passed them.

    step(times, cuts, rows, known, carried) gets int64 microseconds, where each key's rows begin, with the end, the rows, and for each key whether
    it carries something and what (a row of longs); it changes these two to what is carried on and returns the rows that come out.
    expires(carried) gives the times in microseconds after which carried rows have no effect, NEVER if there is none.
    """

    def __init__(self, rows: Carrier, carries: int, step: Callable, expires: Callable) -> None:
        self.rows, self.carries, self.step, self.expires = rows, carries, step, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.carried = handle.getValueState("carried", StructType([StructField("data", BinaryType())]))

    def _carried(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys that carry something, and what."""
        if not self.carried.exists():
            return np.zeros(0, object), np.zeros((0, self.carries), np.int64)
        key, *longs = _loaded(bytes(self.carried.get()[0])).columns
        return key.to_numpy(), np.stack([c.to_numpy() for c in longs], axis=1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.alarm.clear()
        ready, first = self._due(passed)
        ready, cuts = self.rows.line(ready)
        keys, carried = self._carried()
        had = len(keys)
        out = None
        if len(ready):
            mine = ready[self.rows.KEY].to_numpy(object)[cuts[:-1]]
            at = pd.Index(keys, dtype=object).get_indexer(mine)
            known = at >= 0
            values = np.zeros((len(mine), self.carries), np.int64)
            values[known] = carried[at[known]]
            out = self.step(ready[self.rows.ts].to_numpy(), cuts, ready, known, values)
            others = np.ones(len(keys), bool)
            others[at[at >= 0]] = False
            keys, carried = np.concatenate([keys[others], mine[known]]), np.concatenate([carried[others], values[known]])
        ends = self.expires(carried)
        stay = ends > passed
        if stay.any():
            names = ["key", *(f"c{i}" for i in range(self.carries))]
            table = pa.table([pa.array(keys[stay], pa.string()), *(pa.array(carried[stay, i]) for i in range(self.carries))], names)
            self.carried.update((_stored(table),))
        elif had:
            self.carried.clear()
        self._ring(min(first, int(ends[stay].min()) if stay.any() else NEVER))
        if out is not None and len(out):
            yield out[self.rows.sent.names]


def _in_order(events: DataFrame, key: str, ts: str, late: str, carries: int, order: list[str], step: Callable, expires: Callable) -> DataFrame:
    rows = Carrier(events.schema, ts, order)
    timed = rows.outbound(events, key, F.unix_micros(F.col(ts).cast("timestamp")), late)
    work = InOrder(rows, carries, step, expires)
    out = timed.groupBy("__group").transformWithStateInPandas(statefulProcessor=work, outputStructType=rows.sent, outputMode="Append", timeMode="eventTime")
    return rows.inbound(out)


def spaced(times: np.ndarray, reach: int, last: int | None) -> tuple[np.ndarray, int | None]:
    """Places of the rows that pass: each at least reach after the one before. One jump for each of them."""
    places, at = [], 0 if last is None else int(np.searchsorted(times, last + reach))
    while at < len(times):
        places.append(at)
        last = int(times[at])
        at = max(at + 1, int(np.searchsorted(times, last + reach)))
    return np.array(places, np.int64), last


def throttled_stream(events: DataFrame, key: str, gap: float = 2.0, inclusive: bool = False, ts: str = "ts", order: str | None = None, late: str = "10 seconds") -> DataFrame:
    """The streaming form of `throttle.throttled`. A key carries the time of its last row that passed, until the
    watermark is a gap further."""
    reach = round(gap * 1_000_000) + (not inclusive)

    def step(times, cuts, rows, known, carried):
        places = []
        for i, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            own, carried[i, 0] = spaced(times[a:z], reach, int(carried[i, 0]) if known[i] else None)
            places.append(own + a)
        known[:] = True
        return rows.iloc[np.concatenate(places)]

    return _in_order(events, key, ts, late, 1, [order] if order else [], step, lambda c: c[:, 0] + reach)


def held_stream(events: DataFrame, key: str, value: str, ts: str = "ts", order: str | None = None, late: str = "10 seconds", keep: float | None = None) -> DataFrame:
    """The streaming form of `throttle.last_value`: events with `held`, the last value (a long) so far that is not null. keep:
    seconds of event time after which a value is forgotten; without it a key that has a value keeps one number."""
    span = None if keep is None else round(keep * 1_000_000)

    def step(times, cuts, rows, known, carried):
        own, n = rows[value].notna().to_numpy(), np.diff(cuts)
        numbers = np.zeros(len(rows), np.int64)
        numbers[own] = rows[value].to_numpy(object)[own].astype(np.int64)
        place = np.maximum.accumulate(np.where(own, np.arange(len(rows)), -1))
        here = place >= np.repeat(cuts[:-1], n)
        before = np.repeat(np.arange(len(n)), n)
        got, since = np.where(here, numbers[place], carried[before, 0]), np.where(here, times[place], carried[before, 1])
        some = here | known[before]
        last = cuts[1:] - 1
        carried[:, 0], carried[:, 1], known[:] = got[last], since[last], some[last]
        if span is not None:
            some &= times - since <= span
        return rows.assign(held=np.where(some, got.astype(str).astype(object), None))

    asked = events.withColumn("held", F.lit(None).cast("long"))
    return _in_order(asked, key, ts, late, 2, [order] if order else [], step, lambda c: np.full(len(c), NEVER) if span is None else c[:, 1] + span)


class Queue(Grouped):
    """Queues of a group of keys and intervals: at most `size` rows each wait, and come out by a timer at the interval's end. The
    rows that stay are the first (or, with newest, the last) in the order of time, whenever they come."""

    def __init__(self, rows: Carrier, size: int, newest: bool) -> None:
        self.rows, self.size, self.newest = rows, size, newest

    def _kept(self, pdf: pd.DataFrame) -> pd.DataFrame:
        line, _ = self.rows.line(pdf)
        queues = line.groupby([self.rows.KEY, self.rows.AT], sort=False)
        return queues.tail(self.size) if self.newest else queues.head(self.size)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = self.rows.loaded(list(self.waiting.get()) if self.waiting.exists() else [])
        for pdf in rows:
            kept = self._kept(pd.concat([kept, self.rows.taken(pdf)], ignore_index=True))
        self.waiting.put(self.rows.stored(kept))
        self._ring_before(int(kept[self.rows.AT].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.alarm.clear()
        out, first = self._due(timerValues.getCurrentWatermarkInMs() * 1000)
        self._ring(first)
        if len(out):
            yield out[self.rows.sent.names]


def _ends(events: DataFrame, key: str, every: str, ts: str, order: str, late: str, newest: bool) -> DataFrame:
    """The first or last row of each key and interval, as an aggregate of Spark's."""
    timed = events.withWatermark(ts, late).where(F.col(ts).isNotNull())
    best = (F.max_by if newest else F.min_by)(F.struct(*events.columns), F.struct(ts, order))
    return timed.groupBy(F.window(ts, every), F.col(key).alias("__key")).agg(best.alias("__r")).select("__r.*")


def queued_stream(events: DataFrame, key: str, size: int, every: str = "1 second", ts: str = "ts", order: str = "event_id", late: str = "10 seconds", newest: bool = False) -> DataFrame:
    """What queues of `size` places hand on that are emptied at the end of every interval: the first rows
    of each key and interval, or with newest the last ones; the others are dropped. The streaming form of `workers.queued`."""
    if size == 1:
        return _ends(events, key, every, ts, order, late, newest)
    rows = Carrier(events.schema, ts, [order])
    rows.shared = True
    cut = rows.outbound(events, key, F.unix_micros(F.window(ts, every)["end"].cast("timestamp")), late)
    work = Queue(rows, size, newest)
    return rows.inbound(cut.groupBy("__group").transformWithStateInPandas(statefulProcessor=work, outputStructType=rows.sent, outputMode="Append", timeMode="eventTime"))
