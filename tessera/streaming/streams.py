"""Structured Streaming: frames as they arrive, and the ledger of chunk attempts.

Each function takes and gives a streaming (or plain) table; ``run_available`` drives one to
the end of what is there, for batch use and tests.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.ledger import CHUNK_FAILURES, JOB_ERRORS
from ..operators.segment import boxed
from ..sources.io import append_corrections
from ..sources.shared import shared_dir

#: Side in pixels of the tiles that motion is kept by.
TILE = 64
#: Jobs, as a power of two, whose silences are kept under one key: a run of ids.
RUN = 6
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(df: DataFrame, mode: str = "append") -> DataFrame:
    """The result of the stream over all that is available, as a table in the shared folder.

    Update mode keeps each batch's rows with their ``batch`` number.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{root}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{out}/part-{number}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(f"{out}/*")


def stream_frames(frames: DataFrame, ranges: DataFrame) -> DataFrame:
    """The key mask of frames as they come, by the static background ranges; no state."""
    return boxed(frames, ranges, 0)


def stream_progress(events: DataFrame, late: str = "30 days") -> DataFrame:
    """(job_id, completed): chunks completed, each once however often it is reported; update mode."""
    d = events.where("result = 'ok'").withWatermark("ts", late).dropDuplicatesWithinWatermark(["job_id", "chunk_id"])
    return d.groupBy("job_id").agg(F.count(F.lit(1)).alias("completed"))


class _InOrder(StatefulProcessor):
    """Rows of a key held back until the watermark has passed them, and then taken in order of (us, event_id).

    A subclass has ``fields``, the columns that it keeps of a row, all whole numbers, with ``us`` and
    ``event_id`` first (one that the rows lack is the key itself), ``states`` to open its own, and ``taken`` for the rows that are final up to
    the watermark. A timer brings the key back when its first waiting row is due.

    Each call to a state costs a round trip, so rows wait packed, a batch's in one entry that is
    added to the others unread, and a key is read and taken only when a row of it is due.
    """

    fields = ("us", "event_id")
    out = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.first = handle.getValueState("first", "us bigint")
        self.states(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for batch in rows:
            real = zip(*(batch[c].tolist() if c in batch else key * len(batch) for c in (*self.fields, "result")), strict=True)
            new += [[*(int(v) for v in r[:-1]), r[-1] == "ok"] for r in real if r[-1] in ("ok", "failed")]
        if new:
            yield from self._drain(key, timerValues.getCurrentWatermarkInMs(), new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._drain(key, timerValues.getCurrentWatermarkInMs(), [])

    def _drain(self, key, mark: int, new: list[list]) -> Iterator[pd.DataFrame]:
        first = self.first.get()
        first = first[0] if first else None
        due = first is not None and first <= mark * 1000
        ready = []
        if due or new and min(new)[0] <= mark * 1000:
            held = [] if first is None else [r for packed in self.waiting.get() for r in self._rows(packed[0])]
            rows = sorted(held + new)
            n = sum(r[0] <= mark * 1000 for r in rows)
            ready, left = rows[:n], rows[n:]
            if left:
                self.waiting.put([self._packed(left)])
                first = self._wake(left[0][0])
            elif first is not None:
                self.waiting.clear()
                self.first.clear()
                first = None
        elif new:
            self.waiting.appendList([self._packed(new)])
            if first is None or min(new)[0] < first:
                self._wake(min(new)[0])
            return
        out = self.taken(key, mark, ready, first)
        if out:
            yield pd.DataFrame(out, columns=list(self.out))

    def _wake(self, us: int) -> int:
        self.first.update((us,))
        self.handle.registerTimer(us // 1000 + 1)
        return us

    def _packed(self, rows: list[list]) -> tuple[bytes]:
        return (np.array(rows, np.int64).tobytes(),)

    def _rows(self, packed: bytes) -> list[list]:
        return np.frombuffer(packed, np.int64).reshape(-1, len(self.fields) + 1).tolist()

    def close(self) -> None:
        pass


class _Attempts(_InOrder):
    """A job's failures by chunk, its errors, and what has ended; forgotten ``keep`` after its last attempt."""

    fields = ("us", "event_id", "chunk_id")
    out = ("job_id", "chunk_id", "event_id", "outcome")

    def __init__(self, keep: int):
        self.keep = keep

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", "errors int, failed boolean, last bigint")
        self.chunks = handle.getMapState("chunks", "chunk_id int", "fails int, done boolean")

    def taken(self, key, mark: int, rows: list[list], first: int | None) -> list[tuple]:
        job = self.job.get()
        if job is None and not rows:
            return []
        errors, failed, last = job or (0, False, 0)
        known = job is not None  # a job not met before has no chunks
        out, touched, old = [], {}, {}
        for us, event, chunk, ok in rows:
            if last and us > last + self.keep * 1000:
                if known:
                    self.chunks.clear()
                known, errors, failed, touched, old = False, 0, False, {}, {}
            last = max(last, us)
            if chunk not in touched:
                touched[chunk] = old[chunk] = tuple(self.chunks.getValue((chunk,))) if known and self.chunks.containsKey((chunk,)) else (0, False)
            fails, done = touched[chunk]
            if failed or done or fails >= CHUNK_FAILURES:
                continue
            if ok:
                done = True
                out.append((key[0], chunk, event, "completed"))
            else:
                fails, errors = fails + 1, errors + 1
                if fails == CHUNK_FAILURES:
                    out.append((key[0], chunk, event, "failed"))
                elif errors >= JOB_ERRORS:
                    failed = True
                    out.append((key[0], chunk, event, "job_failed"))
            touched[chunk] = (fails, done)
        if mark >= last // 1000 + self.keep and (first is None or first > last + self.keep * 1000):
            if job is not None:
                self.job.clear()
            if known:
                self.chunks.clear()
        elif rows:
            for chunk, state in touched.items():
                if state != old[chunk]:
                    self.chunks.updateValue((chunk,), state)
            self.job.update((errors, failed, last))
            self.handle.registerTimer(last // 1000 + self.keep)
        return out


def stream_attempts(events: DataFrame, late: str = "1 day", keep: str = "30 days") -> DataFrame:
    """(job_id, chunk_id, event_id, outcome) as chunks and jobs end; needs the RocksDB state store.

    Attempts count in order of (ts, event_id), in whatever order they arrive within ``late``:
    each waits until the watermark has passed it. A job is forgotten ``keep`` after its last
    attempt: its state is dropped, and a later attempt begins anew. Rows whose result is neither ok nor failed only carry time forward.
    """
    d = events.select("job_id", F.col("chunk_id").cast("int").alias("chunk_id"), "event_id", "ts", F.unix_micros("ts").alias("us"), "result").withWatermark("ts", late)
    return d.groupBy("job_id").transformWithStateInPandas(_Attempts(_ms(keep)), "job_id bigint, chunk_id int, event_id bigint, outcome string", "append", "EventTime")


def _ms(span: str) -> int:
    """A span such as "10 minutes" in milliseconds."""
    return int(pd.Timedelta(span).total_seconds() * 1000)


class _Motion(StatefulProcessor):
    """The last grey of each pixel of a tile and where it has moved, as two packed arrays, and numpy over a batch's rows."""

    def __init__(self, thr: int):
        self.thr = thr

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tile = handle.getValueState("tile", "last binary, moved binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows))
        y, x, frame, v = (d[c].to_numpy() for c in ("y", "x", "frame", "v"))
        if self.tile.exists():
            last, moved = (np.frombuffer(b, t).copy() for b, t in zip(self.tile.get(), (np.int16, np.bool_), strict=True))
        else:  # a place without a pixel so far is -1
            last, moved = np.full(TILE * TILE, -1, np.int16), np.zeros(TILE * TILE, bool)
        at = (y % TILE) * TILE + x % TILE
        order = np.lexsort((frame, at))
        at, v, frame = at[order], v[order].astype(np.int16), frame[order]
        first = np.diff(at, prepend=-1) != 0
        before = np.where(first, last[at], np.roll(v, 1))
        hit = np.flatnonzero((before >= 0) & (np.abs(v - before) > self.thr) & ~moved[at])
        places, k = np.unique(at[hit], return_index=True)
        end = np.append(np.flatnonzero(first)[1:], len(at)) - 1
        last[at[end]] = v[end]
        moved[places] = True
        self.tile.update((last.tobytes(), moved.tobytes()))
        own = order[hit[k]]
        yield pd.DataFrame({"clip_id": np.full(len(own), key[0], np.int32), "y": y[own].astype(np.int32), "x": x[own].astype(np.int32), "frame": frame[hit[k]].astype(np.int32)})

    def close(self) -> None:
        pass


def stream_motion(gray: DataFrame, thr: int = 15) -> DataFrame:
    """(clip_id, y, x, frame): pixels of gray frames (clip_id, frame, y, x, v) when they first move; keyed by tiles.

    Frames of a tile arrive in order; within a batch they may be in any.
    """
    d = gray.withColumn("tile", F.concat_ws("/", F.floor(F.col("y") / TILE), F.floor(F.col("x") / TILE)))
    return d.groupBy("clip_id", "tile").transformWithStateInPandas(_Motion(thr), "clip_id int, y int, x int, frame int", "append", "none")


class _Silence(_InOrder):
    """The running sessions of a run of jobs; a timer tells of a silence while it lasts.

    Calls to a state cost more than a job's rows, so the jobs of a run wait and are kept together.
    """

    fields = ("us", "event_id", "job_id")
    out = ("job_id", "us", "n")

    def __init__(self, gap: int):
        self.gap = gap * 1000

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.sessions = handle.getValueState("sessions", "packed binary")

    def taken(self, key, mark: int, rows: list[list], first: int | None) -> list[tuple]:
        packed = self.sessions.get()
        held = {job: (n, last) for job, n, last in np.frombuffer(packed[0], np.int64).reshape(-1, 3).tolist()} if packed else {}
        ended = []
        for us, _, job, _ in rows:
            n, last = held.get(job, (0, 0))
            if n and us - last >= self.gap:
                ended.append((job, last, n))
                n = 0
            held[job] = (n + 1, us)
        over = [job for job, (_, last) in held.items() if mark * 1000 >= last + self.gap]
        for job in over:
            n, last = held.pop(job)
            ended.append((job, last, n))
        if held and (rows or over):
            self.sessions.update((np.array([(job, *session) for job, session in held.items()], np.int64).tobytes(),))
            self.handle.registerTimer((min(last for _, last in held.values()) + self.gap) // 1000 + 1)
        elif packed and not held:
            self.sessions.clear()
        return [(None, *e[1:]) for e in ended] if key[0] is None else ended


def stream_stall(events: DataFrame, gap: str = "10 minutes", late: str = "1 day") -> DataFrame:
    """(job_id, silent_from, n): a job's last event, after ``n`` without a longer pause, as soon as time is ``gap`` beyond it.

    A timer flags a silence that still lasts, when the watermark (``late`` behind the newest
    event of any job) has passed its end; needs the RocksDB state store. Rows with a result
    that is neither ok nor failed only carry time forward.
    """
    given = {"event_id": F.lit(0).cast("bigint"), "result": F.lit("ok")} | {c: F.col(c) for c in events.columns}
    run = F.shiftright(F.col("job_id").cast("bigint"), RUN).alias("run")
    job = F.coalesce(F.col("job_id").cast("bigint"), F.lit(0)).alias("job_id")  # rows without a job are a run of their own
    d = events.select(run, job, given["event_id"].alias("event_id"), "ts", F.unix_micros("ts").alias("us"), given["result"].alias("result")).withWatermark("ts", late)
    s = d.groupBy("run").transformWithStateInPandas(_Silence(_ms(gap)), "job_id bigint, us bigint, n bigint", "append", "EventTime")
    return s.select("job_id", F.timestamp_micros("us").alias("silent_from"), "n")


def stream_corpus(corrections: DataFrame, path: str, checkpoint: str):
    """Appends arriving corrections to the corpus at ``path``; returns the running query."""
    return corrections.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda b, _: append_corrections(b, path)).start()
