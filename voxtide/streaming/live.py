"""Rolling backgrounds and track linking on streams, with state per sequence.

State is what the batch operators keep per sequence: the last images, or the live tracks. Positions of a frame belong
together, so a frame is closed, and linked, once a later one of its sequence has arrived; positions of frames that
are closed already are late and are dropped, as a watermark of one frame would.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import Linking
from ..functions.linking import Linker
from ..tables import materialize, new_path, ship


#: Rows that are sent together, and bytes of an entry of state.
SENT, PIECE = 2**17, 2**20


def rolling_background(frames: DataFrame, by: str, size: int = 5, how: str = "median") -> DataFrame:
    """(by, frame, px): the median or mean of a frame and the size - 1 before it, once there are that many."""
    ship(frames.sparkSession)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("frame")
        out = []
        for frame, px in zip(rows["frame"], rows["px"], strict=True):
            if held and frame <= held[-1][0]:
                continue
            held = [*held, (int(frame), np.asarray(px, float))][-size:]
            if len(held) == size:
                stack = np.stack([p for _, p in held])
                out.append((key[0], int(frame), (np.median(stack, 0) if how == "median" else stack.mean(0)).tolist()))
        state.update((pickle.dumps(held),))
        yield pd.DataFrame(out, columns=[by, "frame", "px"])

    kind = frames.schema[by].dataType.simpleString()
    return frames.select(by, "frame", "px").groupBy(by).applyInPandasWithState(step, f"{by} {kind}, frame long, px array<double>", "held binary", "append", GroupStateTimeout.NoTimeout)


#: What streams with state in maps need of the session.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class RollingImages(StatefulProcessor):
    """The last images of a sequence, an entry each, so that a batch writes the images it brings and no others."""

    def __init__(self, by: str, size: int, how: str):
        self.by, self.size, self.how = by, size, how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("kept", "frame long", "px array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {int(k[0]): np.asarray(v[0], float) for k, v in self.kept.iterator()} if self.kept.exists() else {}
        held, newest, out = dict(before), max(before, default=None), []
        new = pd.concat(list(rows)).sort_values("frame", kind="stable")
        for frame, px in zip(new["frame"].tolist(), new["px"], strict=True):
            if newest is not None and frame <= newest:
                continue  # late, or there already
            newest, held[frame] = frame, np.asarray(px, float)
            while len(held) > self.size:
                del held[min(held)]
            if len(held) == self.size:
                stack = np.stack([held[f] for f in sorted(held)])
                out.append((key[0], frame, (np.median(stack, 0) if self.how == "median" else stack.mean(0)).tolist()))
        for frame in before.keys() - held.keys():
            self.kept.removeKey((frame,))
        for frame in held.keys() - before.keys():
            self.kept.updateValue((frame,), (held[frame].tolist(),))
        yield pd.DataFrame(out, columns=[self.by, "frame", "px"])

    def close(self) -> None:
        pass


def rolling_background_state(frames: DataFrame, by: str, size: int = 5, how: str = "median") -> DataFrame:
    """What `rolling_background` gives, with a state of `size` images a sequence whatever its length; of a batch only new images are written. Frames that aren't later than the last one seen are dropped. The stream is started with the settings of `STATE`."""
    ship(frames.sparkSession)
    kind = frames.schema[by].dataType.simpleString()
    rows = frames.select(by, F.col("frame").cast("long").alias("frame"), "px").filter("frame is not null and px is not null")
    return rows.groupBy(by).transformWithStateInPandas(RollingImages(by, size, how), f"{by} {kind}, frame long, px array<double>", "Append", "None")


class LinkedFrames(StatefulProcessor):
    """The live tracks of a sequence and the frames that are open, in pieces of `PIECE` bytes that are read and written once a batch."""

    def __init__(self, by: str, settings: Linking):
        self.by, self.settings = by, settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("kept", "piece long", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pieces = {int(k[0]): bytes(v[0]) for k, v in self.kept.iterator()} if self.kept.exists() else {}
        s = self.settings
        linker, open_, closed = pickle.loads(b"".join(pieces[k] for k in sorted(pieces))) if pieces else (Linker(s.maxdisp, s.mem, s.dim), {}, None)
        before = len(pieces)
        del pieces
        for batch in rows:
            for frame, part in batch.groupby("frame"):
                if closed is None or frame > closed:
                    open_.setdefault(int(frame), []).append(part[["x", "y", "z"]].to_numpy(float))
        done = sorted(open_)[:-1]
        for frame in done:
            at = np.concatenate(open_.pop(frame))
            at = at[np.lexsort(at.T[::-1])]
            ids, closed = linker.add(at), frame
            # a frame is sent as it is closed
            for k in range(0, len(at), SENT):
                part = pd.DataFrame(at[k : k + SENT], columns=["x", "y", "z"])
                part.insert(0, self.by, pd.Series([key[0]] * len(part), dtype=object if key[0] is None else None))
                yield part.assign(frame=frame, id=ids[k : k + SENT] + 1)
        open_ = {f: [np.concatenate(parts)] for f, parts in open_.items()}
        data = pickle.dumps((linker, open_, closed), protocol=5)
        after = -(-len(data) // PIECE)
        for k in range(after):
            self.kept.updateValue((k,), (data[k * PIECE : (k + 1) * PIECE],))
        for k in range(after, before):
            self.kept.removeKey((k,))
        if not done:
            yield pd.DataFrame([], columns=[self.by, "x", "y", "z", "frame", "id"])

    def close(self) -> None:
        pass


def link_stream(centroids: DataFrame, by: str, settings: Linking) -> DataFrame:
    """(by, x, y, z, frame, id): positions with the track they are linked to, frame by frame. Track length isn't known on a stream, so `good` is for the reader to apply. The stream is started with the settings of `STATE`."""
    ship(centroids.sparkSession)
    kind = centroids.schema[by].dataType.simpleString()
    schema = f"{by} {kind}, x double, y double, z double, frame long, id long"
    return centroids.select(by, "frame", "x", "y", "z").groupBy(by).transformWithStateInPandas(LinkedFrames(by, settings), schema, "Append", "None")


def counts_per_window(stream: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Rows per window of event time; windows close once `late` has passed."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def run_once(spark: SparkSession, stream: DataFrame, mode: str = "append", settings: dict[str, str] | None = None) -> DataFrame:
    """What a stream gives of the data that is there now, as a table in the shared folder; `settings` (those of `STATE` if none are given) hold while the stream starts."""
    path = new_path(spark, "stream")
    settings = STATE if settings is None else settings
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def counted_now(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """Windowed counts of the data that is there now, open windows included: each batch's table of counts replaces the one before."""
    last: list[DataFrame] = []

    def keep(batch: DataFrame, _: int) -> None:
        last[:] = [materialize(batch, "counts")]

    q = counts.writeStream.outputMode("complete").option("checkpointLocation", new_path(spark, "counts-state")).trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return last[0] if last else spark.createDataFrame([], counts.schema)
