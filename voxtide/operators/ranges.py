"""Tracks of long sequences: time ranges are linked side by side, and only those that began wrongly again.

Linking a frame depends on the tracks that are alive, by their last positions and ages. A time range is linked from
the live set that some frames before it leave behind, starting from none: mostly that is what the range before ends
with. Where it isn't, the range is linked again from what the range before ended with; ranges whose start then no longer
fits follow, until all fit. The result is that of linking the whole sequence frame by frame, in whatever way frames are
cut. A track that goes on from one range into the next has a number in both; the pairs of numbers are chains, which
are followed by doubling.

Rows come sorted: a task holds the positions of one frame and the live tracks, whatever the size of its range. Nothing is keyed by the
sequence alone but a row per frame, from which ranges are made. Live tracks are kept in the order of their positions, so
a tie doesn't depend on when a track began.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Linking
from ..functions.linking import Linker
from ..tables import materialize, ship
from .correlated import ranked
from .tracking import usable

RANGE_POINTS = 200_000
#: Frames before a range, beyond those that a particle may be missing, from which its live set is guessed.
WARM = 5
#: Rows that are sent together.
SENT = 2**17
_OUT = "seq string, span long, kind string, frame double, x double, y double, z double, slot long, age long, local long"
_COLS = [c.split()[0] for c in _OUT.split(", ")]


def _settled(linker: Linker) -> None:
    """Live tracks in the order of their positions and ages."""
    if linker.at is not None and len(linker.ids):
        order = np.lexsort((linker.ids, linker.age, *linker.at.T[::-1]))
        linker.ids, linker.at, linker.age = linker.ids[order], linker.at[order], linker.age[order]


class _Range:
    """One range as it is linked: live tracks first, then its frames in turn. Gives what `link_range` does, some rows at a time."""

    def __init__(self, settings: Linking):
        self.axes = ["x", "y", "z"][: settings.dim]
        self.linker, self.begun = Linker(settings.maxdisp, settings.mem, settings.dim), False

    def given(self, at: np.ndarray, age: np.ndarray) -> None:
        self.linker.at, self.linker.age = at[:, : len(self.axes)], age

    def _where(self, kind: str) -> Iterator[pd.DataFrame]:
        n = self.linker
        for k in range(0, max(1, len(n.ids)), SENT):
            to = slice(k, k + SENT)
            yield pd.DataFrame({"kind": kind, "slot": np.arange(len(n.ids))[to], "age": n.age[to], "local": n.ids[to]} | {a: n.at[to, i] for i, a in enumerate(self.axes)})

    def begin(self) -> Iterator[pd.DataFrame]:
        _settled(self.linker)
        if self.linker.at is None:
            self.linker.at = np.zeros((0, len(self.axes)))
        n = len(self.linker.at)
        self.linker.ids, self.linker.next_id, self.begun = np.arange(n), n, True
        yield from self._where("start")

    def frame(self, number: float, warm: bool, at: np.ndarray) -> Iterator[pd.DataFrame]:
        """The next frame, positions (x, y, z) sorted."""
        if not warm and not self.begun:
            yield from self.begin()
        _settled(self.linker)
        ids = self.linker.add(at[:, : len(self.axes)])
        if not warm:
            for k in range(0, len(at), SENT):
                yield pd.DataFrame(at[k : k + SENT], columns=["x", "y", "z"]).assign(kind="seen", frame=float(number), local=ids[k : k + SENT])

    def end(self) -> Iterator[pd.DataFrame]:
        if not self.begun:
            yield from self.begin()
        _settled(self.linker)
        yield from self._where("end")


def _shaped(part: pd.DataFrame) -> pd.DataFrame:
    return part.reindex(columns=["kind", "frame", "x", "y", "z", "slot", "age", "local"]).astype({"slot": "Int64", "age": "Int64", "local": "Int64"})


def link_range(points: pd.DataFrame, given: pd.DataFrame, settings: Linking) -> pd.DataFrame:
    """Of one range (frame, x, y, z, warm) linked from a live set (slot, x, y, z, age; the row of slot -1 says that it is given) or from its warm frames: observations with local numbers, and the live sets at its start and end."""
    made, parts = _Range(settings), []
    if len(given):
        given = given[given["slot"] >= 0].sort_values("slot")
        made.given(given[["x", "y", "z"]].to_numpy(float), given["age"].to_numpy(np.int64))
        parts += made.begin()
        points = points[~points["warm"]]
    for (_, number), frame in points.sort_values(["frame", "x", "y", "z"], kind="stable").groupby([~points["warm"], "frame"], sort=True):
        parts += made.frame(number, bool(frame["warm"].iloc[0]), frame[["x", "y", "z"]].to_numpy(float))
    return _shaped(pd.concat([*parts, *made.end()], ignore_index=True))


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """((seq, span, frame or none for live tracks, warm), positions, ages) of sorted rows, each whole; nothing else is held."""
    now, at, age = None, [], []
    for batch in batches:
        if not len(batch):
            continue
        frame = batch["frame"].to_numpy(float)
        changes = (batch["seq"] != batch["seq"].shift()).to_numpy() | (batch["span"] != batch["span"].shift()).to_numpy()
        changes[1:] |= (frame[1:] != frame[:-1]) & ~(np.isnan(frame[1:]) & np.isnan(frame[:-1]))
        xyz, ages = batch[["x", "y", "z"]].to_numpy(float), batch["age"].to_numpy(float)
        starts = np.union1d([0], np.flatnonzero(changes)).tolist()
        for k, stop in zip(starts, [*starts[1:], len(batch)], strict=True):
            key = (batch["seq"].iloc[k], int(batch["span"].iloc[k]), None if np.isnan(frame[k]) else float(frame[k]), bool(batch["warm"].iloc[k]))
            if key != now:
                if now is not None:
                    yield now, np.concatenate(at), np.concatenate(age)
                now, at, age = key, [], []
            at.append(xyz[k:stop])
            age.append(ages[k:stop])
    if now is not None:
        yield now, np.concatenate(at), np.concatenate(age)


def link_sorted(batches: Iterator[pd.DataFrame], settings: Linking) -> Iterator[pd.DataFrame]:
    """`link_range` for all ranges of sorted rows; a task holds a frame and the live tracks, whatever the length of a range."""
    made, of = None, None
    named = lambda parts: (_shaped(p).assign(seq=of[0], span=of[1])[_COLS] for p in parts)
    for (seq, span, frame, warm), at, age in _runs(batches):
        if (seq, span) != of:
            if made is not None:
                yield from named(made.end())
            made, of = _Range(settings), (seq, span)
        if frame is None:
            # the first row only says that the set is given
            made.given(at[1:], age[1:].astype(np.int64))
            yield from named(made.begin())
        else:
            yield from named(made.frame(frame, warm, at))
    if made is not None:
        yield from named(made.end())


def _ranges(frames: DataFrame, range_points: int) -> DataFrame:
    """(seq, frame, nth, span): frames (seq, frame, n) numbered, and dealt to ranges of about `range_points` points."""
    order = Window.partitionBy("seq").orderBy("frame")  # a row per frame
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    made = frames.withColumns({"nth": F.row_number().over(order) - 1, "cell": F.floor(F.coalesce(upto, F.lit(0)) / range_points)})
    return made.withColumn("span", F.dense_rank().over(Window.partitionBy("seq").orderBy("cell")).cast("long") - 1).drop("cell", "n")


def link_long(centroids: DataFrame, settings: Linking, by: str | None = None, range_points: int = RANGE_POINTS, warm: int = WARM) -> DataFrame:
    """(by, x, y, z, frame, id) of observations on tracks of at least `good` observations, ids from 1 in each sequence, in the order of tracks' first frames and positions there. A sequence with one frame has no tracks."""
    ship(centroids.sparkSession)
    seq = F.col(by).cast("string") if by else F.lit("")
    points = usable(centroids, settings).select(F.coalesce(seq, F.lit("")).alias("seq"), F.col("frame").cast("double").alias("frame"), *[F.col(a).cast("double").alias(a) for a in "xyz"])
    points = materialize(points, "link-points")
    spans = materialize(_ranges(points.groupBy("seq", "frame").agg(F.count(F.lit(1)).alias("n")), range_points), "link-ranges")
    # the frames before a range that it is warmed up with
    first = spans.groupBy("seq", "span").agg(F.min("nth").alias("first")).filter("span > 0")
    warm_up = max(1, settings.mem + warm)
    before = first.withColumn("nth", F.explode(F.sequence(F.greatest(F.col("first") - warm_up, F.lit(0)), F.col("first") - 1)))
    before = before.join(spans.select("seq", "nth", "frame"), ["seq", "nth"]).select("seq", "frame", "span", F.lit(True).alias("warm"))
    dealt = points.join(spans.select("seq", "frame", "span", F.lit(False).alias("warm")).unionByName(before), ["seq", "frame"])
    dealt = materialize(dealt, "link-dealt")

    parts = int(centroids.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def linked(rows: DataFrame, given: DataFrame, tag: str) -> DataFrame:
        live = given.select("seq", "span", F.lit(None).cast("double").alias("frame"), "x", "y", "z", F.lit(False).alias("warm"), "slot", "age")
        both = rows.filter(~F.isnan("frame")).select("seq", "span", "frame", "x", "y", "z", "warm").withColumns({"slot": F.lit(None).cast("long"), "age": F.lit(None).cast("long")}).unionByName(live)
        both = both.repartition(parts, "seq", "span").sortWithinPartitions("seq", "span", F.col("frame").asc_nulls_first(), "slot", *[F.col(a).asc_nulls_last() for a in "xyz"])
        return materialize(both.drop("slot").mapInPandas(lambda batches: link_sorted(batches, settings), _OUT), tag)

    state = ["slot", "age", "x", "y", "z"]
    none = dealt.sparkSession.createDataFrame([], "seq string, span long, slot long, age long, x double, y double, z double")
    now = linked(dealt, none, "link-first")
    while True:
        wrong = materialize(_wrong_starts(now), "link-wrong")
        if wrong.isEmpty():
            break
        ends = now.filter("kind = 'end'").select("seq", (F.col("span") + 1).alias("span"), *state)
        mark = wrong.select("seq", "span", F.lit(-1).cast("long").alias("slot"), F.lit(0).cast("long").alias("age"), *[F.lit(0.0).alias(a) for a in "xyz"])
        given = ends.join(wrong, ["seq", "span"], "left_semi").unionByName(mark)
        again = linked(dealt.join(wrong, ["seq", "span"], "left_semi").filter("not warm"), given, "link-again")
        now = materialize(now.join(wrong, ["seq", "span"], "left_anti").unionByName(again), "link-now")
    return _numbered(now, settings, by, centroids)


def _meeting(now: DataFrame) -> DataFrame:
    """Each live set at a range's start beside the one at the end of the range before, by place."""
    cells = lambda kind, move, tag: now.filter(F.col("kind") == kind).select("seq", (F.col("span") + move).alias("span"), "slot", *[F.col(c).alias(f"{c}_{tag}") for c in ("age", "x", "y", "z", "local")])
    return cells("start", 0, "a").join(cells("end", 1, "b"), ["seq", "span", "slot"], "full")


def _wrong_starts(now: DataFrame) -> DataFrame:
    there = now.select("seq", "span").distinct()
    fits = F.lit(True)
    for c in ("age", "x", "y", "z"):
        fits = fits & F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    both = F.col("local_a").isNotNull() & F.col("local_b").isNotNull()
    return _meeting(now).filter(~(fits & both)).select("seq", "span").distinct().join(there, ["seq", "span"], "left_semi")


def _numbered(now: DataFrame, settings: Linking, by: str | None, centroids: DataFrame) -> DataFrame:
    """Local numbers of ranges as numbers of tracks."""
    there = now.select("seq", "span").distinct()
    up = _meeting(now).join(there, ["seq", "span"], "left_semi").select("seq", "span", F.col("local_a").alias("local"), (F.col("span") - 1).alias("to_span"), F.col("local_b").alias("to_local"))
    up = materialize(up.filter("local is not null"), "link-up")
    spans = now.agg(F.max("span")).first()[0] or 0
    for _ in range(int(spans).bit_length()):
        over = up.select("seq", F.col("span").alias("to_span"), F.col("local").alias("to_local"), F.col("to_span").alias("s2"), F.col("to_local").alias("l2"))
        up = up.join(over, ["seq", "to_span", "to_local"], "left").select("seq", "span", "local", F.coalesce("s2", "to_span").alias("to_span"), F.coalesce("l2", "to_local").alias("to_local"))
        up = materialize(up, "link-up")
    seen = now.filter("kind = 'seen'").join(up, ["seq", "span", "local"], "left")
    seen = seen.select("seq", F.coalesce("to_span", "span").alias("span"), F.coalesce("to_local", "local").alias("local"), "x", "y", "z", "frame")
    seen = materialize(seen, "link-seen")
    many = seen.groupBy("seq").agg(F.count_distinct("frame").alias("frames")).filter("frames > 1")
    tracks = seen.groupBy("seq", "span", "local").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= settings.good).join(many, "seq", "left_semi")
    ids = ranked(tracks.select("seq", F.struct("span", "local").alias("track")), "seq", "track").select("seq", "track.span", "track.local", (F.col("rank") + 1).cast("long").alias("id"))
    out = seen.join(ids, ["seq", "span", "local"])
    kinds = {f.name: f.dataType for f in centroids.schema.fields}
    cols = [F.col(c).cast(kinds[c]).alias(c) for c in ("x", "y", "z", "frame")]
    # a null key came through as an empty one
    key = [F.when(F.col("seq") != "", F.col("seq")).cast(kinds[by]).alias(by)] if by else []
    return out.select(*key, *cols, "id")
