"""Removing repeated byte strings with sorted suffixes.

A byte goes if it lies in a string of `length` bytes that also starts earlier: in a document that ranks before, or
before it in the same one. Every such string is a window of a document, and equal windows must meet in one task:

1. Equal texts (of equal SHA-256) are one text, held by the document that ranks first; the others lose every byte if they have `length`.
   The distinct texts are written once, bucketed by a row number, so later steps meet them without moving them.
2. Each window has an anchor: the leftmost of its least-hashed strings of `gram` bytes. Equal windows have equal
   anchors at equal places, and neighbouring windows mostly share theirs, so an anchor stands for a run of windows.
   Anchors whose string occurs once in all texts can't have equal windows and go; counts are combined before shuffles.
3. The rest are dealt by anchor string with the bytes around them. The suffixes that start at anchors, and the
   prefixes that end there (read backwards), are sorted deep-shallow: multikey quicksort to a shallow depth, with
   eight bytes as one key and the partitions of a level made for all groups at once, then a blind trie for each
   group with a longer common prefix. From the longest common prefixes of neighbours follow, for each place of an
   anchor in its window, the classes of equal windows, and all but the first of a class are removed.

An anchor string with over `HOT_ROWS` anchors isn't sorted in one task: its windows are written out and grouped by a
128-bit hash, combined before the shuffle. That is exact as well and takes any size.

Defined cases: null texts are empty; texts shorter than `length` lose nothing; documents rank by integer id, null ids
last; rows that agree in id and text are one document, with the same result for each; documents that share an id and
differ in text rank by a row number. Other columns are never looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, free_shuffles, materialize, new_path, partitions, ship

LENGTH, GRAM = 100, 24
SHALLOW = 32
#: Bytes that are hashed at a time, anchors that are sorted at a time (whole groups, so at times more), and the largest group that is sorted.
CHUNK, SORT_ROWS, HOT_ROWS = 1 << 20, 50_000, 200_000
PLACE = np.uint64((1 << 28) - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Of every string of `gram` bytes, put together from those of the powers of two in `gram`."""
    width, h = 1, data.astype(np.uint64) + np.uint64(1)
    out, have = None, 0
    while True:
        if gram & width:
            if out is None:
                out, have = h, width
            else:
                n = min(len(out), len(h) - have)
                out, have = out[:n] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + h[have : have + n], have + width
        if have == gram:
            return _mixed(out)
        h = h[:-width] * np.uint64(0xD1342543DE82EF95 + 2 * width) + h[width:] if len(h) > width else h[:0]
        width *= 2


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each `w` neighbours."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def anchors(data: np.ndarray, first: np.ndarray, stop: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, text, place of the anchor in its text, least and greatest distance from a window's start to it), for texts data[first:stop]."""
    out: list[tuple[np.ndarray, ...]] = []
    for lo, hi in _chunks(first, stop, length):
        a, b = (first[lo], stop[hi - 1]) if hi - lo > 1 else (first[lo], stop[lo])
        for at in range(int(a), max(int(a) + 1, int(b) - length + 1), CHUNK if hi - lo == 1 else 1 << 62):
            to = min(int(b), at + CHUNK + length - 1) if hi - lo == 1 else int(b)
            if to - at < length:
                continue
            h = _gram_hashes(data[at:to], gram)
            best = _least((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & PLACE
            best = best.astype(np.int64)
            text = np.repeat(np.arange(lo, hi), stop[lo:hi] - first[lo:hi])[: len(best)] if hi - lo > 1 else np.full(len(best), lo)
            start = np.arange(len(best))
            ok = start + at + length <= stop[text]
            best, text, start = best[ok], text[ok], start[ok]
            if not len(best):
                continue
            new = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (text[1:] != text[:-1])]))
            last = np.concatenate([new[1:], [len(best)]]) - 1
            p, t = best[new], text[new]
            out.append((h[p].view(np.int64), t, p + at - first[t], p - start[last], p - start[new]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _chunks(first: np.ndarray, stop: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of together at most CHUNK bytes, or one text."""
    lo, n = 0, len(first)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(stop, first[lo] + CHUNK, "right")))
        yield lo, hi
        lo = hi


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a binary column, and where its values begin and end there."""
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at[:-1], at[1:]


# --- deep-shallow sorting -------------------------------------------------------------------------------------------


class BlindTrie:
    """Strings in a trie whose edges keep only their first byte: a string is placed by a blind descent, one comparison, and a second descent."""

    __slots__ = ("strings", "root")

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def insert(self, i: int) -> None:
        s, node = self.strings[i], self.root
        if node is None:
            self.root = [i]
            return
        while type(node) is tuple:  # (depth, children by byte, -1 for an end)
            depth, below = node
            found = below.get(s[depth] if depth < len(s) else -1)
            node = found if found is not None else next(iter(below.values()))
        other = self.strings[node[0]]
        if other == s:
            node.append(i)
            return
        lcp = common(s, other)
        mine, theirs = (s[lcp] if lcp < len(s) else -1), (other[lcp] if lcp < len(other) else -1)
        node, above, key = self.root, None, None
        while type(node) is tuple and node[0] < lcp:
            above, key = node, (s[node[0]] if node[0] < len(s) else -1)
            node = above[1][key]
        if type(node) is tuple and node[0] == lcp:
            node[1][mine] = [i]
            return
        split = (lcp, {theirs: node, mine: [i]})
        if above is None:
            self.root = split
        else:
            above[1][key] = split

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if type(node) is tuple:
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def common(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def deep_shallow(group: np.ndarray, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings within groups, and the longest common prefix of each with the one before it in that order (-1 across groups).

    rows: a matrix of bytes, zero behind a string's end; size: the strings' lengths.
    """
    n = len(group)
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    rank = group[order]
    edge = np.concatenate([[True], rank[1:] != rank[:-1]]) if n else np.zeros(0, bool)
    for depth in range(min(SHALLOW // 8, words.shape[1])):
        cls = np.cumsum(edge)
        open_ = np.flatnonzero(~(edge & np.concatenate([edge[1:], [True]]))) if n else np.zeros(0, np.int64)
        if not len(open_):
            break
        key = words[order[open_], depth]
        step = np.lexsort((key, cls[open_]))
        order[open_] = order[open_][step]
        key = key[step]
        edge[open_[1:]] |= (key[1:] != key[:-1]) & (np.diff(open_) == 1)
    begin = np.flatnonzero(edge)
    stop = np.concatenate([begin[1:], [n]])
    for a, b in zip(begin[stop - begin > 1].tolist(), stop[stop - begin > 1].tolist(), strict=True):
        at = order[a:b]
        strings = [r[:k] for r, k in zip(map(bytes, rows[at]), size[at].tolist(), strict=True)]
        trie = BlindTrie(strings)
        for i in range(b - a):
            trie.insert(i)
        order[a:b] = at[trie.order()]
    lcp = np.full(n, -1, np.int64)
    for lo in range(1, n, 1 << 16):
        x, y = order[lo : lo + (1 << 16)], order[lo - 1 : min(n, lo + (1 << 16)) - 1]
        differ = rows[x] != rows[y]
        at = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        same = np.minimum(at, np.minimum(size[x], size[y]))
        lcp[lo : lo + len(x)] = np.where(group[x] == group[y], same, -1)
    return order, lcp


def _padded(parts: list[bytes], width: int, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    width = -(-max(width, 1) // 8) * 8
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.frombuffer(b"".join(parts), np.uint8)
    begin = np.cumsum(size) - size
    inside = np.arange(width) < size[:, None]
    where = (begin + size - 1)[:, None] - np.arange(width) if back else begin[:, None] + np.arange(width)
    rows = np.zeros((len(parts), width), np.uint8)
    rows[inside] = flat[where[inside]]
    return rows, size


def repeated_windows(group: np.ndarray, rank: np.ndarray, near: np.ndarray, far: np.ndarray, around: list[bytes], length: int = LENGTH) -> np.ndarray:
    """removed[i, d]: whether the window that starts d bytes before anchor i equals one that ranks before it.

    group: the anchor's string; rank: lower is earlier, all different; near, far: least and greatest d; around: the bytes from far before the anchor to length - near behind it.
    """
    n, most = len(group), int(far.max(initial=0))
    right, right_size = _padded([a[f:] for a, f in zip(around, far.tolist(), strict=True)], length)
    left, left_size = _padded([a[:f] for a, f in zip(around, far.tolist(), strict=True)], most, back=True)
    by_right, right_lcp = deep_shallow(group, right, right_size)
    by_left, left_lcp = deep_shallow(group, left, left_size)
    removed = np.zeros((n, most + 1), bool)
    early = np.argsort(rank, kind="stable")
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(near.min(initial=0)), most + 1):
        at = early[(near[early] <= d) & (far[early] >= d)]
        if len(at) < 2:
            continue
        r_class[by_right] = np.cumsum(right_lcp < length - d)
        l_class[by_left] = np.cumsum(left_lcp < d)
        key = r_class[at] * (n + 1) + l_class[at]
        _, first = np.unique(key, return_index=True)
        again = np.ones(len(at), bool)
        again[first] = False
        removed[at[again], d] = True
    return removed


# --- the steps ------------------------------------------------------------------------------------------------------


def _anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, row, at): anchors; at = place << 16 | greatest distance << 8 | least distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo in range(0, batch.num_rows, 1000):
                h, text, place, near, far = anchors(*_binary(batch.column(1).slice(lo, 1000)), length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids[lo : lo + 1000][text]), pa.array(place << 16 | far << 8 | near)], ["h", "row", "at"])

    return texts.filter(F.octet_length("text") >= length).select("row", "text").mapInArrow(run, "h long, row long, at long")


def _around(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """`wanted` (h, row, at, hot) with `rank` of its text and `around`, its bytes."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("h", "at", "hot")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, items = batch.column(2)[i].as_buffer(), batch.column(3)[i].values
                at = items.field("at").to_numpy()
                place, far, near = at >> 16, at >> 8 & 255, at & 255
                data = memoryview(text)
                got = [bytes(data[p - f : p - m + length]) for p, f, m in zip(place.tolist(), far.tolist(), near.tolist(), strict=True)]
                n = len(at)
                same = lambda k: pa.array(np.full(n, batch.column(k)[i].as_py(), np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([items.field("h"), same(0), same(1), pa.array(at), pa.array(got, pa.binary()), items.field("hot")], ["h", "row", "rank", "at", "around", "hot"])

    rows = texts.join(lists, "row").select("row", "rank", "text", "x")
    return rows.mapInArrow(run, "h long, row long, rank long, at long, around binary, hot boolean")


def _sorted_spans(around: DataFrame, length: int, sort_rows: int) -> DataFrame:
    """(row, first, stop): bytes to remove, from anchors that aren't hot."""

    def spans(t: pa.Table) -> pa.RecordBatch:
        col = {c: t.column(c).to_numpy() for c in ("h", "row", "rank", "at")}
        place, far, near = col["at"] >> 16, col["at"] >> 8 & 255, col["at"] & 255
        order = np.lexsort((place, col["row"], col["rank"]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        removed = repeated_windows(np.unique(col["h"], return_inverse=True)[1], rank, near, far, t.column("around").to_pylist(), length)
        # neighbouring distances are neighbouring windows, and their bytes one span
        edge = np.diff(np.pad(removed, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (i, lo), (_, hi) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        return pa.RecordBatch.from_arrays([pa.array(col["row"][i]), pa.array(place[i] - hi + 1), pa.array(place[i] - lo + length)], ["row", "first", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < sort_rows:
                continue
            t = pa.Table.from_batches(held)
            h = t.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last group may go on
            if cut:
                yield spans(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                n -= cut
        if n:
            yield spans(pa.Table.from_batches(held))

    rows = around.filter(~F.col("hot")).select("h", "row", "rank", "at", "around").repartition(partitions(around.sparkSession), "h").sortWithinPartitions("h")
    return rows.mapInArrow(run, "row long, first long, stop long")


def _hot_spans(around: DataFrame, length: int) -> DataFrame:
    """The same from hot anchors: every window by itself."""
    far, near = F.expr("at >> 8 & 255"), F.expr("at & 255")
    each = around.filter("hot").withColumn("d", F.explode(F.sequence(near, far)))
    window = F.substring(F.col("around"), (far - F.col("d") + 1).cast("int"), F.lit(length))
    rows = each.select(F.unhex(F.md5(window)).alias("w"), "rank", "row", F.expr("(at >> 16) - d").alias("first"))
    first = materialize(rows.groupBy("w").agg(F.min(F.struct("rank", "row", "first")).alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("w", "b"), "suffix-hot")
    again = rows.join(first, "w").filter("not (row = b.row and first = b.first)")
    return again.select("row", "first", (F.col("first") + length).alias("stop"))


def _cut(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(k, first_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each distinct text."""
    lists = spans.groupBy("row").agg(F.collect_list(F.struct("first", "stop")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, x in zip(batch.column(2), batch.column(3), strict=True):
                text = memoryview(text.as_buffer())
                runs = merged(x.values.field("first").to_numpy(), x.values.field("stop").to_numpy()) if x.is_valid else []
                digest, at = hashlib.sha256(), 0
                for a, b in runs:
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                out.append((len(text), sum(b - a for a, b in runs), len(runs), digest.hexdigest(), [{"first": a, "stop": b} for a, b in runs]))
            n, gone, count, sha, runs = zip(*out, strict=True)
            pair = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sha), pa.array(runs, pair)], ["k", "first_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    rows = texts.join(lists, "row", "left").select("k", "first_id", "text", "x")
    return rows.mapInArrow(_nonempty(run), "k binary, first_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:long,stop:long>>")


def _nonempty(run):
    return lambda batches: run(b for b in batches if b.num_rows)


def merged(first: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs that spans cover."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.concatenate([[True], first[1:] > reach[:-1]])) if len(first) else np.zeros(0, np.int64)
    last = np.concatenate([new[1:], [len(first)]])[: len(new)] - 1
    return list(zip(first[new].tolist(), reach[last].tolist(), strict=True))


def distinct_texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """(row, k, first_id, rank, text): each text once, with the least id; a table bucketed by row, and its name."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("k"))
    groups = rows.groupBy("k").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = materialize(groups, "suffix-copies")
    own = rows.join(broadcast_if_small(groups), "k", "left")
    single = own.filter("n is null").select("k", F.col("id").alias("first_id"), "text")
    # one row of each group: those that carry the least id agree, so any will do
    some = own.filter("n is not null and id <=> first_id").dropDuplicates(["k"]).select("k", "first_id", "text")
    parts = partitions(spark)
    numbered = single.unionByName(some).withColumn("row", F.monotonically_increasing_id())
    placed = numbered.withColumn("rank", F.coalesce("first_id", F.lit(2**63 - 1))).repartition(parts, "row")
    name, path = f"voxtide_texts_{uuid.uuid4().hex}", new_path(spark, "suffix-texts")
    placed.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(parts, "row").saveAsTable(name)
    free_shuffles(spark)
    return spark.table(name), name


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot_rows: int = HOT_ROWS, sort_rows: int = SORT_ROWS) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans (maximal runs removed), kept_sha256 of the bytes that stay, and the `spans` themselves."""
    if not 8 <= gram < length <= 255:
        raise ValueError("8 <= gram < length <= 255")
    spark = docs.sparkSession
    ship(spark)
    texts, name = distinct_texts(docs, id_col, text_col)
    try:
        counted = _anchor_rows(texts, length, gram).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        counted = materialize(counted.select("h", (F.col("n") > hot_rows).alias("hot")), "suffix-anchors")
        free_shuffles(spark)
        wanted = materialize(_anchor_rows(texts, length, gram).join(counted, "h"), "suffix-wanted")
        free_shuffles(spark)
        around = _around(texts, wanted, length)
        if counted.filter("hot").isEmpty():
            spans = _sorted_spans(around, length, sort_rows)
        else:
            around = materialize(around, "suffix-around")
            spans = _sorted_spans(around, length, sort_rows).unionByName(_hot_spans(around, length))
        spans = materialize(spans, "suffix-spans")
        free_shuffles(spark)
        found = materialize(_cut(texts, spans), "suffix-found")
    finally:
        spark.sql(f"DROP TABLE {name}")
    free_shuffles(spark)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("k"))
    copy = ~F.col("id").cast("long").eqNullSafe(F.col("first_id")) & (F.col("n_bytes") >= length)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("stop")))
    pick = lambda gone, c: F.when(copy, gone).otherwise(F.col(c)).alias(c)
    # a shorter copy loses nothing, and neither does the text it is a copy of
    return rows.join(found, "k").select(
        F.col("id").alias(id_col), "n_bytes", pick(F.col("n_bytes"), "n_removed"), pick(F.lit(1).cast("long"), "n_spans"),
        pick(F.lit(hashlib.sha256().hexdigest()), "kept_sha256"), pick(whole, "spans"),
    )
