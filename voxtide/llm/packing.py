"""Packing token sequences by the sum-of-squares rule.

Every task packs the documents it reads, in order, so nothing is shuffled. Whole windows are cut off a document first;
the rest goes, online, into the open window whose new fill keeps the sum over all fills of (open windows with that
fill) squared least. The state is an array of counts by fill level, and by level the stack of windows. When a task's
input ends, the open windows are emptied into each other: the fullest are filled with pieces of the emptiest, of which
only the piece that overshoots is cut. What remains of the very last window is dealt into sequences whose lengths are
the powers of two of its binary notation, which need no padding.

A sequence's number is the task's partition number times 2^33 plus a counter, so no two tasks share one.

Defined cases: null and empty texts are the end token alone; rows that repeat an id are documents of their own; an
empty table gives no rows; other columns are never looked at. Documents may be of any length.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

CAPACITY = 4096
END_ID = 2
#: What a worker remembers of words (and their stems) before it starts anew, counted as 160 bytes each, 4 a character and 4 an id.
CACHE_BYTES = 128 << 20
TAIL, APART = ".,;:!?", frozenset("'<>|")
PIECES = "id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def letters(s: str) -> bool:
    """Whether a string is letters alone, in lower case as well."""
    return s.isalpha() and (s.isascii() or s.lower().isalpha())


class Words:
    """Ids of texts through a tokenizer that drops white space, so that a text's ids are those of its words in turn.

    A word is looked up first, then its stem without ASCII punctuation at its end (which the tokenizer always parts
    from letters) in lower case. Unknown stems of letters alone are encoded together, in one text, and their ids told
    apart by the tokens that end a word. A stem whose lower case ends in or holds anything but letters (that of the
    Turkish capital I with a dot ends in a combining mark, which joins punctuation) is encoded with its word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.clear()

    def clear(self) -> None:
        """`at` numbers the strings that are known, whole words and parts alike; ids lie one after the other in `flat`."""
        self.at: dict[str, int] = {}
        self.flat, self.first, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.used = self.bytes = 0
        self.store([""], np.zeros(1, np.int64), np.zeros(0, np.uint32))

    def store(self, keys: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        n, k = len(self.at), len(keys)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + k > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        self.flat[self.used : self.used + len(ids)] = ids
        self.count[n : n + k] = sizes
        self.first[n : n + k] = self.used + np.cumsum(sizes) - sizes
        self.at.update(zip(keys, range(n, n + k), strict=True))
        self.used += len(ids)
        self.bytes += 160 * k + 4 * (sum(map(len, keys)) + len(ids))

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of strings in turn, and where those of each end."""
        sizes = self.count[at].astype(np.int64)
        stop = np.cumsum(sizes)
        total = int(stop[-1]) if len(stop) else 0
        return self.flat[np.repeat(self.first[at] - (stop - sizes), sizes) + np.arange(total)], stop

    def encode(self, parts: list[str]) -> None:
        plain = [s for s in parts if letters(s)]
        for lo in range(0, len(plain), 2000):
            some = plain[lo : lo + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.int64)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(some):
                self.store(some, np.diff(stop, prepend=0), ids)
        rest = [s for s in parts if s not in self.at]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        self.store(rest, np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(chain.from_iterable(found), np.uint32))

    def learn(self, words: list[str]) -> None:
        stems, tails = [], []
        for w in words:
            stem = w.rstrip(TAIL)
            if letters(stem):
                # only A-Z by hand: for other letters lower case is the tokenizer's business
                stems.append(stem.lower() if stem.isascii() else stem)
                tails.append(w[len(stem) :])
            elif stem and stem[-1].isalnum() and stem.lower()[-1].isalnum() and APART.isdisjoint(stem):
                # an apostrophe may begin a contraction, a sign of a special token must stay with it, and marks and signs join the tail
                stems.append(stem)
                tails.append(w[len(stem) :])
            else:
                stems.append(w)
                tails.append("")
        known = self.at
        self.encode(sorted({x for x in chain(stems, tails) if x not in known}))
        joined = [i for i, w in enumerate(words) if w not in known]
        pairs = np.fromiter((known[x] for i in joined for x in (stems[i], tails[i])), np.int64, 2 * len(joined))
        ids, stop = self.gather(pairs)
        self.store([words[i] for i in joined], np.diff(stop[1::2], prepend=0), ids)

    def ids(self, texts: pa.StringArray, end: int | None = END_ID) -> Iterator[np.ndarray]:
        """Texts are split at the six ASCII blanks only; other white space stays inside a word, for the tokenizer to drop. Each different word of `texts` is looked up once."""
        if self.bytes > CACHE_BYTES:
            self.clear()
        words = pc.ascii_split_whitespace(texts)
        bounds = words.offsets.to_numpy()
        coded = words.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.at.get, different, repeat(-1)), np.int64, len(different))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [different[i] for i in missing.tolist()]
            self.learn(new)
            at[missing] = np.fromiter(map(self.at.__getitem__, new), np.int64, len(new))
        flat, stop = self.gather(at[coded.indices.to_numpy()])
        cuts = np.concatenate([[0], stop])[bounds - bounds[0]].tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            out = np.empty(b - a + (end is not None), np.uint32)
            out[: b - a] = flat[a:b]
            if end is not None:
                out[-1] = end
            yield out


_words: dict[str, Words] = {}


def words_of(path: str) -> Words:
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


class Packer:
    """Sum-of-squares packing into windows of `capacity`. `out` gets (key, start, ids, doc_tokens, sequence, offset, sequence length)."""

    def __init__(self, capacity: int = CAPACITY, first: int = 0):
        self.capacity, self.next, self.out = capacity, first, []
        self.levels = np.zeros(capacity + 1, np.int64)  # open windows by fill
        self.open: list[list[list]] = [[] for _ in range(capacity)]

    def close(self, window: list) -> None:
        length = sum(len(p[2]) for p in window)
        at = 0
        for key, start, ids, total in window:
            self.out.append((key, start, ids, total, self.next, at, length))
            at += len(ids)
        self.next += 1

    def level_for(self, size: int) -> int:
        """The fill at which a piece of `size` leaves the least sum of squares; 0 for a new window, the fullest on a tie."""
        n, last = self.levels, self.capacity - size
        change = 1 - 2 * n[: last + 1]
        change[0] = 0
        change[:last] += 2 * n[size : size + last] + 1  # at `last` the window is full and no longer counts
        change[1:][n[1 : last + 1] == 0] = np.iinfo(np.int64).max
        return last - int(np.argmin(change[::-1]))

    def add(self, key, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.capacity:
            self.close([(key, start, ids[start : start + self.capacity], total)])
            start += self.capacity
        if size := total - start:
            level = self.level_for(size)
            window = self.open[level].pop() if level else []
            self.levels[level] -= level > 0
            window.append((key, start, ids[start:], total))
            if level + size == self.capacity:
                self.close(window)
            else:
                self.levels[level + size] += 1
                self.open[level + size].append(window)

    def finish(self) -> None:
        """Fill the fullest windows from the emptiest; deal the last one's rest into powers of two."""
        left = [(level, w) for level in range(self.capacity - 1, 0, -1) for w in self.open[level]]
        i, j = 0, len(left) - 1
        while i < j:
            level, window = left[i]
            have, donor = left[j]
            while level < self.capacity and donor:
                key, start, ids, total = donor.pop()
                take = min(len(ids), self.capacity - level)
                # of a cut piece the end moves and the beginning stays, so both are still in one run each
                window.append((key, start + len(ids) - take, ids[len(ids) - take :], total))
                if take < len(ids):
                    donor.append((key, start, ids[: len(ids) - take], total))
                level, have = level + take, have - take
            left[j] = (have, donor)
            if level == self.capacity:
                self.close(window)
                i += 1
            else:
                left[i] = (level, window)
            if not donor:
                j -= 1
        if i == j and left[i][1]:
            pieces, room = list(left[i][1]), left[i][0]
            while room:
                size, window, have = 1 << (room.bit_length() - 1), [], 0
                while have < size:
                    key, start, ids, total = pieces.pop(0)
                    take = min(len(ids), size - have)
                    window.append((key, start, ids[:take], total))
                    if take < len(ids):
                        pieces.insert(0, (key, start + take, ids[take:], total))
                    have += take
                self.close(window)
                room -= size
        self.open, self.levels = [[] for _ in range(self.capacity)], np.zeros(self.capacity + 1, np.int64)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False, release: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, and on request its `ids`.

    `tokenizer` is the path of a tokenizer file whose pieces never cross white space, the same on every executor. A
    worker keeps the ids of words it has seen from one task to the next; with `release` it forgets them after each, for
    steps that share executors with others.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, TaskContext.get().partitionId() << 33)
        words, id_type = words_of(tokenizer), None

        def rows() -> Iterator[pa.RecordBatch]:
            out, packer.out = packer.out, []
            if out:
                keys, start, ids, total, seq, at, length = zip(*out, strict=True)
                raw = [x.astype("<u4", copy=False).tobytes() for x in ids]
                cols = {
                    id_col: pa.array(keys, id_type), "start": pa.array(start, pa.int64()), "length": pa.array(map(len, ids), pa.int64()),
                    "ids_crc32": pa.array(map(zlib.crc32, raw), pa.int64()), "doc_tokens": pa.array(total, pa.int64()),
                    "sequence_id": pa.array(seq, pa.int64()), "offset": pa.array(at, pa.int64()), "sequence_length": pa.array(length, pa.int64()),
                }
                if with_ids:
                    cols["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

        for batch in batches:
            id_type = batch.schema.field(0).type
            keys = batch.column(0).to_pylist()
            for part in range(0, batch.num_rows, 512):
                texts = batch.column(1).slice(part, 512)
                for key, ids in zip(keys[part : part + 512], words.ids(texts), strict=True):
                    packer.add(key, ids)
                yield from rows()
        packer.finish()
        yield from rows()
        if release:
            words.clear()

    schema = PIECES.format(kind.simpleString()).replace("id ", f"`{id_col}` ", 1) + (", ids array<int>" if with_ids else "")
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("t")).mapInArrow(run, schema)


def padding(sequence_lengths: pd.Series, capacity: int = CAPACITY) -> int:
    """Tokens of padding of sequences with these lengths: none at a power of two, else up to `capacity`."""
    n = sequence_lengths.to_numpy()
    return int((capacity - n)[(n & (n - 1)) != 0].sum())
