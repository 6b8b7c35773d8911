"""Packing of whole documents into token windows, best fit decreasing.

A document is its token ids and the end id. Overlong documents are first cut into full windows, which need no packing; what is
left of each goes, by falling length, to the open window with the least room that holds it. The open windows are found by a
segment tree over remaining capacity: a node says whether any window below it is open. Rests are dealt by their own number into
shards of about `shard_rows`, so copies, hot sources and long documents are spread. Windows that stay more than `slack` short of
full are emptied at the end of a shard: their pieces are laid end to end and cut into full windows, and the last, short stretch at
powers of two, which need no padding.

The tokenizer is called once for each distinct run of non-blanks that a Python worker meets: no token of a vocabulary that drops white
space crosses a blank. Texts are encoded in stretches of about a megabyte.

Defined results: null or empty text is the end id alone; rows with null id and repeated rows are packed each; ties go by the
order of the staged pieces; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BLANKS, by_bytes, kept, stage

WINDOW = 2048
END_ID = 1
MODEL = "word_bpe_49k.json"
SHARD_ROWS = 4096
#: Tokens that a window may lack without being emptied.
SLACK = 16
#: Bytes of a text that are encoded at once, and of ids in a batch that goes back to Spark.
STRETCH = 1 << 20
#: Runs of letters, and a mark after them, that are encoded as one text: each word's last token says so.
TOGETHER, MARKS = 256, ".,;:!?"
#: Bytes of runs and of their ids that a Python worker remembers at most (it takes about ten times as much).
REMEMBERED = 3 << 23


class Remembered:
    """Token ids by run of non-blanks; each run is encoded once, all are forgotten when they are too many."""

    def __init__(self, model_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(model_path)
        self.ends = np.array([(self.model.id_to_token(i) or "").endswith("</w>") for i in range(self.model.get_vocab_size())])
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.held = 0
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.ids, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, runs: Iterable[bytes]) -> None:
        if self.held > REMEMBERED:
            self.forget()
        fresh = [r for r in dict.fromkeys(runs) if r not in self.place]
        text = [r.decode() for r in fresh]
        words = [1 if t.isalpha() else 2 if t[-1] in MARKS and t[:-1].isalpha() else 0 for t in text]
        alone = [k for k, n in enumerate(words) if not n]
        plain = [k for k, n in enumerate(words) if n]
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        for group, e in zip(groups, self.model.encode_batch_fast([" ".join([text[k] for k in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum([words[k] for k in group])
            if len(ends) == last[-1]:
                self.add([fresh[k] for k in group], ids, np.diff(ends[last - 1], prepend=0))
            else:  # a letter that becomes several characters
                alone += group
        found = [e.ids for e in self.model.encode_batch_fast([text[k] for k in alone], add_special_tokens=False)]
        self.add([fresh[k] for k in alone], np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64))

    def add(self, runs: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        self.held += sum(map(len, runs)) + ids.nbytes
        self.place |= zip(runs, range(len(self.place), len(self.place) + len(runs)), strict=True)
        self.new.append((ids, size))

    def settle(self) -> None:
        if self.new:
            ids, size = (np.concatenate(x) for x in zip(*self.new, strict=True))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])
            self.new = []

    def __call__(self, runs: list[bytes]) -> np.ndarray:
        """The ids of runs that are all known."""
        self.settle()
        at = np.fromiter(map(self.place.__getitem__, runs), np.int64, len(runs))
        size = self.size[at]
        ends = np.cumsum(size)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - (ends - size), size)]


def stretches(text: bytes, longest: int) -> Iterator[bytes]:
    """The text in parts of about `longest` bytes, cut at blanks; longer only without a blank."""
    start = 0
    while len(text) - start > longest:
        cut = min((i for i in (text.find(b, start + longest) for b in (c.encode() for c in BLANKS)) if i >= 0), default=-1)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree whose nodes say whether a window below them is open."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.base)
        self.at: list[list[int]] = [[] for _ in range(self.base)]

    def add(self, window: int, room: int) -> None:
        self.at[room].append(window)
        node = self.base + room
        while node and not self.some[node]:
            self.some[node] = True
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The tightest window with room for `size`, and its room; it is open no more."""
        node = self.base + size
        while not self.some[node]:
            while node & 1:  # a right child: nothing further right below its parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.base:
            node = 2 * node + (not self.some[2 * node])
        room = node - self.base
        window = self.at[room].pop()
        while node and not (self.at[room] if node >= self.base else self.some[2 * node] or self.some[2 * node + 1]):
            self.some[node] = False
            node >>= 1
        return window, room


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[int]:
    """The window of each piece (sizes up to capacity)."""
    opened, windows, out = OpenWindows(capacity), 0, np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        window, room = opened.take(int(sizes[i])) or (windows, capacity)
        windows += window == windows
        if room > sizes[i]:
            opened.add(window, room - int(sizes[i]))
        out[i] = window
    return out


def laid_out(sizes: np.ndarray, capacity: int, slack: int) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, length, window, offset): the packing of the pieces, without windows that lack more than slack."""
    window = best_fit_decreasing(sizes, capacity)
    fill = np.bincount(window, sizes).astype(np.int64)
    short = (capacity - fill > slack) & (fill & (fill - 1) != 0)
    out, used = [], np.zeros(len(fill), np.int64)
    for i in np.flatnonzero(~short[window]):
        out.append((int(i), 0, int(sizes[i]), int(window[i]), int(used[window[i]])))
        used[window[i]] += sizes[i]
    loose = np.flatnonzero(short[window])
    left, number, room = int(sizes[loose].sum()), len(fill), 0
    for i in loose:
        start = 0
        while start < sizes[i]:
            if not room:
                length = room = capacity if left >= capacity else 1 << (left.bit_length() - 1)
                number, left = number + 1, left - length
            part = min(room, int(sizes[i]) - start)
            out.append((int(i), start, part, number, length - room))
            start, room = start + part, room - part
    return out


def window_pieces(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, capacity: int = WINDOW, shard_rows: int = SHARD_ROWS, slack: int = SLACK) -> DataFrame:
    """One row per piece: id, start (the document's ids before it), length, ids (little-endian unsigned 32 bits), doc_tokens, sequence_id, offset."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = kept(model_path, lambda: Remembered(model_path))
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["id", "start", "length", "ids", "doc_tokens"])
        for batch in by_bytes(batches, "text", STRETCH):
            types = [batch.schema.field("id").type, pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            rows, held = [], 0
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            runs = [t.split() for t in texts] if len(texts) > 1 else None  # several are a stretch together, one may be of any length
            if runs:
                ids_of.learn(r for doc in runs for r in doc)
            for k, (key, text) in enumerate(zip(batch.column("id").to_pylist(), texts, strict=True)):
                found = []
                for part in [runs[k]] if runs else map(bytes.split, stretches(text, STRETCH)):
                    if not runs:
                        ids_of.learn(part)
                    found.append(ids_of(part))
                ids = np.concatenate([*found, np.array([end_id], np.uint32)]).astype("<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    rows.append((key, start, len(part), part.tobytes(), len(ids)))
                    held += part.nbytes
                    if held >= STRETCH:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)

    kind = docs.schema[id_col].dataType.simpleString()
    piece = f"id {kind}, start long, length long, ids binary, doc_tokens long"
    pieces = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(encode, piece)
    pieces = stage(pieces.withColumn("number", F.monotonically_increasing_id()), "pieces", compression="zstd")
    full, rest = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    shards = max(1, -(-rest.count() // shard_rows))

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("number")
        table = laid_out(rows["length"].to_numpy(), capacity, slack)
        piece, start, length, window, offset = (np.array(c, np.int64) for c in zip(*table, strict=True))
        ids = rows["ids"].to_pylist()
        cut = [ids[p][4 * a : 4 * (a + n)] for p, a, n, _, _ in table]
        own = rows.take(pa.array(piece))
        shard = own["shard"].to_numpy().astype(np.int64)
        return pa.table([own["id"], own["start"].to_numpy() + start, length, pa.array(cut, pa.binary()), own["doc_tokens"], (shard << 32 | window) << 1 | 1, offset], out_names)

    out_names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("number"), F.lit(shards)).cast("int"))
    packed = dealt.groupBy("shard").applyInArrow(pack, f"{piece}, sequence_id long, offset long")
    whole = full.withColumn("sequence_id", F.shiftleft("number", 1)).withColumn("offset", F.lit(0).cast("long"))
    return whole.select(*out_names).unionByName(packed).withColumnRenamed("id", id_col)


def packed_windows(docs: DataFrame, model_path: str) -> DataFrame:
    """The pieces with the checksum of their ids."""
    pieces = window_pieces(docs, model_path)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
