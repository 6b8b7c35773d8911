"""Alignment of two tokenizers: which token of one overlaps which of the other, in every whole text.

The tokens of both lie over the same bytes, a space and the text. Their spans are coarse cuts: the character offsets of the first
tokenizer, brought to bytes, and the byte spans of the second's result message (the installed library's `proto`, which stands where
older ones have the immutable proto). A cut inside a character is no span's end, and byte-fallback tokens have empty spans, so
tokens that share a character and byte tokens are cut by the length of their decoded bytes instead. Both cut lists must then end
where the decoded bytes say, and the joined bytes must be the space and the text; else the document has no tokens.

Where both cut, a group ends. Between neighbouring cuts of either lies one link, a pair of tokens whose bytes overlap. No token of
either crosses a lone space between two characters that are none, so texts are cut there into chunks: each distinct chunk is
encoded and aligned once in a worker, many to a call, and a document's result is put together from its chunks'. The documents that hold a pair are
counted by grouping each document's distinct pairs; counts go back to the documents by a broadcast while they are few, by a salted
join beyond.

Defined results: null or empty text, and text whose bytes the tokenizers don't give back, has zeros and an empty digest; repeated
rows are documents of their own, and count as such; other columns are ignored; an empty table gives an empty result. A chunk
without a lone space is encoded whole, whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import SALTED, by_bytes, kept, stage

MODEL_A, MODEL_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A lone space between two characters that are neither white space nor the space mark.
SAFE = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
SPACE = "▁"
#: Characters of chunks and groups that a Python worker remembers at most.
REMEMBERED = 5 << 22
#: Characters of chunks that are encoded as one text.
TOGETHER = 1 << 15
#: Pairs of ids whose counts are broadcast (16 bytes each and their table); more go by a join.
MOST_PAIRS = 4_000_000
#: A pair of ids is one number: the first id in the upper half.
SHIFT = 32
#: What follows an id in the text of groups: inside a side, between the sides, after a group, after a chunk's last group.
AFTER = ",|;\n"
ID_AND_END = attrgetter("id", "end")


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable bytes themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def cut_by_length(ends: np.ndarray, some: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """ends, where those of some tokens are the end of the token before and the token's own size."""
    if not some.any():
        return ends
    before = np.maximum.accumulate(np.where(some, -1, np.arange(len(ends))))  # the last token with an end of its own
    run = np.cumsum(np.where(some, sizes, 0))
    return np.where(some, np.where(before < 0, 0, ends[before]) + run - np.where(before < 0, 0, run[before]), ends)


def two_columns(rows: Iterable[tuple[int, int]], n: int) -> np.ndarray:
    return np.fromiter(chain.from_iterable(rows), np.int64, 2 * n).reshape(n, 2)


class Places(dict):
    """The place of each chunk, given when it is first asked for."""

    def __missing__(self, chunk: str) -> int:
        place = self[chunk] = len(self)
        return place


class Aligner:
    """Groups and links of chunks, each chunk encoded once; all are forgotten when they are too many."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        byte = byte_level()
        self.bytes_a = [b""] * (1 + max(self.a.get_vocab().values()))
        for t, i in self.a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[i] = bytes(byte[c] for c in t)
        n = range(self.b.get_piece_size())
        self.is_byte = [self.b.is_byte(i) for i in n]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.is_byte[i] else p.replace(SPACE, " ").encode() for i in n for p in [self.b.id_to_piece(i)]]
        self.size_a, self.size_b = (np.array([len(x) for x in of]) for of in (self.bytes_a, self.bytes_b))
        self.is_byte = np.array(self.is_byte)
        self.written = [f"{i}{mark}" for mark in AFTER for i in range(max(len(self.bytes_a), len(n)))]  # an id and what follows it
        self.forget()

    def forget(self) -> None:
        self.place = Places()
        self.groups: list[str | None] = []
        self.held = 0
        self.numbers = np.zeros((0, 4), np.int64)  # tokens of both, groups, links
        self.start = np.zeros(0, np.int64)
        self.new: list[tuple[list[str | None], np.ndarray, np.ndarray]] = []
        self.pair = np.zeros(0, np.int64)

    def places(self, chunks: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, chunks), np.int64, len(chunks))

    def learn(self) -> None:
        """Encode and align the chunks that have a place but were not met before: those without blanks at their edges many at once, as one text."""
        chunks = list(islice(self.place, len(self.groups), None))
        runs: list[list[int]] = [[]]
        room = TOGETHER
        for k, chunk in enumerate(chunks):
            first, last = chunk[0], chunk[-1]
            if first.isspace() or last.isspace() or first == SPACE or last == SPACE:
                runs.insert(0, [k])
                continue
            if room <= 0:
                runs.append([])
                room = TOGETHER
            runs[-1].append(k)
            room -= len(chunk) + 1
        for run in runs:
            if run and not self.aligned([chunks[k] for k in run]):
                for k in run:
                    if len(run) == 1 or not self.aligned([chunks[k]]):
                        self.new.append(([None], np.zeros((1, 4), np.int64), np.zeros(0, np.int64)))
        if self.new:
            groups = list(chain.from_iterable(x[0] for x in self.new))
            numbers, pairs = (np.concatenate([x[k] for x in self.new]) for k in (1, 2))
            size = numbers[:, 3]
            start = len(self.pair) + np.cumsum(size) - size
            back = np.argsort(np.fromiter(chain.from_iterable(runs), np.int64, len(chunks)))  # runs are not in the order of places
            self.groups += map(groups.__getitem__, back.tolist())
            self.start, self.numbers = np.concatenate([self.start, start[back]]), np.concatenate([self.numbers, numbers[back]])
            self.pair = np.concatenate([self.pair, pairs])
            self.held += sum(map(len, chunks)) + sum(len(g or "") for g in groups)
            self.new = []

    def aligned(self, chunks: list[str]) -> bool:
        """Add groups, numbers and links of each of some chunks, joined by spaces and after one; False if the tokens' bytes aren't theirs."""
        chars = " " + " ".join(chunks)
        text = chars.encode()
        encoded, pieces = self.a.encode(chars, add_special_tokens=False), self.b.encode(chars[1:], return_type="proto", num_threads=1).pieces
        ids_a, spans = np.array(encoded.ids, np.int64), two_columns(encoded.offsets, len(encoded))
        ids_b, stop_b = two_columns(map(ID_AND_END, pieces), len(pieces)).T
        if any(b"".join(map(of.__getitem__, ids.tolist())) != text for of, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b))):
            return False
        size_a, size_b = self.size_a[ids_a], self.size_b[ids_b]
        one, other = np.cumsum(size_a), np.cumsum(size_b)
        if len(text) == len(chars):
            ends_a = spans[:, 1]
        else:
            at = np.append(np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80), len(text))
            shared = np.append(spans[1:, 0] < spans[:-1, 1], False)  # a character
            ends_a = cut_by_length(at[spans[:, 1]], shared, size_a)
        ends_b = cut_by_length(stop_b + 1, self.is_byte[ids_b], size_b)
        if (ends_a != one).any() or (ends_b != other).any():
            raise ValueError(f"spans and decoded bytes disagree in {chars!r}")
        cut = np.zeros(len(text) + 1, bool)
        cut[one] = cut[other] = True
        cuts = np.flatnonzero(cut)
        in_a, in_b = np.searchsorted(one, cuts), np.searchsorted(other, cuts)
        pairs = ids_a[in_a] << SHIFT | ids_b[in_b]
        both = np.flatnonzero((one[in_a] == cuts) & (other[in_b] == cuts))
        stops = np.cumsum([len(c.encode()) + 1 for c in chunks])
        upto = [np.searchsorted(x, stops) + 1 for x in (one, other, cuts[both], cuts)]  # tokens of both, groups and links up to each chunk's end
        if not all((x[u - 1] == stops).all() for x, u in zip((one, other), upto, strict=False)):
            raise ValueError(f"a token crosses a lone space in {chars!r}")
        groups = self.text_of(ids_a, ids_b, in_a[both], in_b[both], upto[2] - 1)
        self.new.append((groups, np.column_stack([np.diff(u, prepend=0) for u in upto]), pairs))
        return True

    def text_of(self, ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, last: np.ndarray) -> list[str]:
        """The groups of each chunk as text. last_a, last_b: each group's last token; last: each chunk's last group."""
        mark_a, mark_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        mark_a[last_a], mark_b[last_b] = 1, 2
        mark_b[last_b[last]] = 3
        many = len(self.written) // len(AFTER)
        of_a, of_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)  # a group's tokens
        order = np.zeros(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + np.repeat(np.cumsum(of_b) - of_b, of_a)] = mark_a * many + ids_a
        order[np.arange(len(ids_b)) + np.repeat(np.cumsum(of_a), of_b)] = mark_b * many + ids_b
        return "".join(map(self.written.__getitem__, order.tolist())).split("\n")[:-1]

    def document(self, at: np.ndarray) -> tuple[str, list[int], np.ndarray, np.ndarray] | None:
        """Groups, numbers, distinct pairs and how many links each has, of the chunks at these places."""
        one, times = np.unique(at, return_counts=True)
        numbers = self.numbers[one]
        if not numbers[:, 0].all():
            return None
        size = numbers[:, 3]
        ends = np.cumsum(size)
        where = np.arange(ends[-1]) + np.repeat(self.start[one] - (ends - size), size)
        pair, back = np.unique(self.pair[where], return_inverse=True)
        links = np.bincount(back, np.repeat(times, size)).astype(np.int64)
        return ";".join([self.groups[i] for i in at.tolist()]), (numbers * times[:, None]).sum(0).tolist(), pair, links


def aligned_tokens(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`), pairs (distinct), links (of each pair)."""
    numbers = ["n_a", "n_b", "n_groups", "n_links"]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept((path_a, path_b), lambda: Aligner(path_a, path_b))
        for batch in by_bytes(batches, "text", batch_bytes):
            if aligner.held > REMEMBERED:
                aligner.forget()
            places = [aligner.places(SAFE.split(t)) if t else None for t in batch.column("text").to_pylist()]
            aligner.learn()
            found = [(None if at is None else aligner.document(at)) or ("", [0] * 4, [], []) for at in places]
            out = {"id": batch.column("id"), **{n: pa.array([f[1][k] for f in found], pa.int64()) for k, n in enumerate(numbers)}}
            out |= {"groups": pa.array([f[0] for f in found], pa.string())}
            out |= {n: pa.array([f[k] for f in found], pa.list_(pa.int64())) for k, n in ((2, "pairs"), (3, "links"))}
            yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(align, f"id {kind}, {', '.join(f'{n} long' for n in numbers)}, groups string, pairs array<long>, links array<long>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked), best (whether no pair of its first id has a higher count)."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    a = Window.partitionBy(F.shiftright("pair", SHIFT))  # at most the second vocabulary's entries
    return counts.withColumn("best", F.col("count") == F.max("count").over(a))


def token_alignment(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", most_pairs: int = MOST_PAIRS, **options) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = aligned_tokens(docs, path_a, path_b, id_col=id_col, **options)
    rows = rows.select("*", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")).drop("groups")
    rows = stage(rows.withColumn("number", F.monotonically_increasing_id()), "aligned", compression="zstd")
    counts = stage(pair_counts(rows), "pair-counts")
    each = rows.select("number", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("number", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
    if counts.limit(most_pairs + 1).count() <= most_pairs:
        each = each.join(F.broadcast(counts), "pair")
    else:  # a pair may be in most documents: its rows are spread, its count goes to each part
        salts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTED - 1))))
        each = each.withColumn("salt", F.pmod(F.xxhash64("number"), F.lit(SALTED)).cast("int")).join(salts, ["pair", "salt"])
    sums = each.groupBy("number").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = rows.drop("pairs", "links").join(sums, "number", "left")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256")
