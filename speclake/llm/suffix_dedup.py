"""Removal of long repeated byte strings by hash-compared suffix sorts.

A byte goes if a string of `length` bytes covers it that also starts earlier (smaller id, or earlier in the same document).

1. Every window of `length` bytes picks its anchor: the GRAM-byte string in it with the least hash, leftmost first. Equal windows
   have equal anchors at the same offset. The windows of one anchor start in a run [a, b]; its context is the bytes [a, b + length).
2. Anchors are dealt by gram hash. A context that was seen earlier has only windows that were seen earlier; in a map task such
   repeats are found and verified byte by byte before the shuffle, so a common passage sends one row a task. What is left of the
   contexts with equal hashes sends its bytes, dealt by context, and is verified there; bytes that differ end the job with an
   error, as no result would be sure (chance: about 1e-15 in 1e12 anchors). Grams with one context are done.
3. The rest, first contexts of grams with several, lie where repeats begin and end. Their bytes are dealt by gram, and the windows
   of a gram are sorted as suffixes: a mergesort whose comparisons find the common extension of two suffixes by binary search
   over prefix polynomial hashes, in logarithmic time; windows found equal are verified byte by byte, and all but the earliest are
   marked. A gram with more than CROWDED contexts is sorted in each map task first, and its windows are dealt one by one.
4. Marked windows are merged into runs by document and cut out.

Defined results: null or empty text has 0 bytes and keeps nothing; texts shorter than `length` keep all; rows with the same id and
text are the same document and get the same result; rows with the same id and other texts are different documents, in order of
a hash of the text; a null id comes before all others; ids that aren't whole numbers are ordered as text; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ._common import by_bytes, mix, or_empty, prefix_hashes, span_hashes, stage, utf8

LENGTH, GRAM = 100, 24
#: Contexts that a map task remembers to find repeats before the shuffle; older ones are forgotten, which only sends more rows.
REMEMBERED = 200_000
#: Grams with more contexts are compared window by window, so that their work is spread.
CROWDED = 4096


def anchors(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, anchor position, first and last window start of each run of windows; gram and context hashes."""
    n, w = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = prefix_hashes(data)
    pos = np.arange(n - gram + 1)
    h = mix(span_hashes(prefix, pos, pos + gram))
    bits = np.uint64(max(1, int(n).bit_length()))
    key = (h >> bits << bits) | pos.astype(np.uint64)
    least, done = key, 1
    while done * 2 <= w:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < w:
        least = np.minimum(least[: len(least) - (w - done)], least[w - done :])
    start = np.arange(len(least))
    row = np.searchsorted(at, start, side="right") - 1
    inside = start + length <= at[row + 1]
    start, row = start[inside], row[inside]
    if not len(start):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    m = (least[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(m)) - 1
    a, b, m = start[first], start[last], m[first]
    context = mix(span_hashes(prefix, a, b + length) ^ ((b - a) * 256 + (m - a)).astype(np.uint64))
    return row[first], m, a, b, h[m], context


class Suffixes:
    """Suffixes of a byte array, compared on their first `length` bytes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length, self.prefix = data, length, prefix_hashes(data)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y, at most `length`: binary search over equal prefix hashes."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.length)
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = span_hashes(self.prefix, x, x + middle) == span_hashes(self.prefix, y, y + middle)
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
        return low

    def after(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x is greater than y; equal ones go by position."""
        e = self.extension(x, y)
        cut = e < self.length
        i = np.where(cut, e, 0)
        return np.where(cut, self.data[x + i] > self.data[y + i], x > y)

    def sort(self, suffix: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The suffixes with each group sorted: a bottom-up mergesort of all groups at once. Groups are runs."""
        edge = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
        which = np.searchsorted(edge, np.arange(len(group)), side="right") - 1
        begin, end = edge[which], edge[which + 1]
        place = np.arange(len(group))
        width, widest = 1, int((end - begin).max(initial=1))
        while width < widest:
            run = (place - begin) // width
            other = begin + (run ^ 1) * width
            low, high = np.minimum(other, end), np.minimum(other + width, end)
            start_other = low.copy()
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) // 2
                greater = self.after(suffix[open_], suffix[middle])
                low[open_[greater]] = middle[greater] + 1
                high[open_[~greater]] = middle[~greater]
            own = begin + (run & ~1) * width
            target = own + (place - begin - run * width) + (low - start_other)
            out = np.empty_like(suffix)
            out[target] = suffix
            suffix, width = out, width * 2
        return suffix

    def equal_before(self, suffix: np.ndarray) -> np.ndarray:
        """Whether each of the sorted suffixes equals the one before; equal hashes are verified on the bytes."""
        same = np.zeros(len(suffix), bool)
        x, y = suffix[1:], suffix[:-1]
        hit = np.flatnonzero(self.extension(x, y) == self.length)
        for k in range(0, len(hit), 8192):
            part = hit[k : k + 8192]
            span = np.arange(self.length)
            same[part + 1] = (self.data[x[part][:, None] + span] == self.data[y[part][:, None] + span]).all(1)
        return same


def _packed(a: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """First window, number of windows less one, and offset of the anchor (-1: a repeat) in one integer that sorts by a."""
    return (a << 32) | (n << 8) | (m + 1)


def _anchor_rows(length: int, gram: int):
    """A row for each anchor that isn't a repeat within the task, and one for each run of neighbours that are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], tuple] = {}
        for batch in by_bytes(batches, "text", 1 << 19):
            data, at = utf8(batch.column("text"))
            raw = data.tobytes()
            row, m, a, b, g, c = anchors(data, at, length, gram)
            ids, digests = batch.column("id").to_numpy(zero_copy_only=False)[row], batch.column("digest").to_numpy()[row]
            start = a - at[row]
            repeat = np.zeros(len(row), bool)
            for i, (key, mine, lo, hi) in enumerate(zip(zip(g.tolist(), c.tolist()), zip(ids.tolist(), digests.tolist(), start.tolist()), a.tolist(), (b + length).tolist(), strict=True)):
                before = seen.get(key)
                if before is None or mine < before[0]:
                    seen[key] = mine, raw[lo:hi]
                elif mine > before[0] and raw[lo:hi] == before[1]:
                    repeat[i] = True
            if len(seen) > REMEMBERED:
                seen = dict(list(seen.items())[len(seen) // 2 :])
            n = b - a
            r = np.flatnonzero(repeat)
            new = np.ones(len(r), bool)
            new[1:] = (np.diff(r) > 1) | (row[r][1:] != row[r][:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(r)) - 1 if len(r) else first
            f = ~repeat
            span = start[r[last]] + n[r[last]] - start[r[first]]
            cut = span < 1 << 23
            for x in np.flatnonzero(~cut):  # as they were
                f[r[first[x]] : r[last[x]] + 1] = True
            first, span = first[cut], span[cut]
            out = np.append(np.flatnonzero(f), r[first])
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(ids[out], batch.schema.field("id").type),
                "digest": pa.array(digests[out]),
                "at": pa.array(np.concatenate([_packed(start, n, m - a)[f], _packed(start[r[first]], span, np.full(len(first), -1))])),
                "gram": pa.array(np.concatenate([g[f], mix(digests[r[first]].view(np.uint64))]).view(np.int64)),
                "context": pa.array(np.concatenate([c[f], np.zeros(len(first), np.uint64)]).view(np.int64)),
            })

    return run


def _contexts(length: int):
    """Rows with the bytes of unresolved runs: by their gram; and by their context (`same`) where its hash is on several rows.

    Runs of a crowded gram give a row for each window instead, keyed by a hash of the window, after a suffix sort within the
    batch has found repeats; those come without bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 1 << 19):
            data, at = utf8(batch.column("text"))
            raw = data.tobytes()
            documents = list(zip(batch.column("id").to_pylist(), batch.column("digest").to_pylist(), strict=True))
            once = {d: r for r, d in reversed(list(enumerate(documents)))}
            order = np.array([once[d] for d in sorted(once)], np.int64)
            key, same, owner, where, context = [], [], [], [], []
            spots, rows, group = [], [], []
            for r in order.tolist():
                runs = batch.column("runs")[r].values
                for w, g, c, crowded in zip(*(runs.field(f).to_pylist() for f in ("at", "gram", "context", "crowded")), strict=True):
                    a, n, m = w >> 32, (w >> 8) & 0xFFFFFF, (w & 0xFF) - 1
                    start = int(at[r]) + a
                    if start + n + length > at[r + 1]:
                        continue
                    if c is not None:
                        key.append(g ^ c), same.append(c), owner.append(r), where.append(w & ~0xFF), context.append(raw[start : start + n + length])
                    if crowded:
                        p = np.arange(n + 1)
                        spots.append(start + p)
                        rows.append(np.full(n + 1, r))
                        group.append(mix(np.uint64(g & (2**64 - 1)) ^ mix((m - p).astype(np.uint64))))
                    elif crowded is not None:
                        key.append(g), same.append(None), owner.append(r), where.append(w), context.append(raw[start : start + n + length])
            if spots:
                pos, row, grp = (np.concatenate(v) for v in (spots, rows, group))
                rank = np.empty(len(at), np.int64)
                rank[order] = np.arange(len(order))
                first = np.lexsort((pos, rank[row], grp))
                pos, row, grp = pos[first], row[first], grp[first]
                shift = np.append(0, np.cumsum((at[1:] - at[:-1])[order]))[:-1] - at[order]  # documents in order, so that position is precedence
                text = np.concatenate([data[at[r] : at[r + 1]] for r in order])
                sorter = Suffixes(text, length)
                pos = sorter.sort(pos + shift[rank[row]], grp)
                again = sorter.equal_before(pos)
                again[1:] &= grp[1:] == grp[:-1]
                row = order[np.searchsorted(at[order] + shift, pos, side="right") - 1]
                pos = pos - shift[rank[row]]
                for q, r, repeat in zip(pos.tolist(), row.tolist(), again.tolist(), strict=True):
                    window = None if repeat else raw[q : q + length]
                    key.append(q if repeat else xxhash.xxh3_64_intdigest(window) - (1 << 63)), same.append(None), owner.append(r)
                    where.append(((q - int(at[r])) << 32) + (0 if repeat else 1)), context.append(window)
            who = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_pydict({"key": pa.array(key, pa.int64()), "same": pa.array(same, pa.int64()), "id": batch.column("id").take(who), "digest": batch.column("digest").take(who), "at": pa.array(where, pa.int64()), "context": pa.array(context, pa.binary())})

    return run


def _complete(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.Table]:
    """Tables of whole keys, of about `limit` bytes at least; the batches are sorted by key."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy()
        for part in by_bytes(iter([batch]), "context", limit):
            held.append(part)
            size += part.nbytes
            if size >= limit:
                whole = pa.Table.from_batches(held)
                keys = whole.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1], side="left"))
                if cut:
                    yield whole.slice(0, cut)
                held = whole.slice(cut).to_batches()
                size = sum(x.nbytes for x in held) // 2
    if held:
        yield pa.Table.from_batches(held)


def _sorted_runs(length: int):
    """Marks of the windows that equal an earlier one of their key: of whole contexts, verified, and by a suffix sort of the key's contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _complete(batches):
            key, digest, where = (table.column(c).to_numpy() for c in ("key", "digest", "at"))
            known, whole = (np.asarray(table.column(c).is_valid()) for c in ("context", "same"))
            ids, same = table.column("id").combine_chunks(), table.column("same").fill_null(0).to_numpy()
            twin = np.zeros(len(key), bool)
            if len(key) > 1:
                twin[1:] = (key[1:] == key[:-1]) & (whole[1:] == whole[:-1]) & (digest[1:] == digest[:-1]) & (where[1:] == where[:-1]) & np.asarray(pc.equal(ids[1:], ids[:-1]))
            rows = np.flatnonzero(whole & ~twin)
            texts = table.column("context").take(pa.array(rows)).to_pylist()
            after = np.flatnonzero((key[rows][1:] == key[rows][:-1]) & (same[rows][1:] == same[rows][:-1])) + 1
            if any(texts[i] != texts[i - 1] for i in after.tolist()):
                raise RuntimeError("two contexts with one hash: choose another gram length")
            parts = [(rows[after], where[rows[after]]), (np.flatnonzero(~known), where[~known])]
            use = np.flatnonzero(known & ~whole & ~twin)
            if len(use):
                texts = table.column("context").take(pa.array(use)).to_pylist()
                text = np.frombuffer(b"".join(texts), np.uint8)
                base = np.append(0, np.cumsum([len(t) for t in texts]))
                a, m = where[use] >> 32, (where[use] & 0xFF) - 1
                n = base[1:] - base[:-1] - length + 1
                row = np.repeat(np.arange(len(use)), n)
                p = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                grp = mix(key[use][row].view(np.uint64) ^ mix((m[row] - p).astype(np.uint64)))
                order = np.lexsort((base[row] + p, grp))
                pos, grp = (base[row] + p)[order], grp[order]
                sorter = Suffixes(text, length)
                pos = sorter.sort(pos, grp)
                again = sorter.equal_before(pos)
                again[1:] &= grp[1:] == grp[:-1]
                hit = np.sort(pos[again])
                row = np.searchsorted(base, hit, side="right") - 1
                new = np.ones(len(hit), bool)
                new[1:] = (np.diff(hit) > 1) | (row[1:] != row[:-1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(hit)) - 1 if len(hit) else first
                parts.append((use[row[first]], _packed(a[row[first]] + hit[first] - base[row[first]], hit[last] - hit[first], np.full(len(first), -1))))
            who = np.concatenate([x for x, _ in parts])
            yield pa.RecordBatch.from_pydict({"id": ids.take(pa.array(who)), "digest": pa.array(digest[who]), "at": pa.array(np.concatenate([x for _, x in parts]), pa.int64())})

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 1 << 20):
            data, at = utf8(batch.column("text"))
            removed, spans, digests = [], [], []
            for r in range(batch.num_rows):
                body = data[at[r] : at[r + 1]]
                delta = np.zeros(len(body) + 1, np.int64)
                marks = batch.column("marks")[r]
                if marks.is_valid and len(marks.values):
                    where = marks.values.to_numpy()
                    a, n = where >> 32, (where >> 8) & 0xFFFFFF
                    np.add.at(delta, np.minimum(a, len(body)), 1)
                    np.add.at(delta, np.minimum(a + n + length, len(body)), -1)
                gone = np.cumsum(delta)[:-1] > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.append(False, gone[:-1])).sum()) if len(gone) else 0)
                digests.append(hashlib.sha256(body[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("own"), "n_bytes": pa.array(at[1:] - at[:-1]), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests)})

    return run


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    own = docs.schema[id_col].dataType
    kind, least = ("long", F.lit(-(1 << 63))) if isinstance(own, IntegralType) else ("string", F.lit(""))
    text = or_empty(docs[text_col])
    rows = docs.select(docs[id_col].alias("own"), F.coalesce(docs[id_col].cast(kind), least).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    who = f"id {kind}, digest long, at long"
    found = rows.where(F.octet_length("text") >= length).select("id", "digest", "text").mapInArrow(_anchor_rows(length, gram), f"{who}, gram long, context long")
    found = found.repartition("gram").sortWithinPartitions("gram", "context", "id", "digest", "at")
    by_gram, by_context = Window.partitionBy("gram"), Window.partitionBy("gram", "context")
    found = found.withColumn("nth", F.rank().over(by_context.orderBy("id", "digest", "at"))).withColumn("as_many", F.count("*").over(by_context))
    found = found.withColumn("several", F.min("context").over(by_gram) != F.max("context").over(by_gram)).withColumn("size", F.count("*").over(by_gram))
    local = F.col("at").bitwiseAND(0xFF) == 0
    again, several = ~local & (F.col("as_many") > 1), ~local & (F.col("nth") == 1) & F.col("several")
    found = found.where(local | again | several)
    found = stage(found.select("id", "digest", "at", F.when(again | several, F.col("gram")).alias("gram"), F.when(again, F.col("context")).alias("context"), F.when(several, F.col("size") > CROWDED).alias("crowded")), "repeats")
    runs = found.where("gram is not null").groupBy("id", "digest").agg(F.collect_set(F.struct("at", "gram", "context", "crowded")).alias("runs"))
    contexts = rows.join(runs, ["id", "digest"]).select("own", "id", "digest", "text", "runs")  # all columns of rows, so that their exchange serves both joins
    contexts = contexts.mapInArrow(_contexts(length), f"key long, same long, {who}, context binary")
    again = contexts.repartition("key").sortWithinPartitions("key", "same", "id", "digest", "at").mapInArrow(_sorted_runs(length), who)
    marks = found.where("gram is null").select("id", "digest", "at").union(again).groupBy("id", "digest").agg(F.collect_list("at").alias("marks"))
    out = rows.join(marks, ["id", "digest"], "left").select("own", "id", "digest", "text", "marks")
    return out.mapInArrow(_cut(length), f"doc_id {own.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("doc_id", id_col)
