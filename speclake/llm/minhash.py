"""b-bit MinHash near-duplicates with exact confirmation.

1. Every document's set of word shingles is hashed to HASHES minima. A digest of the set collapses copies into classes.
2. Bands of minima give buckets of classes. A class is first paired with a few hubs of each of its buckets, so a large group of
   near copies costs a few pairs a member, not all pairs.
3. Of each pair the low B_BITS of the minima, packed in bit planes, are compared by bit counts; the collision-corrected
   similarity must reach SURE_BELOW (more than five standard deviations under the threshold).
4. Pairs that are left are confirmed on the full sets. Confirmed links give components.
5. A bucket whose members, without its hub, still lie in different components is unresolved. Unresolved buckets that share
   members form families. A family of more than one block is split first, by the packed minima alone: the members of each of its
   buckets are compared in pairs of blocks, and what reaches SURE_BELOW across components makes the new, smaller families. Then
   texts move: a family is cut in blocks, each pair of blocks is compared on the full sets inside one task, and only a spanning
   forest of the links between different components comes out. So every pair that shares a bucket is confirmed, refuted or
   already connected; then components are joined.

A pair at the threshold of 0.8 shares no bucket with probability (1 - 0.8**4)**32, about 5e-8.

Defined results: null, empty or blank text has an empty set and links with nothing; one word is one shingle; rows that share a
doc_id are one document (linked if any of their texts is); a row without id links with nothing, has a null component and is
kept; an empty table gives an empty result; other columns are ignored or pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded, by_bytes, mix, prefix_hashes, release, span_hashes, stage, utf8, word_spans

HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
B_BITS = 4
SURE_BELOW = 0.6
HUBS = 4
#: A block of a family holds about so many texts and shingles at most.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 2_000_000
#: A block of a bucket holds about so many packed signatures.
BLOCK_PLANES = 2048
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles of `words` words (A-Z lower-cased)."""
    data, at = utf8(texts)
    data = _lower[data]
    start, end, row = word_spans(data, at)
    h = mix(span_hashes(prefix_hashes(data), start, end) ^ (end - start).astype(np.uint64))
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        rolled = mix(rolled * np.uint64(3) + h[k : k + len(rolled)])
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for x in h[a:b]:
                whole = mix(whole * np.uint64(3) + x)
            out.append(whole ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least 32-bit value of every hash function over a set that isn't empty."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for k in range(0, len(hashes), 4096):
        out = np.minimum(out, ((hashes[k : k + 4096, None] * _A + _B) >> np.uint64(32)).min(0))
    return out


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            sets = shingle_sets(batch.column("text"), words)
            digests, bands, planes = [], [], []
            for s in sets:
                if not len(s):
                    digests.append(None), bands.append(None), planes.append(None)
                    continue
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                m = minima(s)
                b = np.zeros(BANDS, np.uint64)
                for k in range(ROWS):
                    b = mix(b * np.uint64(5) + m[k::ROWS])
                bands.append(b.view(np.int64))
                bits = np.stack([(m >> np.uint64(k)) & np.uint64(1) for k in range(B_BITS)]).astype(np.uint8)
                planes.append(np.packbits(bits, axis=1).view(np.int64).ravel())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "digest": pa.array(digests, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64())), "planes": pa.array(planes, pa.list_(pa.int64()))})

    return run


def estimate(a: Column, b: Column) -> Column:
    """Similarity by the share of equal b-bit minima, corrected for chance collisions."""
    lanes = HASHES // 64
    equal = F.lit(0)
    for k in range(lanes):
        differ = F.lit(0).cast("long")
        for p in range(B_BITS):
            differ = differ.bitwiseOR(F.get(a, F.lit(p * lanes + k)).bitwiseXOR(F.get(b, F.lit(p * lanes + k))))
        equal = equal + 64 - F.bit_count(differ)
    chance = 2.0**-B_BITS
    return (equal / HASHES - chance) / (1 - chance)


def _confirmed(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text_a", 1 << 19):
            left, right = shingle_sets(batch.column("text_a"), words), shingle_sets(batch.column("text_b"), words)
            ok = []
            for x, y in zip(left, right, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both) > 0)
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(ok, pa.bool_()))

    return run


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of its component, for the nodes of links (a, b); by least neighbours and jumps."""
    edges = stage(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stage(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("least"))
        jump = labels.select(F.col("node").alias("least"), F.col("label").alias("far"))
        step = stage(least.join(jump, "least", "left").select("node", F.col("label").alias("was"), F.least("least", F.coalesce("far", "least")).alias("label")), "labels")
        release(labels)
        labels = step.select("node", "label")
        if step.where("was <> label").isEmpty():
            release(edges)
            return labels


def _confirm(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose estimate isn't surely below and whose full sets are similar enough."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("planes").alias(f"planes_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b")
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    likely = stage(likely.where(sizes & (estimate(F.col("planes_a"), F.col("planes_b")) >= SURE_BELOW)).select("a", "b"), "likely")
    needed = stage(likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct(), "needed")
    known = stage(texts.join(bounded(needed), "doc_id", "left_semi"), "texts")
    text = lambda x: known.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    both = likely.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b")
    kind = classes.schema["node"].dataType.simpleString()
    return stage(both.mapInArrow(_confirmed(words, percent), f"a {kind}, b {kind}").distinct(), "links")


def _forest(words: int, percent: int):
    """Links between different labels of two blocks of a family, as a spanning forest of the labels."""

    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        sets = shingle_sets(pa.array(block["text"], pa.string()), words)
        size = np.array([len(s) for s in sets])
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(sets)), size)
        _, code, n = np.unique(flat, return_inverse=True, return_counts=True)
        often = n > 1
        column = np.cumsum(often) - 1
        keep = often[code]
        owner, code = owner[keep], column[code[keep]]
        mine = block["block"].to_numpy()
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        both = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, int(often.sum()), 8192):
            part = (code >= lo) & (code < lo + 8192)
            dense = np.zeros((len(sets), 8192), np.float32)
            dense[owner[part], code[part] - lo] = 1
            both += dense[left] @ dense[right].T
        label = block["label"].to_numpy()
        either = size[left][:, None] + size[right][None, :] - both
        linked = (100 * both >= percent * either) & (either > 0) & (label[left][:, None] != label[right][None, :])
        root: dict = {}

        def find(x):
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        out = []
        for a, b in zip(*np.nonzero(linked), strict=True):
            x, y = label[left[a]], label[right[b]]
            if find(x) != find(y):
                root[find(x)] = find(y)
                out.append((x, y))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64" if label.dtype == np.int64 else object)

    return run


def _likely(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Stars (a, b) that connect the rows of two blocks of a bucket whose estimates reach SURE_BELOW across labels."""
    i, j = key[-2:]
    rows = rows.sort_values("node", kind="stable")
    planes = np.stack(rows["planes"]).astype(np.int64).view(np.uint64)
    mine, label, node = rows["block"].to_numpy(), rows["label"].to_numpy(), rows["node"].to_numpy()
    left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
    lanes = HASHES // 64
    equal = np.full((len(left), len(right)), HASHES, np.int16)
    for k in range(lanes):
        differ = np.zeros(equal.shape, np.uint64)
        for p in range(k, B_BITS * lanes, lanes):
            differ |= planes[left, p][:, None] ^ planes[right, p][None, :]
        equal -= np.bitwise_count(differ).astype(np.int16)
    chance = 2.0**-B_BITS
    near = ((equal / HASHES - chance) / (1 - chance) >= SURE_BELOW) & (label[left][:, None] != label[right][None, :])
    first, n = np.arange(len(rows)), len(rows)
    while True:
        old = first.copy()
        np.minimum.at(first, left, np.where(near, first[right][None, :], n).min(1, initial=n))
        np.minimum.at(first, right, np.where(near, first[left][:, None], n).min(0, initial=n))
        first = first[first]
        if (first == old).all():
            break
    other = np.flatnonzero(first != np.arange(n))
    return pd.DataFrame({"a": node[first[other]], "b": node[other]})


def _in_blocks(df: DataFrame) -> DataFrame:
    """Each row of a group of `blocks` blocks, once for every pair i <= j of its own block with another."""
    df = df.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return df.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")


def _families(led: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """node, label, family and the family's blocks, where nodes that share a lead are one family. led: node, lead; a lead leads itself.

    A node's leads are joined by links to the least of them, so components are sought among the few leads, not all nodes.
    """
    led = stage(led.withColumn("top", F.min("lead").over(Window.partitionBy("node"))), "led")
    families = components(led.where("lead <> top").select(F.col("lead").alias("a"), F.col("top").alias("b")).distinct())
    tops = led.where("lead = top").select("node", "top").distinct().join(families.select(F.col("node").alias("top"), F.col("label").alias("family")), "top", "left")
    members = tops.join(labels, "node", "left").join(classes.select("node", "n_shingles"), "node")
    members = stage(members.select("node", F.coalesce("label", "node").alias("label"), F.coalesce("family", "top").alias("family"), "n_shingles"), "families")
    sizes = members.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    return stage(members.join(sizes, "family").select("node", "label", "family", "blocks"), "blocks")


def _unresolved_links(shared: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between components (their labels) that hub pairs haven't shown. shared: band, bucket, node, hub."""
    kind = classes.schema["node"].dataType.simpleString()
    named = shared.where("node <> hub").join(labels, "node", "left").select("band", "bucket", "node", F.coalesce("label", "node").alias("label"))
    torn = named.groupBy("band", "bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("first"), F.ceil(F.count("*") / BLOCK_PLANES).cast("int").alias("blocks")).where("lo <> hi")
    named = stage(named.join(torn.drop("lo", "hi"), ["band", "bucket"]), "torn")
    members = _families(named.select("node", F.col("first").alias("lead")), labels, classes)
    large = members.where("blocks > 1").select("node")
    if not large.isEmpty():
        packed = named.join(large, "node", "left_semi").join(classes.select("node", "planes"), "node").select("band", "bucket", "blocks", "node", "label", "planes")
        near = stage(_in_blocks(packed).groupBy("band", "bucket", "i", "j").applyInPandas(_likely, f"a {kind}, b {kind}").distinct(), "near")
        led = near.select(F.col("b").alias("node"), F.col("a").alias("lead")).union(near.select("a", "a").distinct())
        members = stage(members.where("blocks = 1").union(_families(led, labels, classes)), "members")
    known = texts.select(F.col("doc_id").alias("node"), "text").join(bounded(members), "node")
    dealt = _in_blocks(known).select("family", "i", "j", "node", "label", "block", "text")
    return stage(dealt.groupBy("family", "i", "j").applyInPandas(_forest(words, percent), f"a {kind}, b {kind}"), "links")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id reachable by links), kept (the component's first)."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    signed = stage(texts.mapInArrow(_signatures(words), f"doc_id {kind}, n_shingles long, digest binary, bands array<long>, planes array<long>"), "signatures")
    members = signed.where("digest is not null and doc_id is not null")
    classes = stage(members.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("planes").alias("planes")), "classes")

    buckets = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    hubs = buckets.groupBy("band", "bucket").agg(F.min_by("node", F.xxhash64("node", F.col("band") % HUBS)).alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = stage(buckets.join(hubs, ["band", "bucket"]), "buckets")
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    star = stage(shared.where("node <> hub").select(*ordered("node", "hub")).distinct(), "star")
    links = _confirm(star, classes, texts, words, percent)
    labels = components(links)

    more = _unresolved_links(shared, labels, classes, texts, words, percent)
    joined = components(more).select(F.col("node").alias("component"), F.col("label").alias("least"))

    several = classes.where("n > 1").select("digest", "node")
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    out = out.join(several, "digest", "left").withColumn("node", F.coalesce("node", "doc_id")).join(labels, "node", "left")
    out = out.withColumn("component", F.coalesce("label", "node")).join(bounded(joined), "component", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "component"))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents that are first in their component, with their own columns."""
    id_col = options.get("id_col", "doc_id")
    gone = stage(near_duplicates(docs, **options).where("not kept").select(id_col).distinct(), "gone")
    return docs.join(bounded(gone), id_col, "left_anti").select(*docs.columns)


def oracle() -> str:
    """near_duplicates with 2 words as DuckDB SQL over documents (doc_id unique): shared shingles counted, labels spread."""
    return r"""
    with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
    s as (select distinct doc_id, case when len(words) = 1 then words[1] else words[i] || ' ' || words[i + 1] end as sh
          from (select doc_id, words, unnest(range(1, greatest(len(words), 2))) as i from w where len(words) > 0)),
    n as (select doc_id, count(*) as n from s group by doc_id),
    common as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
    links as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
    e as (select a, b from links union all select b, a from links),
    reach(a, b) as (select a, b from e union select reach.a, e.b from reach join e on reach.b = e.a)
    select w.doc_id, coalesce(max(n.n), 0)::bigint as n_shingles, least(w.doc_id, min(reach.b)) as component_id, w.doc_id = least(w.doc_id, min(reach.b)) as kept
    from w left join n using (doc_id) left join reach on reach.a = w.doc_id group by w.doc_id"""
