"""Merkle dataset manifest: a digest for the whole table, one for each source, and a proof for every document.

A document's leaf is the digest of its fields. The leaves of a source, by id, and then the sources' subroots, by name, form trees
of FAN children a node. Documents are numbered inside their source by a range partitioning, so that a source may hold any share
of the rows. FAN**LEVELS consecutive nodes of one tree are a superblock, the unit of work: upwards, each superblock becomes its top node
and the top nodes are the nodes of the next round, until a source has one; downwards, each round's nodes meet the outer nodes of
their superblock's top (the siblings from there to the root) in a cogroup, which reduces the superblock again, joins its own
siblings to the outer ones and, for leaves, folds them to the root. Sources of one superblock share tasks by hash.

H is the lowercase hex sha256 of its inputs' concatenation; a null field is `-`, another its UTF-8 byte count, `:` and its value.
Defined results: a null source is a source of its own, before the others; rows with null id come first in their source; rows of
one id are ordered by leaf, and repeated rows have leaves of their own with the same digest; a source of one row has its leaf as
subroot; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded, stage

FAN = 16
#: Levels inside a superblock.
LEVELS = 3
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "key string, pos long, n long, h string"
OUTER = "key string, pos long, n long, at array<int>, nodes array<string>, subroot string, root string"


def digest(*values: Column) -> Column:
    """H of the values' field encodings."""
    field = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*[field(v.cast("string")) for v in values]), 256)


def _hex(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def reduced(digests: list[str], n: int, height: int) -> tuple[list[list[str]], str]:
    """The runs of each level, joined, and the top node of a superblock: `height` levels up, or up to one node if it has all n of its key."""
    levels: list[list[str]] = []
    while len(digests) > 1 if n <= FAN**height else len(levels) < height:
        levels.append(["".join(digests[i : i + FAN]) for i in range(0, len(digests), FAN)])
        digests = [_hex(run) for run in levels[-1]]
    return levels, digests[0]


def steps(levels: list[list[str]], i: int) -> Iterator[tuple[int, str]]:
    """For node i, level by level: its ancestor's place in the run and the run's other nodes, joined."""
    for runs in levels:
        i, at = divmod(i, FAN)
        yield at, runs[i][: at * DIGEST] + runs[i][(at + 1) * DIGEST :]


def folded(h: str, path: list[tuple[int, str]]) -> str:
    """The digest that a node and the siblings on its way lead to."""
    for at, others in path:
        h = _hex(others[: at * DIGEST] + h + others[at * DIGEST :])
    return h


def _numbered(rows: DataFrame, height: int, *order: str) -> tuple[DataFrame, int]:
    """rows (key, ...) with pos (from 0, by the order) and n within their key, and how many rows lie in keys of one superblock."""
    placed = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange("key", *order, "_tie").sortWithinPartitions("key", *order, "_tie")
    placed = stage(placed.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("_at", 33)  # the range that the row was written by
    sizes = placed.groupBy("key", part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy("key")
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = stage(sizes.select(F.col("key").alias("_key"), "_part", "_n", "_first", before.alias("_before"), F.sum("_n").over(own).alias("n")), "merkle-sizes")
    few = sizes.where(F.col("n") <= FAN**height).agg(F.sum("_n")).first()[0] or 0
    both = placed.join(bounded(sizes), placed["key"].eqNullSafe(sizes["_key"]) & (part == sizes["_part"]))
    return both.withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_key", "_part", "_n", "_first", "_before"), few


def _unit(key: Column, block: Column, alone: Column, few: int, height: int) -> Column:
    """The task of a superblock; keys that are one superblock (alone) share some by hash."""
    return F.when(alone, F.pmod(F.xxhash64(key), F.lit(max(1, -(-few // FAN**height))))).otherwise(F.xxhash64(key, block))


def _block(pos: str, height: int) -> Column:
    return F.shiftright(pos, height * (FAN.bit_length() - 1))


def _subtrees(nodes: pd.DataFrame, height: int) -> Iterator[tuple[str | None, int, pd.DataFrame]]:
    """key, block and the nodes in order of each superblock among the rows."""
    if nodes.empty:
        return
    code = pd.factorize(nodes["key"], use_na_sentinel=False)[0]
    order = np.lexsort((nodes["pos"], code))
    nodes, code, block = nodes.iloc[order], code[order], nodes["pos"].to_numpy()[order] // FAN**height
    edges = np.flatnonzero((np.diff(code) != 0) | (np.diff(block) != 0)) + 1
    for a, b in zip([0, *edges], [*edges, len(nodes)], strict=True):
        key = nodes["key"].iloc[a]
        yield None if pd.isna(key) else key, int(block[a]), nodes.iloc[a:b]


def _lifted(nodes: DataFrame, few: int, height: int) -> DataFrame:
    """The top node of each superblock: the nodes of the next round."""

    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, block, part in _subtrees(pdf, height):
            n = int(part["n"].iloc[0])
            out.append((key, block, -(-n // FAN**height), reduced(part["h"].tolist(), n, height)[1]))
        return pd.DataFrame(out, columns=["key", "pos", "n", "h"])

    unit = _unit(F.col("key"), _block("pos", height), F.col("n") <= FAN**height, few, height)
    return nodes.select("key", "pos", "n", "h", unit.alias("unit")).groupBy("unit").applyInPandas(top, NODES)


def _rounds(nodes: DataFrame, few: int, height: int) -> list[tuple[DataFrame, int]]:
    """The nodes of each round, up to one for each key, and how many of them lie in keys of one superblock."""
    out = [(nodes, few)]
    while True:
        up = stage(_lifted(*out[-1], height), "merkle-nodes")
        few, most = up.agg(F.sum((F.col("n") <= FAN**height).cast("long")), F.max("n")).first()
        out.append((up, few or 0))
        if (most or 1) <= 1:
            return out


def _met(nodes: DataFrame, few: int, outer: DataFrame, height: int, join: Callable, schema: str) -> DataFrame:
    """Cogroup of nodes with the outer nodes of their superblocks; outer has a row for each node of the round above."""
    mine = nodes.withColumn("unit", _unit(F.col("key"), _block("pos", height), F.col("n") <= FAN**height, few, height))
    theirs = outer.withColumn("unit", _unit(F.col("key"), F.col("pos"), F.col("n") == 1, few, height))
    return mine.groupBy("unit").cogroup(theirs.groupBy("unit")).applyInPandas(join, schema)


def _settled(nodes: DataFrame, few: int, outer: DataFrame, height: int) -> DataFrame:
    """The outer nodes of each node: its siblings inside the superblock, then those of the superblock's top."""

    def join(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, pos, n, levels, above, part in _known(mine, theirs, height):
            for i in range(len(part)):
                own = list(steps(levels, i))
                out.append((key, pos + i, n, [a for a, _ in own] + list(above.at), [s for _, s in own] + list(above.nodes), above.subroot, above.root))
        return pd.DataFrame(out, columns=["key", "pos", "n", "at", "nodes", "subroot", "root"])

    return _met(nodes, few, outer, height, join, OUTER)


def _known(mine: pd.DataFrame, theirs: pd.DataFrame, height: int) -> Iterator[tuple]:
    """Each superblock: key, first position, nodes of its key, levels, outer nodes of its top, its nodes."""
    known = {(None if pd.isna(r.key) else r.key, r.pos): r for r in theirs.itertuples()}
    for key, block, part in _subtrees(mine, height):
        n = int(part["n"].iloc[0])
        yield key, block * FAN**height, n, reduced(part["h"].tolist(), n, height)[0], known[key, block], part


def manifest(docs: DataFrame, *, id_col: str = "doc_id", key_col: str = "source", fields: tuple[str, ...] = FIELDS, found: dict[str, Column] | None = None, proofs: bool = False, height: int = LEVELS) -> DataFrame:
    """One row per document: id, key, leaf, subroot, root, proof_sha256, folded_root, verified.

    found: values of fields as they are found when the manifest is verified; a document whose fields have others leads to another
    root (folded_root) and isn't verified. proofs: the proof itself too, `proof`: from leaf to root, its place and the other nodes. height: levels of a
    superblock.
    """
    plain, kind = [docs[f] for f in fields], docs.schema[id_col].dataType.simpleString()
    now = digest(*[found.get(f, docs[f]) for f in fields]) if found else F.lit(None).cast("string")
    rows = docs.select(docs[key_col].cast("string").alias("key"), docs[id_col].alias("id"), digest(*plain).alias("h"), now.alias("found"))
    leaves, few = _numbered(stage(rows, "merkle-leaves"), height, "id", "h", "found")
    rounds = _rounds(leaves.withColumn("id", F.col("id").cast("string")), few, height)
    subroots, few = _numbered(rounds[-1][0].select(F.lit("").alias("key"), F.col("key").alias("id"), "h"), height, "id")
    above = _rounds(subroots, few, height)
    outer = above[-1][0].select("key", "pos", "n", F.array().cast("array<int>").alias("at"), F.array().cast("array<string>").alias("nodes"), F.lit(None).cast("string").alias("subroot"), F.col("h").alias("root"))
    for nodes, few in reversed(above[:-1]):
        outer = stage(_settled(nodes, few, outer, height), "merkle-outer")
    named = subroots.select("pos", F.col("id").alias("_of"), F.col("h").alias("_subroot"))
    outer = outer.select("pos", "at", "nodes", "root").join(named, "pos")
    outer = outer.select(F.col("_of").alias("key"), F.lit(0).cast("long").alias("pos"), F.lit(1).cast("long").alias("n"), "at", "nodes", F.col("_subroot").alias("subroot"), "root")
    for nodes, few in reversed(rounds[1:-1]):
        outer = stage(_settled(nodes, few, outer, height), "merkle-outer")

    def prove(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, _, _, levels, above, part in _known(mine, theirs, height):
            far, rest, ends = list(zip(above.at, above.nodes, strict=True)), "".join(above.nodes), {}
            for i, (doc, h, other) in enumerate(zip(part["id"], part["h"], part["found"], strict=True)):
                own = list(steps(levels, i))
                end = folded(h if other is None else other, own)
                if end not in ends:
                    ends[end] = folded(end, far)
                path = [{"at": a, "nodes": s} for a, s in [*own, *far]] if proofs else None
                out.append((doc, key, h, above.subroot, above.root, _hex("".join(s for _, s in own) + rest), ends[end], ends[end] == above.root, path))
        return pd.DataFrame(out, columns=["id", "key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"])

    schema = "id string, key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof array<struct<at:int,nodes:string>>"
    out = _met(*rounds[0], outer, height, prove, schema).withColumn("id", F.col("id").cast(kind))
    return (out if proofs else out.drop("proof")).withColumnsRenamed({"id": id_col, "key": key_col})


def tampered_manifest(docs: DataFrame, **options) -> DataFrame:
    """The manifest, verified against texts of which those whose id's crc32 5 divides are found with their A-Z in lower case."""
    hit = F.crc32(docs["doc_id"].cast("string")) % 5 == 0
    return manifest(docs, found={"text": F.when(hit, F.translate(docs["text"], ascii_uppercase, ascii_lowercase)).otherwise(docs["text"])}, **options)


def oracle(leaf_levels: int = 5, top_levels: int = 4) -> str:
    """tampered_manifest as DuckDB SQL over documents, of up to FAN**leaf_levels documents a source and FAN**top_levels sources."""
    field = lambda v: f"coalesce(strlen({v}) || ':' || {v}, '-')"
    h = lambda text: f"sha256({field('doc_id::varchar')} || {field('source')} || {field('lang')} || {field('n_chars::varchar')} || {field(text)})"
    # the checksum, bit by bit: a byte goes in, then eight shifts
    crc = "xor(list_reduce([4294967295::bigint] || flatten(list_transform(string_split(doc_id::varchar, ''), lambda ch: [ascii(ch)::bigint] || list_resize([]::bigint[], 8, -1))), lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, (c & 1) * 3988292384) end), 4294967295)"
    out = [
        f"leaves as (select *, {h('text')} as leaf, {h('low')} as other from (select *, case when {crc} % 5 = 0 then translate(text, '{ascii_uppercase}', '{ascii_lowercase}') else text end as low from documents))",
        "a0 as (select source as k, row_number() over (partition by source order by doc_id nulls first, leaf, other) - 1 as pos, count(*) over (partition by source) as n, doc_id, leaf as h, other from leaves)",
    ]

    def tree(t: str, levels: int) -> None:
        for i in range(levels):
            out.append(f"{t}r{i} as (select k, pos // {FAN} as pos, n, string_agg(h, '' order by pos) as run from {t}{i} group by k, pos // {FAN}, n)")
            out.append(f"{t}{i + 1} as (select k, pos, (n + {FAN - 1}) // {FAN} as n, case when n > 1 then sha256(run) else run end as h{', null as doc_id, null as other' if t == 'a' else ''} from {t}r{i})")

    tree("a", leaf_levels)
    out.append(f"b0 as (select 0 as k, row_number() over (order by k nulls first) - 1 as pos, count(*) over () as n, h, k as source from a{leaf_levels})")
    tree("b", top_levels)
    step = lambda t, i, p: f"(select l.*, case when r.n > 1 then substr(run, 1, {DIGEST} * ({p} % {FAN})) end as x, case when r.n > 1 then substr(run, {DIGEST} * ({p} % {FAN}) + {DIGEST + 1}) end as y from {{}} l join {t}r{i} r on r.k is not distinct from l.{'source' if t == 'a' else 'zero'} and r.pos = {p} // {FAN})"
    fold = "case when x is null then f else sha256(x || f || y) end as f, proof || coalesce(x, '') || coalesce(y, '') as proof"
    out.append("p0 as (select doc_id, k as source, 0 as zero, pos, h as leaf, other as f, '' as proof from a0)")
    for i in range(leaf_levels):
        out.append(f"p{i + 1} as (select doc_id, source, zero, pos // {FAN} as pos, leaf, {fold} from {step('a', i, 'l.pos').format(f'p{i}')})")
    out.append(f"q0 as (select p.* replace (b.pos as pos), b.h as subroot from p{leaf_levels} p join b0 b on b.source is not distinct from p.source)")
    for i in range(top_levels):
        out.append(f"q{i + 1} as (select doc_id, source, zero, pos // {FAN} as pos, leaf, subroot, {fold} from {step('b', i, 'l.pos').format(f'q{i}')})")
    return f"with {', '.join(out)} select doc_id, source, leaf, subroot, root.h as root, sha256(proof) as proof_sha256, f as folded_root, f = root.h as verified from q{top_levels}, b{top_levels} root"
