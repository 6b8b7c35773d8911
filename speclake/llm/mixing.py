"""Mixing sources to target weights by iterative proportional fitting.

Token sums by (source, language, topic) cell are raked to the target marginals of the three; a document's probability is its
cell's raked weight per token, scaled so that the expected tokens meet the budget, at most 1 (what is above 1 goes to the
other cells). A document is taken if a hash of its id, as a fraction, is below its probability. Raking goes on until every
marginal is within TOLERANCE of its target. `mixture_report` says, level by level, what share was wanted, is expected and was
drawn: a level whose cells are taken whole has no more tokens to give and stays below its target.

Any number of levels is exact. The driver rakes up to MOST_CELLS cells, counted first, and the join back broadcasts them; more
are raked as a table, staged each round, and joined back in a shuffle. Documents are never gathered.

Defined results: nulls in a dimension are a level of their own, "(none)"; a level that is called so itself gets brackets more;
targets that the cells that have tokens can't meet together end after MOST_ROUNDS rounds, the last dimension met; null or empty text has 0 tokens and its cell's probability;
rows that share an id are taken or left together; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BLANKS, SALTED, bounded, or_empty, stage
from .packing import n_words

DIMS = ("source", "lang", "topic")
MOST_CELLS = 100_000
#: Target share of a level: its tokens to this power, normalized.
FLATTEN = {"source": 0.5, "lang": 0.7, "topic": 0.7}
BUDGET = 0.6
#: Largest gap between a raked marginal and its target, as a share of all tokens.
TOLERANCE = 1e-9
#: Rounds after which raking ends where targets can't be met together.
MOST_ROUNDS = 500
NONE = "(none)"
SEED = "mix"


def level_of(column: Column) -> Column:
    """The level: null is NONE, and what looks like NONE in brackets gets one pair more, so that no value is taken for null."""
    c = column.cast("string")
    return F.when(c.isNull(), NONE).when(c.rlike(r"^\(+none\)+$"), F.concat(F.lit("("), c, F.lit(")"))).otherwise(c)


def topic(docs: DataFrame, text_col: str = "text") -> Column:
    """The form of a text, which stands for its topic where documents carry none."""
    t = or_empty(docs[text_col])
    symbols = F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", ""))
    blank = F.btrim(t, F.lit(BLANKS)) == ""
    return F.when(blank, "empty").when(symbols * 20 > F.length(t), "symbols").when(F.length(t) < 500, "brief").when(F.length(t) < 5000, "page").otherwise("long")


def rake(cells: pd.DataFrame, targets: dict[str, dict[str, float]], tolerance: float, rounds: int) -> np.ndarray:
    """Weights of the cells (DIMS, tokens) whose marginals are the targets, normalized over the levels that have tokens."""
    w = cells["tokens"].to_numpy(float)
    steps = []
    for dim in DIMS:
        code, levels = pd.factorize(cells[dim])
        there = np.bincount(code, w, len(levels)) > 0
        want = np.array([targets[dim].get(x, 0.0) for x in levels]) * there
        steps.append((code, want / want.sum() if want.sum() else want, len(levels)))
    for _ in range(rounds):
        for code, want, n in steps:
            now = np.bincount(code, w, n)
            w = w * np.divide(want, now, out=np.zeros(n), where=now > 0)[code]
        if max(np.abs(np.bincount(code, w, n) - want).max(initial=0.0) for code, want, n in steps) <= tolerance:
            break
    return w


def probabilities(tokens: np.ndarray, weights: np.ndarray, budget: float) -> np.ndarray:
    """min(1, s * weight / token) with s such that the expected tokens are the budget."""
    rate = np.divide(weights, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    order = np.argsort(-rate, kind="stable")
    t, r = tokens[order], rate[order]
    rest = np.cumsum((t * r)[::-1])[::-1]
    before = np.cumsum(t) - t
    s = np.divide(budget - before, rest, out=np.zeros(len(t)), where=rest > 0)  # if those before are taken whole
    ok = np.flatnonzero((s * r <= 1) & (rest > 0))
    return np.minimum(1.0, (s[ok[0]] if len(ok) else np.inf) * rate) if rate.any() else np.zeros(len(tokens))


def rake_table(cells: DataFrame, targets: dict[str, dict[str, float]] | None, tolerance: float, rounds: int) -> DataFrame:
    """rake for cells of any number: DIMS, tokens, w. targets None: the flattened shares."""
    spark = cells.sparkSession
    want = {}
    for d in DIMS:
        share = cells.groupBy(d).agg(F.sum("tokens").alias("t"))
        if targets is None:
            share = share.withColumn("want", F.pow(F.col("t").cast("double"), F.lit(FLATTEN[d])))
        else:
            share = share.join(spark.createDataFrame([(k, float(v)) for k, v in targets[d].items()], f"{d} string, want double"), d, "left")
        share = stage(share.select(d, F.when(F.col("t") > 0, F.coalesce("want", F.lit(0.0))).otherwise(0.0).alias("want")), "shares")
        total = share.agg(F.sum("want")).first()[0]
        want[d] = bounded(share.withColumn("want", F.col("want") / total) if total else share)
    w = cells.withColumn("w", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for d in DIMS:
            now = w.groupBy(d).agg(F.sum("w").alias("now")).join(want[d], d)
            factor = stage(now.select(d, F.when(F.col("now") > 0, F.col("want") / F.col("now")).otherwise(0.0).alias("factor")), "factors")
            w = w.join(bounded(factor), d).select(*DIMS, "tokens", (F.col("w") * F.col("factor")).alias("w"))
        w = stage(w, "raked")
        gaps = [w.groupBy(d).agg(F.sum("w").alias("now")).join(want[d], d).agg(F.max(F.abs(F.col("now") - F.col("want")))).first()[0] for d in DIMS]
        if max(g or 0.0 for g in gaps) <= tolerance:
            break
    return w


def table_probabilities(raked: DataFrame, share: float) -> DataFrame:
    """probabilities for cells of any number, with share of all tokens as budget: DIMS, probability."""
    rated = raked.select(*DIMS, "tokens", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0).alias("rate"))
    budget = share * (rated.agg(F.sum("tokens")).first()[0] or 0)
    s, n = 0.0, -1
    while True:  # s grows with the cells that are taken whole, until there are no more of them
        whole = F.col("rate") * s > 1
        r = rated.agg(F.count_if(whole).alias("n"), F.sum(F.when(whole, F.col("tokens"))).alias("before"), F.sum(F.when(~whole, F.col("tokens") * F.col("rate"))).alias("rest")).first()
        if r["n"] == n:
            break
        n, s = r["n"], (budget - (r["before"] or 0)) / r["rest"] if r["rest"] else float("inf")
    return rated.select(*DIMS, F.when(F.col("rate") > 0, F.least(F.lit(1.0), F.col("rate") * s)).otherwise(0.0).alias("probability"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", tokens: Column, dims: dict[str, Column], targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, keep_rows: bool = True) -> DataFrame:
    """row (all columns, or the id only), source, lang, topic (levels), tokens, probability and taken. targets: share by level."""
    level = {d: level_of(dims[d]).alias(d) for d in DIMS}
    row = F.struct("*") if keep_rows else F.struct(docs[id_col].alias(id_col))
    rows = stage(docs.select(row.alias("row"), *level.values(), tokens.cast("long").alias("tokens")), "mixing")
    cells = stage(rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")), "cells")
    key = F.col(f"row.`{id_col}`").cast("string")
    if cells.limit(MOST_CELLS + 1).count() <= MOST_CELLS:
        cells = cells.toPandas().sort_values(list(DIMS), ignore_index=True)
        if targets is None:
            sums = {d: cells.groupby(d)["tokens"].sum() for d in DIMS}
            targets = {d: (s.astype(float) ** FLATTEN[d]).where(s > 0, 0.0).to_dict() for d, s in sums.items()}
        t = cells["tokens"].to_numpy(float)
        cells["probability"] = probabilities(t, rake(cells, targets, TOLERANCE, MOST_ROUNDS), budget * t.sum())
        known = rows.sparkSession.createDataFrame(cells[[*DIMS, "probability"]].astype({"probability": float}), ", ".join(f"{d} string" for d in DIMS) + ", probability double")
        rows = rows.join(F.broadcast(known), list(DIMS))
    else:
        known = table_probabilities(rake_table(cells, targets, TOLERANCE, MOST_ROUNDS), budget)
        known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTED - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTED)).cast("int")).join(known, [*DIMS, "salt"])
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(key, F.lit("")))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return rows.select("row", *DIMS, "tokens", F.round("probability", 9).alias("probability"), (draw < F.round("probability", 9)).alias("taken"))


def mixture_report(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """One row per dimension and level of mixed rows: dim, level, tokens, target, expected and drawn (shares), whole (share of the level's tokens that are sure to be taken)."""
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("level")) for d in DIMS])).alias("x"), "tokens", "probability", "taken")
    sums = each.groupBy("x.dim", "x.level").agg(
        F.sum("tokens").alias("tokens"),
        F.sum(F.col("tokens") * F.col("probability")).alias("expected"),
        F.sum(F.when(F.col("taken"), F.col("tokens")).otherwise(0)).alias("drawn"),
        F.sum(F.when(F.col("probability") >= 1, F.col("tokens")).otherwise(0)).alias("whole"),
    )
    if targets is None:
        power = F.create_map(*[F.lit(x) for pair in FLATTEN.items() for x in pair])[F.col("dim")]
        sums = sums.withColumn("target", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), power)).otherwise(0.0))
    else:
        given = rows.sparkSession.createDataFrame([(d, k, float(v)) for d in DIMS for k, v in targets[d].items()], "dim string, level string, target double")
        sums = sums.join(given, ["dim", "level"], "left").withColumn("target", F.when(F.col("tokens") > 0, F.coalesce("target", F.lit(0.0))).otherwise(0.0))
    sums = stage(sums, "mixture")
    totals = sums.groupBy("dim").agg(*[F.sum(c).alias(f"all_{c}") for c in ("target", "expected", "drawn")])  # a row a dimension
    share = [F.coalesce(F.try_divide(c, f"all_{c}"), F.lit(0.0)).alias(c) for c in ("target", "expected", "drawn")]
    return sums.join(F.broadcast(totals), "dim").select("dim", "level", "tokens", *share, F.coalesce(F.try_divide("whole", "tokens"), F.lit(0.0)).alias("whole"))


def _of_documents(docs: DataFrame, **options) -> DataFrame:
    return mixed(docs, tokens=n_words(docs), dims={"source": docs["source"], "lang": docs["lang"], "topic": topic(docs)}, **options)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, levels, tokens, probability, taken."""
    return _of_documents(docs, keep_rows=False, **options).select("row.doc_id", *DIMS, "tokens", "probability", "taken")


def sample_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that are taken, with their own columns."""
    return _of_documents(docs, **options).where("taken").select("row.*")


def oracle() -> str:
    """mix_documents as DuckDB SQL over documents (doc_id unique)."""
    step = f"(select * from raked where gap > {TOLERANCE} and k < {MOST_ROUNDS})"
    for d in DIMS:
        step = f"(select * replace (case when sum(w) over (partition by {d}) > 0 then w * want_{d} / sum(w) over (partition by {d}) else 0 end as w) from {step})"
    gap = ", ".join(f"abs(sum(w) over (partition by {d}) - want_{d})" for d in DIMS)
    level = lambda d: f"case when {d} is null then '{NONE}' when regexp_matches({d}, '^\\(+none\\)+$') then '(' || {d} || ')' else {d} end as {d}"
    want = ", ".join(f"(select sum(tokens) from c b where b.{d} = c.{d})::double ^ {FLATTEN[d]} / (select sum(t::double ^ {FLATTEN[d]}) from (select sum(tokens) as t from c group by {d}) where t > 0) as want_{d}" for d in DIMS)
    return rf"""
    with recursive q as (select doc_id, {level("source")}, {level("lang")}, coalesce(text, '') as t,
                      len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint as tokens from documents),
    d as (select doc_id, source, lang, tokens, case when not regexp_matches(t, '[^\x20\x09-\x0D]') then 'empty'
                 when length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) * 20 > length(t) then 'symbols'
                 when length(t) < 500 then 'brief' when length(t) < 5000 then 'page' else 'long' end as topic from q),
    c as (select source, lang, topic, sum(tokens)::bigint as tokens from d group by all),
    raked as (select *, tokens::double as w, {want}, 0 as k, 1e9::double as gap from c
              union all
              select * exclude (k, gap, apart), k + 1, max(apart) over () from (select *, greatest({gap}) as apart from {step})),
    rated as (select *, case when tokens > 0 then w / tokens else 0 end as rate from raked where k = (select max(k) from raked)),
    summed as (select *, sum(tokens) over (order by rate desc, source, lang, topic) - tokens as before,
                      sum(tokens * rate) over (order by rate, source desc, lang desc, topic desc) as rest from rated),
    scaled as (select max({BUDGET} * (select sum(tokens) from c) - before) filter (true) as unused,
                      arg_max(({BUDGET} * (select sum(tokens) from c) - before) / rest, rate) filter (rest > 0 and ({BUDGET} * (select sum(tokens) from c) - before) / rest * rate <= 1) as s from summed),
    known as (select source, lang, topic, round(least(1.0, s * rate), 9) as probability from rated, scaled)
    select doc_id, source, lang, topic, tokens, probability,
           ('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::bigint / (1::bigint << 52)::double < probability as taken
    from d join known using (source, lang, topic)"""
