"""Secret scans, in DataFrame functions only.

Three fixed patterns give the base spans. The method adds spans of kind `entropy`: candidate strings are maximal runs of
key characters; each is put in a character class (hex, alnum, base64), the Shannon entropy of every window of WINDOW
characters is kept up by incremental counts (one character in, one out), and a candidate whose highest window entropy
reaches its class's threshold is a secret unless the allow-list names it or a base span overlaps it. Paths and slugs in lower
case are judged part by part, each as a candidate of its own: the whole of one is a secret if one of its parts is.

Every step is linear in the text and its matches but for a factor of their logarithm: positions are running sums and overlaps
running maxima, both by doubling steps over arrays, and redaction reads the text in chunks. Positions are code points, end
exclusive. Defined results: null or empty text has no spans; repeated rows are scanned each;
an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import let
from ._common import or_empty


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Fixed patterns, in the order in which kinds are listed.
KINDS = {
    "assign": "(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: The same matches where the length can be in the pattern (a run is matched whole or not at all).
SCANNED = KINDS | {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}

CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
WINDOW = 20
#: Character classes, the first that fits counts: pattern and least highest entropy of a window, in bits.
CLASSES = {"hex": (r"^[0-9a-fA-F]+$", 2.9), "alnum": (r"^[0-9A-Za-z]+$", 3.6), "base64": (r"", 3.6)}
#: Candidates without a digit and a letter, and these, are no secrets.
ALLOWED = (
    r"^[A-Za-z+/=_-]*$",
    r"^[0-9+/=_-]*$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|your[_-]|dummy|sample|abcdefgh|12345678",
)
#: Paths and slugs, whose parts are judged: (characters and edges, what must be in, what must not). No pattern repeats a group,
#: which Java's matcher would follow by recursion.
PARTED = ((r"^/?[a-z][a-z0-9]*(/[a-z0-9._/-]*)?$", "/", "//"), (r"^[a-z0-9][a-z0-9_-]*[a-z0-9]$", "[_-]", "[_-][_-]"))
#: Characters of candidates, whose counts lie in words of COUNTS counts of five bits.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
COUNTS, BITS = 12, 5
REDACTED = "[SECRET]"
CHUNK = 1024
NAMED = "array<struct<start:int,end:int,kind:int,s:string>>"


def _found(text: Column, pattern: str) -> Column:
    """Matches and the lengths of what lies before each, null where there is none."""
    hit = F.regexp_like(text, F.lit(pattern))
    return F.when(hit, F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("s"), F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap")))


def running(values: Column, plus) -> Column:
    """The running result of `plus` (sum, greatest) over an array, by steps of doubling length."""
    count = F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)).cast("double"))).cast("int")
    steps = F.transform(F.sequence(F.lit(0), count), lambda k: F.pow(F.lit(2), k).cast("int"))
    one = lambda acc, d: F.transform(acc, lambda v, i: F.when(i >= d, plus(v, F.get(acc, i - d))).otherwise(v))
    return F.aggregate(steps, values, one)


def _spans(found: str, kind: int) -> Column:
    """(start, end, kind, s) of each match, in order: what precedes it is summed up."""
    parts = F.zip_with(f"{found}.gap", f"{found}.s", lambda gap, m: F.struct(gap.alias("gap"), m.alias("s")))
    parts = F.filter(parts, lambda x: x["s"].isNotNull())
    ends = lambda q: running(F.transform(q["parts"], lambda x: x["gap"] + F.length(x["s"])), lambda a, b: a + b)
    both = let(lambda q: F.zip_with(q["parts"], ends(q), lambda x, e: F.struct((e - F.length(x["s"])).alias("start"), e.alias("end"), F.lit(kind).alias("kind"), x["s"].alias("s"))), parts=parts)
    return F.when(F.col(found).isNotNull(), both).otherwise(F.array().cast(NAMED))


def highest_entropy(candidate: Column) -> Column:
    """The highest Shannon entropy, in bits, of WINDOW consecutive characters; counts change by one character in, one out.

    Long candidates are read in chunks that share the characters of a window.
    """
    chunks = F.regexp_extract_all(candidate, F.lit(f".{{1,{CHUNK}}}"), F.lit(0))
    overlapping = let(lambda q: F.transform(q["c"], lambda x, i: F.concat(x, F.coalesce(F.left(F.get(q["c"], i + 1), F.lit(WINDOW - 1)), F.lit("")))), c=chunks)
    return F.array_max(F.transform(overlapping, _chunk_entropy))


def _chunk_entropy(chunk: Column) -> Column:
    gain = F.array(*[F.lit((n + 1) * math.log2(n + 1) - (n * math.log2(n) if n else 0.0)) for n in range(WINDOW + 1)])
    codes = F.transform(F.split(chunk, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    word, bit = lambda c: F.floor(c / COUNTS).cast("int"), lambda c: c % COUNTS * BITS
    count = lambda counts, c: F.call_function("shiftright", F.get(counts, word(c)), bit(c)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    moved = lambda counts, c, by: F.transform(counts, lambda v, k: F.when(k == word(c), v + by * F.call_function("shiftleft", F.lit(1).cast("long"), bit(c))).otherwise(v))

    def best(q: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            full = i >= WINDOW
            kept = lambda x: F.when(full, moved(acc["counts"], x["old"], -1)).otherwise(acc["counts"])
            lost = lambda x: F.when(full, F.get(q["gain"], count(x["kept"], x["old"]))).otherwise(0.0)
            into = lambda x: acc["s"] - lost(x) + F.get(q["gain"], count(x["kept"], x["new"]))
            high = lambda v: F.greatest(acc["best"], F.when(i >= WINDOW - 1, F.log2(F.lit(float(WINDOW))) - v / WINDOW).otherwise(0.0))
            done = lambda x: let(lambda y: F.struct(moved(x["kept"], x["new"], 1).alias("counts"), y["s"].alias("s"), high(y["s"]).alias("best")), s=into(x))
            return let(lambda x: let(done, kept=kept(x), old=x["old"], new=x["new"]), old=F.get(q["codes"], i - WINDOW), new=F.get(q["codes"], i))

        words = -(-len(ALPHABET) // COUNTS)
        zero = F.struct(F.array_repeat(F.lit(0).cast("long"), words).alias("counts"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(q["codes"]) - 1), zero, step, lambda acc: acc["best"])

    return let(best, codes=codes, gain=gain)


def _allowed(s: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | F.regexp_like(s, F.lit(pattern))
    return allowed


def _random(s: Column) -> Column:
    least = F.lit(None).cast("double")
    for pattern, bits in reversed(CLASSES.values()):
        least = F.when(F.regexp_like(s, F.lit(pattern)), bits).otherwise(least)
    return F.when((F.length(s) < WINDOW) | _allowed(s), False).otherwise(highest_entropy(s) >= least)


def _suspicious(s: Column) -> Column:
    parted = [F.regexp_like(s, F.lit(whole)) & F.regexp_like(s, F.lit(there)) & ~F.regexp_like(s, F.lit(never)) for whole, there, never in PARTED]
    parts = F.when(parted[0] | parted[1], F.split(s, "[/_-]")).otherwise(F.array(s))
    return F.when(_allowed(s), False).otherwise(F.exists(parts, _random))


def _free(base: Column, runs: Column) -> Column:
    """The runs that no base span overlaps: base spans by start and runs by end in one order, with the running maximum of base ends."""
    event = lambda key, run, x, reach, s: F.struct(key.alias("key"), F.lit(run).alias("run"), x["start"].alias("start"), x["end"].alias("end"), reach.alias("reach"), s.alias("s"))
    events = F.concat(F.transform(base, lambda x: event(x["start"], 1, x, x["end"], F.lit(None).cast("string"))), F.transform(runs, lambda x: event(x["end"], 0, x, F.lit(-1), x["s"])))
    far = lambda q: F.zip_with(q["events"], running(F.transform(q["events"], lambda x: x["reach"]), F.greatest), lambda x, r: F.when((x["run"] == 0) & (r <= x["start"]), F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(len(KINDS)).alias("kind"), x["s"].alias("s"))))
    return F.filter(let(far, events=F.sort_array(events)), lambda x: x.isNotNull())


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """row: the document; base: its base spans in order; spans: all spans in order. Spans are (start, end, kind's number)."""
    t = docs.select(F.struct("*").alias("row"), or_empty(docs[text_col]).alias("t"))
    text = F.col("t")
    t = t.select("row", *[_found(text, p).alias(k) for k, p in SCANNED.items()], F.when(F.regexp_like(text, F.lit(SCANNED["assign"])), F.regexp_extract_all(text, F.lit(SCANNED["assign"]), F.lit(2))).alias("values"), _found(text, CANDIDATE).alias("entropy"))
    plain = lambda spans: F.transform(spans, lambda x: x.dropFields("s"))
    by = [_spans(k, i) for i, k in enumerate(KINDS)]
    by[0] = F.filter(F.zip_with(by[0], F.coalesce("values", F.array().cast("array<string>")), lambda x, v: F.when(F.length(v) >= LEAST["assign"], x)), lambda x: x.isNotNull())
    t = t.select("row", F.sort_array(plain(F.concat(*by))).alias("base"), _spans("entropy", len(KINDS)).alias("runs"))
    free = F.when((F.size("base") > 0) & (F.size("runs") > 0), let(lambda q: _free(q["base"], q["runs"]), base=F.col("base"), runs=F.col("runs"))).otherwise(F.col("runs"))
    t = t.select("row", "base", plain(F.filter(free, lambda x: _suspicious(x["s"]))).alias("more"))
    return t.select("row", "base", F.when(F.size("more") > 0, F.sort_array(F.concat("base", "more"))).otherwise(F.col("base")).alias("spans"))


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in [*KINDS, "entropy"]])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def secret_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""
    t = scanned(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    n = lambda i, of="base": F.size(F.filter(of, lambda x: x["kind"] == i)).cast("long")
    return t.select(F.col("row.id").alias(id_col), *[n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"), n(len(KINDS), "spans").alias("n_entropy"))


def _without(body: Column, spans: Column) -> Column:
    """The text with each group of overlapping spans replaced by REDACTED. Pieces are cut from chunks of CHUNK characters."""

    def piece(q: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / CHUNK).cast("int")
        near = F.array_join(F.slice(q["chunks"], first + 1, F.floor((b - 1) / CHUNK).cast("int") - first + 1), "")
        return F.when(b > a, F.substring(near, a - first * CHUNK + 1, b - a)).otherwise("")

    def cut(q: Column) -> Column:
        before = lambda i: F.coalesce(F.get(q["reach"], i - 1), F.lit(0))
        heads = F.transform(q["spans"], lambda x, i: F.when((i == 0) | (x["start"] >= before(i)), F.struct(before(i).alias("a"), x["start"].alias("b"))))
        pieces = F.transform(F.filter(heads, lambda h: h.isNotNull()), lambda h: F.concat(piece(q, h["a"], h["b"]), F.lit(REDACTED)))
        last = F.element_at(q["reach"], -1)
        return F.concat(F.array_join(pieces, ""), piece(q, last, q["n"]))

    chunks = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    reach = running(F.transform(spans, lambda x: x["end"]), F.greatest)
    return let(cut, chunks=chunks, spans=spans, reach=reach, n=F.length(body))


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents with every span (overlapping ones together) replaced by REDACTED, and their length put right."""
    t = scanned(docs, text_col)
    clean = F.when(F.size("spans") > 0, _without(F.col(f"row.`{text_col}`"), F.col("spans")))
    t = t.select("row", clean.alias("clean"))
    changed = {text_col: F.coalesce("clean", f"row.`{text_col}`")}
    if length_col in docs.columns:
        changed[length_col] = F.when(F.col("clean").isNotNull(), F.length("clean").cast(docs.schema[length_col].dataType)).otherwise(F.col(f"row.`{length_col}`"))
    return t.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def oracle() -> str:
    """secret_scan as DuckDB SQL over documents (doc_id unique)."""
    quoted = {k: p.replace("'", "''") for k, p in SCANNED.items()} | {"entropy": CANDIDATE}

    def found(i: int, k: str) -> str:
        value = f"regexp_extract_all(t, '{quoted[k]}', 2)" if k == "assign" else "s"
        return f"""
    {k}_m as (select doc_id, string_split_regex(t, '{quoted[k]}') as gaps, s, {value} as v
              from (select doc_id, t, regexp_extract_all(t, '{quoted[k]}') as s from d) where len(s) > 0),
    {k}_i as (select *, unnest(range(1, len(s) + 1)) as i from {k}_m),
    {k} as (select doc_id, {i} as kind, s[i] as str, v[i] as val,
                   list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(s[1:i - 1], lambda x: length(x))), 0) as start from {k}_i)"""

    allowed = lambda s: " or ".join(f"regexp_matches({s}, '{p}')" for p in ALLOWED)
    parted = " or ".join(f"(regexp_matches(str, '{whole}') and regexp_matches(str, '{there}') and not regexp_matches(str, '{never}'))" for whole, there, never in PARTED)
    least = "case " + " ".join(f"when regexp_matches(part, '{p}') then {b}" for p, b in CLASSES.values()) + " end"
    counts = ", ".join(f"count(*) filter (kind = {i}) as n_{k}" for i, k in enumerate(KINDS))
    names = "['" + "', '".join([*KINDS, "entropy"]) + "']"
    joined = f"coalesce(string_agg({names}[kind + 1] || ':' || start::bigint || ':' || stop::bigint, ',' order by start, stop, kind)"
    return f"""
    with d as (select doc_id, coalesce(text, '') as t from documents), {",".join(found(i, k) for i, k in enumerate(quoted))},
    base as (select doc_id, kind, start, start + length(str) as stop from assign where length(val) >= {LEAST["assign"]}
             union all select doc_id, kind, start, start + length(str) from access
             union all select doc_id, kind, start, start + length(str) from hex),
    cand as (select doc_id, kind, str, start, start + length(str) as stop from entropy where not ({allowed('str')})),
    free as (select * from cand c where not exists (select 1 from base b where b.doc_id = c.doc_id and b.start < c.stop and c.start < b.stop)),
    parts as (select distinct doc_id, kind, start, stop, unnest(case when {parted} then string_split_regex(str, '[/_-]') else [str] end) as part from free),
    wins as (select *, unnest(range(1, length(part)::bigint - {WINDOW - 2})) as w from parts where length(part) >= {WINDOW} and not ({allowed('part')})),
    chars as (select *, unnest(string_split(part[w:w + {WINDOW - 1}], '')) as ch from wins),
    freq as (select doc_id, kind, part, start, stop, w, ch, count(*) as n from chars group by all),
    ent as (select doc_id, kind, part, start, stop, w, log2({WINDOW}) - sum(n * log2(n)) / {WINDOW} as h from freq group by all),
    more as (select distinct doc_id, kind, start, stop from (select doc_id, kind, part, start, stop from ent group by all having max(h) >= {least})),
    spans as (select * from base union all select * from more),
    per as (select doc_id, {counts}, {joined} filter (kind < {len(KINDS)}), '') as base, {joined}, '') as spans, count(*) filter (kind = {len(KINDS)}) as n_entropy from spans group by doc_id)
    select doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in KINDS)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_entropy, 0) as n_entropy
    from d left join per using (doc_id)"""
