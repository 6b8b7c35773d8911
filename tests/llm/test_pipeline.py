"""The pipeline against plain loops over a small table, and its stages on nulls, repeats, long texts and empty tables."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from speclake.llm import mixing, packing, quality, secret_scan

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, key_a long, host string, taken boolean"
BLANK = "[^\x20\x09-\x0d]+"


def words(t):
    return re.findall(BLANK, t or "")


def table_rows():
    r = random.Random(77)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows = []
    for i in range(150):
        n, kind = r.randint(22, 120), i % 15
        text = prose(n)
        if kind == 1:
            text = prose(r.randint(0, 19))
        elif kind == 2:
            text = " ".join(f"#$ {w} %" for w in text.split()) + " ###"
        elif kind == 3:
            text = f"{text} password = hunter2secret {text[:40]}"
        elif kind == 4:
            text = f"{text} Zx8Qp2Lw9Vt4Rk7Nb3Mh6 and {'c0ffee1234' * 3}"
        elif kind == 5 and i > 15:
            text = rows[i - 15][1]
        elif kind == 6 and i > 15:
            text = rows[i - 15][1].rsplit(" ", 1)[0] + " changed"
        elif kind == 7:
            text = (prose(10) + "\n") * 9
        elif kind == 8:
            text = [None, "", " \t\n"][i % 3]
        rows.append((i, text, ["en", "fr", None][i % 3], None if i % 29 == 0 else f"h{i % 7}", len(text or "")))
    rows += [rows[0], rows[0], (None, prose(40), "en", "h1", 5), (None, rows[9][1], None, None, 5), (900, prose(9000), "fr", "h2", 5)]
    return [(*x, "r", "i", 1, "h", True) for x in rows]


def judged(rows):
    """Rows that the base rules and the verdicts on hosts keep."""
    fails = []
    for x in rows:
        w = words(x[1])
        windows = {}
        for k in range(len(w) - 7):
            windows.setdefault(tuple(w[k : k + 8]), []).append(k)
        again = {p for at in windows.values() if len(at) > 1 for k in at for p in range(k, k + 8)}
        fails.append({"short": len(w) < 20, "repeats": 100 * len(again) > 30 * len(w), "symbols": len(re.findall(r"[#*$%&|<>]", x[1] or "")) > len(w)})
    hosts = {}
    for x, f in zip(rows, fails, strict=True):
        if x[3] is not None:
            hosts.setdefault(x[3], []).append(f)
    rates, watched = {h: {} for h in hosts}, {h: [] for h in hosts}
    for rule in quality.RULES:
        n = {h: len(f) for h, f in hosts.items()}
        bad = {h: sum(x[rule] for x in f) for h, f in hosts.items()}
        m = sum(bad.values()) / sum(n.values())
        share = [bad[h] / n[h] for h in hosts]
        spread = np.var(share) - m * (1 - m) * np.mean([1 / n[h] for h in hosts])
        weight = min(max(m * (1 - m) / spread - 1, quality.LEAST_WEIGHT), quality.MOST_WEIGHT) if spread > 0 else quality.MOST_WEIGHT
        for h in hosts:
            rates[h][rule] = p = (bad[h] + weight * m) / (n[h] + weight)
            if rule == "symbols" and p > m and (p - m) ** 2 > quality.SURE**2 * p * (1 - p) / (n[h] + weight + 1):
                watched[h].append(rule)
    out = []
    for x, f in zip(rows, fails, strict=True):
        rate = rates.get(x[3])
        rejected = rate is not None and (max(rate.values()) > quality.MAX_RATE or any(f[r] for r in watched[x[3]]))
        if not (f["short"] or f["repeats"] or rejected):
            out.append(x)
    return out


def deduplicated(rows):
    sets = {}
    for x in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), x[1] or ""))
        if x[0] is not None and w:
            sets[x[0]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((label[a], label[b]))
                label = {i: lo if v == hi else v for i, v in label.items()}
    return [x for x in rows if x[0] is None or label.get(x[0], x[0]) == x[0]]


def suspicious(s):
    allowed = lambda t: any(re.search(p, t) for p in secret_scan.ALLOWED)

    def random_looking(t):
        if len(t) < secret_scan.WINDOW or allowed(t):
            return False
        least = next(bits for p, bits in secret_scan.CLASSES.values() if re.search(p, t))
        best = 0.0
        for k in range(len(t) - secret_scan.WINDOW + 1):
            part = t[k : k + secret_scan.WINDOW]
            best = max(best, -sum(part.count(c) / len(part) * math.log2(part.count(c) / len(part)) for c in set(part)))
        return best >= least

    return not allowed(s) and any(map(random_looking, re.split("[/_-]", s) if any(re.search(whole, s) and re.search(there, s) and not re.search(never, s) for whole, there, never in secret_scan.PARTED) else [s]))


def redacted(x):
    t, spans = x[1], []
    if t is None:
        return x
    for kind, p in secret_scan.KINDS.items():
        spans += [m.span() for m in re.finditer(p, t) if len(m[2] if kind == "assign" else m[0]) >= secret_scan.LEAST[kind]]
    base = list(spans)
    spans += [m.span() for m in re.finditer(secret_scan.CANDIDATE, t) if not any(a < m.end() and m.start() < b for a, b in base) and suspicious(m[0])]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += t[at:a] + secret_scan.REDACTED
        at = max(at, b)
    clean = out + t[at:]
    return (x[0], clean, *x[2:4], len(clean) if spans else x[4], *x[5:])


def mixed(rows):
    def topic(t):
        if not words(t):
            return "empty"
        symbols = len(re.findall(r"[#*$%&|<>]", t))
        return "symbols" if symbols * 20 > len(t) else "brief" if len(t) < 500 else "page" if len(t) < 5000 else "long"

    cell = [(x[3] or mixing.NONE, x[2] or mixing.NONE, topic(x[1])) for x in rows]
    tokens = [len(words(x[1])) for x in rows]
    sums = {}
    for c, n in zip(cell, tokens, strict=True):
        sums[c] = sums.get(c, 0) + n
    weight = {c: float(n) for c, n in sums.items()}
    want = []
    for k, dim in enumerate(mixing.DIMS):
        level = {}
        for c, n in sums.items():
            level[c[k]] = level.get(c[k], 0) + n
        flat = {v: n ** mixing.FLATTEN[dim] if n else 0.0 for v, n in level.items()}
        want.append({v: f / sum(flat.values()) for v, f in flat.items()})
    marginal = lambda k: {v: math.fsum(w for c, w in weight.items() if c[k] == v) for v in want[k]}
    for _ in range(mixing.MOST_ROUNDS):
        for k in range(3):
            now = marginal(k)
            weight = {c: w * want[k][c[k]] / now[c[k]] if now[c[k]] else 0.0 for c, w in weight.items()}
        if all(abs(x - want[k][v]) <= mixing.TOLERANCE for k in range(3) for v, x in marginal(k).items()):
            break
    rate = {c: weight[c] / n if n else 0.0 for c, n in sums.items()}
    whole, s, grown = set(), 0.0, True
    while grown:
        s = (mixing.BUDGET * sum(sums.values()) - sum(sums[c] for c in whole)) / sum(sums[c] * rate[c] for c in sums if c not in whole)
        more = {c for c in sums if rate[c] * s > 1}
        grown, whole = more != whole, more
    p = {c: round(min(1.0, s * rate[c]), 9) for c in sums}
    draw = lambda i: int(hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
    return [x for x, c in zip(rows, cell, strict=True) if draw(x[0]) < p[c]]


def packed(rows):
    todo, out, room, has = [], [], [], []
    for x in rows:
        n = len(words(x[1]))
        if not n:
            out.append((x[0], 0, 0, 0, None))
        for k in range(0, n, packing.CAPACITY):
            todo.append((min(packing.CAPACITY, n - k), x[0], k // packing.CAPACITY, k, x[1], x[3]))
    for size, i, piece, start, text, source in sorted(todo, key=lambda p: (-p[0], p[1] is not None, p[1] or 0, p[2])):
        own = {("text", text), ("source", source)} - {("source", None)}
        fits = [(room[b], b) for b in range(len(room)) if room[b] >= size and not own & has[b]]
        b = min(fits)[1] if fits else len(room)
        if b == len(room):
            room.append(packing.CAPACITY), has.append(set())
        room[b] -= size
        has[b] |= own
        out.append((i, piece, start, size, b))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(table_rows(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/none/documents.parquet")
    return str(path)


def test_stages_against_loops(spark, folder):
    key = lambda rows: sorted(map(str, rows))
    rows, docs = table_rows(), spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:-1], (judged, deduplicated, lambda x: list(map(redacted, x)), mixed), strict=True):
        rows, docs = brute(rows), stage(spark, docs, folder)
        assert docs.columns == spark.createDataFrame([], SCHEMA).columns
        docs = spark.createDataFrame(docs.collect(), SCHEMA)
        assert key(map(tuple, docs.collect())) == key(rows), name
    assert 20 < len(rows) < 100
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["bin"]) for r in corpus_pipeline.run(spark, folder).collect()]
    assert key(got) == key(packed(rows))


def test_stages_on_nothing(spark, folder):
    none = spark.read.parquet(f"{folder}/none/documents.parquet")
    assert all(stage(spark, none, folder).count() == 0 for _, stage in corpus_pipeline.STAGES)
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
    nulls = spark.createDataFrame([(None,) * 10] * 3, SCHEMA)
    assert [stage(spark, nulls, folder).count() for _, stage in corpus_pipeline.STAGES] == [0, 3, 3, 0, 3]
