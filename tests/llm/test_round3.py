"""Merkle manifest, window packing and tokenizer alignment against loops over the rows; nulls, empty and long texts, repeats, clashing names."""

import hashlib
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from speclake.llm import html_extract, merkle, queries, token_align, tokens, windows

#: Extra columns whose names clash with those of the operators.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, pos long, n long, id string, leaf string, unit long, piece long, number long, ids string, pairs string, links string, pair long"
HARD = [
    None, "", " ", "a", "Ab Cd", "é文 <s> x", "é文 <s>▁x", "🙂 a\n\nb  c", "<0x41> q", "a\x00b", "ﬁ １ ² ½ Ⅷ", "क्ष ☃☃ x", "<|endoftext|> y <|startoftext|>z", "x" * 5000,
    "a b c d é é é", "  a  b \x1cc\x85d e", "😀😀 café 'll it's don't a.b \n z \t q", "İa ıb ẞ! Å, ǅ: 각, é. ʼn ẗ x̌ Σ.", "word " * 6000, "password = " + "Qx9" * 40,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "hot" if i % 3 else [None, "", "-", "Z", "é", "s1"][i // 3 % 6], len(t or "")) for i, t in enumerate(HARD * 3)]
    rows += [(7, "Ab Cd", None, "hot", None)] * 3 + [(None, "Null Id", "en", "hot", 7), (None, None, None, None, None), (2**60 + 1, "Large Id", "en", "hot", 8), (2**60 + 3, "Large Id", "en", "hot", 8)]
    rows += [(1000 + i, f"Row {i}", "en", "hot", i) for i in range(300)]
    return spark.createDataFrame([(*r, *[None] * 12) for r in rows], SCHEMA).repartition(5)


def h(*values):
    return hashlib.sha256("".join(values).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def manifest_by_loops(rows):
    def lower(r):
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        return r["text"].translate({c: c + 32 for c in range(65, 91)}) if hit and r["text"] is not None else r["text"]

    leaf = lambda r, text: h(*(field(r[c]) if c != "text" else field(text) for c in merkle.FIELDS))

    def tree(nodes):
        """The top, and each node's steps: place and the run's others."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
            for p, i in zip(paths, at, strict=True):
                run = runs[i // 16]
                p.append((i % 16, run[: i % 16] + run[i % 16 + 1 :]))
            nodes, at = [h(*run) for run in runs], [i // 16 for i in at]
        return nodes[0], paths

    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), leaf(r, lower(r)), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in by[s]]) for s in sources if not by[s].sort(key=lambda x: x[:4])}
    root, above = tree([trees[s][0] for s in sources])
    out = []
    for s, far in zip(sources, above, strict=True):
        for (_, _, own, found, r), near in zip(by[s], trees[s][1], strict=True):
            for at, others in near + far:
                found = h(*others[:at], found, *others[at:])
            out.append((r["doc_id"], own, trees[s][0], root, h(*(x for _, others in near + far for x in others)), found, found == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [1, 2, 3])
def test_manifest(docs, height):
    """Superblocks of one level make several rounds up and down."""
    got = merkle.tampered_manifest(docs, height=height)
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = sorted((tuple(r) for r in got.select(cols).collect()), key=str)
    assert rows == manifest_by_loops(docs.collect())
    assert {r[6] for r in rows} == {True, False}


def test_manifest_proofs(docs, spark):
    got = merkle.manifest(docs, proofs=True, height=1).collect()
    assert all(r["verified"] and merkle.folded(r["leaf"], [(p["at"], p["nodes"]) for p in r["proof"]]) == r["root"] for r in got) and len(got) == docs.count()
    assert merkle.manifest(docs.limit(0)).count() == 0
    one = merkle.manifest(docs.where("doc_id = 1000")).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == h("")


def check_windows(pieces, docs, slack):
    """Each id in one piece, sequences gapless and full up to the slack."""
    model = tokenizers.Tokenizer.from_file(public_tokenizers.path(windows.MODEL))
    want = Counter((r["doc_id"], tuple(model.encode(r["text"] or "", add_special_tokens=False).ids + [1])) for r in docs.select("doc_id", "text").collect())
    by, fill = {}, {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] > 0 and p["offset"] >= 0
        by.setdefault(p["doc_id"], []).append((p["start"], ids, p["doc_tokens"]))
        fill.setdefault(p["sequence_id"], []).append((p["offset"], len(ids)))
    for spans in fill.values():
        end = 0
        for offset, n in sorted(spans):
            assert offset == end
            end += n
        assert end <= 2048 and (end & (end - 1) == 0 or 2048 - end <= slack)
    for key, parts in by.items():
        mine = [(ids, n) for (k, ids), n in want.items() if k == key]
        assert sum(len(ids) * n for ids, n in mine) == sum(len(x[1]) for x in parts)
        if len(mine) == 1 and mine[0][1] == 1:
            assert [i for _, ids, _ in sorted(parts) for i in ids] == list(mine[0][0]) and {x[2] for x in parts} == {len(mine[0][0])}
    assert set(by) == {k for k, _ in want}


def test_windows(docs):
    path = public_tokenizers.path(windows.MODEL)
    for rows in (100, 4096):
        check_windows(windows.window_pieces(docs, path, shard_rows=rows).collect(), docs, windows.SLACK)
    assert windows.packed_windows(docs.limit(0), path).count() == 0
    row = windows.packed_windows(docs.where("doc_id = 0 and text is null"), path).first()
    assert (row["length"], row["doc_tokens"], row["ids_crc32"]) == (1, 1, zlib.crc32(b"\1\0\0\0"))


def test_words_encoded_together():
    """Ids by run, against the library on whole texts: words together, a letter that lower-cases to two, few runs remembered."""
    path = public_tokenizers.path(windows.MODEL)
    model, mine = tokenizers.Tokenizer.from_file(path), windows.Remembered(path)
    for t in [x for x in HARD if x] + ["plain words, İ here. and plain again! " * 3]:
        for part in windows.stretches(t.encode(), 50):
            mine.learn(part.split())
        ids = np.concatenate([mine(part.split()) for part in windows.stretches(t.encode(), 50)])
        assert ids.tolist() == model.encode(t, add_special_tokens=False).ids, t
        mine.forget()


@pytest.mark.parametrize("sizes", [np.random.default_rng(0).integers(1, 2048, 3000), np.full(1000, 1100), np.random.default_rng(1).integers(1, 40, 5000), np.array([2047]), np.zeros(0, int)])
def test_best_fit_decreasing(sizes):
    """The window of each piece is that of a plain search for the tightest room."""
    rooms, want = [], {}
    for i in np.argsort(-sizes, kind="stable"):
        fit = min((r for r in rooms if r[0] >= sizes[i]), key=lambda r: r[0], default=None)
        if fit is None:
            fit = [2048]
            rooms.append(fit)
        want[i] = (fit[0], sizes[i])
        fit[0] -= sizes[i]
    got = windows.best_fit_decreasing(sizes, 2048)
    assert len(set(got.tolist())) == len(rooms) and sorted(np.bincount(got, sizes).tolist() if len(sizes) else []) == sorted(float(2048 - r[0]) for r in rooms)


def alignment_by_loops(rows):
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path(token_align.MODEL_A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_align.MODEL_B))
    byte = token_align.byte_level()
    bytes_a = lambda i: bytes(byte[c] for c in a.id_to_token(i))
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out, count = [], Counter()
    for r in rows:
        text = r["text"]
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        parts = [[bytes_a(i) for i in ids[0]], [bytes_b(i) for i in ids[1]]]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            out.append((r["doc_id"], None))
            continue
        spans = []
        for p in parts:
            ends = np.cumsum([len(x) for x in p]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends, strict=True)))
        cuts = sorted({y for _, y in spans[0]} & {y for _, y in spans[1]})
        side = lambda k, lo, hi: ",".join(str(i) for i, (x, y) in zip(ids[k], spans[k], strict=True) if lo <= x and y <= hi)
        groups = [f"{side(0, lo, hi)}|{side(1, lo, hi)}" for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True)] if len(ids[0]) < 1500 else None
        links, j = Counter(), 0
        for i, (x, y) in zip(ids[0], spans[0], strict=True):
            while spans[1][j][1] <= x:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < y:
                links[i, ids[1][k]] += 1
                k += 1
        count.update(links.keys())
        out.append((r["doc_id"], (len(ids[0]), len(ids[1]), len(cuts), links, groups)))
    best = Counter()
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    rows = []
    for key, x in out:
        if x is None:
            rows.append((key, 0, 0, 0, 0, 0, 0, ""))
        else:
            rows.append((key, *x[:3], sum(x[3].values()), sum(n for p, n in x[3].items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in x[3].items()), h(";".join(x[4])) if x[4] else None))
    return rows


@pytest.mark.parametrize("most", [token_align.MOST_PAIRS, 10])
def test_alignment(docs, most):
    """Broadcast counts and, beyond the bound, the salted join."""
    paths = [public_tokenizers.path(m) for m in (token_align.MODEL_A, token_align.MODEL_B)]
    got = sorted(map(tuple, token_align.token_alignment(docs, *paths, most_pairs=most).collect()), key=lambda r: (str(r[0]), r[7], r))
    want = sorted(alignment_by_loops(docs.collect()), key=lambda r: (str(r[0]), r[7] or "~", r))
    key = lambda r: (str(r[0]), r[1:7])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:7] for r in got] == [r[:7] for r in want] and all(b[7] is None or a[7] == b[7] for a, b in zip(got, want, strict=True))
    assert token_align.token_alignment(docs.limit(0), *paths).count() == 0


def test_places_and_groups():
    """Chunks of one learning, some encoded alone or without tokens, keep their own groups; each is numbered once, in the order met."""
    aligner = token_align.Aligner(*[public_tokenizers.path(m) for m in (token_align.MODEL_A, token_align.MODEL_B)])
    texts = ["plain words here", " edge", "naïve 日本語 words", "two  blanks\n", "👩‍👩‍👧 𐍈𐍈 x", "a\x00b ▁c", "words again, plain"]
    chunks = [c for t in texts for c in token_align.SAFE.split(t)]
    at = aligner.places(chunks).tolist()
    assert at == [list(dict.fromkeys(chunks)).index(c) for c in chunks]
    aligner.learn()
    for c, k in zip(chunks, at, strict=True):
        alone = token_align.Aligner.__new__(token_align.Aligner)
        alone.__dict__ |= aligner.__dict__
        alone.forget()
        alone.places([c])
        alone.learn()
        assert alone.groups == [aligner.groups[k]] and alone.numbers.tolist() == [aligner.numbers[k].tolist()]
        assert alone.pair.tolist() == aligner.pair[aligner.start[k] : aligner.start[k] + aligner.numbers[k, 3]].tolist()
    got = token_align.cut_by_length(np.array([9, 9, 5, 9, 9, 12]), np.array([True, True, False, True, True, False]), np.array([1, 2, 2, 3, 1, 3]))
    assert got.tolist() == [1, 3, 5, 8, 9, 12]  # at the start, in a run, after an end of its own


def test_chunks_of_b_are_safe():
    """The lone spaces that texts are cut at are no inside of a piece, and texts aren't normalized."""
    assert tokens.safe_to_split(sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_align.MODEL_B)))


def test_queries(spark):
    """The registered queries over the smallest tables: columns, and results of the operators."""
    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents")
    rows = queries.op12_window_packing(spark, sf)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    fill = rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    padding = sum(2048 - r["n"] for r in fill if r["n"] & (r["n"] - 1))
    assert padding < 0.005 * sum(r["n"] for r in fill)
    got = {r["doc_id"]: tuple(r) for r in queries.op13_token_alignment(spark, sf).collect()}
    want = alignment_by_loops(docs.collect())
    assert len(got) == len(want) and all(got[w[0]][:7] == w[:7] and (w[7] is None or got[w[0]][7] == w[7]) for w in want)


def test_repeated_parts_of_articles(spark):
    """What every page of a host repeats inside its article: headings, table heads, quotes and captions stay, an unnamed box goes."""
    head = "<h2>Summary</h2><h3 class=x>References</h3><table><tr><th>Year</th><th>Sum</th></tr></table><blockquote class=motto>Measure twice</blockquote><figure><figcaption>A chart</figcaption></figure>"
    page = lambda i: f"<body><nav>Menu</nav><article><h1>Title {i}</h1>{head}<div class=q7><p>Read our app news</p></div><p>Own text number {i} " + f"word{i} " * 30 + "</p></article></body>"
    pages = spark.createDataFrame([(i, f"https://h.example/{i}", page(i)) for i in range(8)], "page_id long, url string, html string")
    texts = {r["page_id"]: r["text"] for r in html_extract.main_text(pages).collect()}
    for i, t in texts.items():
        assert all(x in t for x in (f"Title {i}", "Summary", "References", "Year", "Sum", "Measure twice", "A chart", f"number {i}")) and "Menu" not in t and "app news" not in t, t


def test_names_in_articles():
    text = lambda inner: html_extract.extract(html_extract.parse(f"<article><p>first</p>{inner}<p>last</p></article>"), set())
    for own in ("discussion", "search", "responses", "navigation", "related"):
        assert "kept" in text(f"<section id='{own}'><h2>{own}</h2><p>kept</p></section>") and "kept" in text(f"<p id='{own}'>kept</p>")
    for names in ("class='article-share-bar'", "class='c-comments__list'", "class='post-comments-wrapper'", "id='comments'", "class='related'", "class='discussion'", "id='related' class='box'"):
        assert text(f"<div {names}><p>gone</p></div>") == "first\n\nlast", names
    assert text("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>\\x</annotation></math> holds</p>") == "first\n\nso x=2 holds\n\nlast"
    assert "gone" not in text("<div id='related'><a href=x>gone</a> <a href=y>gone</a></div>")


def test_tags_without_end():
    """Linear time, and the text before is read."""
    for part in ("<a ", "<a b='", "<!--", "</a ", "<", "&", "<![CDATA["):
        for end in ("", ">", "<p>late</p>"):
            begun = time.time()
            html_extract.parse(part * 300_000 + end)
            assert time.time() - begun < 30
    text = lambda h: html_extract.extract(html_extract.parse(h), set())
    assert text("<article><p>one</p><p>two <b") == "one\n\ntwo" and text("<article><p>a < b and c") == "a < b and c" and text("<p>x</p> <!-- never") == "x"
