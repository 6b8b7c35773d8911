"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of hashed 1- to 3-grams are counted over all learning documents. The classifier is fitted in one task on a
bounded sample of labelled documents: of each language's distinct texts the first PER_LABEL by hash, fewer where that would be
more than MOST_SAMPLE in all. It is trained by follow-the-regularised-leader with elastic-net penalties, then a temperature is
fitted on the part of the sample that training left out. The fitted model, whose size depends on BUCKETS and the number of
languages only, goes to every task; prediction reads whole texts and nothing else. There is no bound on the number of languages.

Defined results: null text or text without a letter is `und` with score 0; without any labelled document all are `und` with score
0; rows with null label or null id teach nothing; repeated rows are predicted alike; ties go to the first label in order; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded, by_bytes, stage

BUCKETS = 1 << 15
#: Bound of the labelled sample, in documents a label.
PER_LABEL = 500
#: Bound of the whole sample, but for one document a label.
MOST_SAMPLE = 50_000
L1, L2, RATE, BETA, EPOCHS = 2e-3, 1e-3, 0.5, 1.0, 4
UNKNOWN = "und"


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's 1- to 3-grams and their counts."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    one = (c + np.uint32(1)) * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + one[1:] if len(c) > 1 else one[:0]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + one[2:] if len(c) > 2 else one[:0]
    h = np.concatenate([one, two, three])
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x27D4EB2F)
    n = np.bincount(h >> np.uint32(32 - 15), minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at]


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text's TF-IDF vector of length 1."""
    at, n = grams(text)
    x = (1 + np.log(n)) * idf[at]
    return at, x / max(np.sqrt((x * x).sum()), 1e-12)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_labels: int) -> tuple[np.ndarray, float]:
    """Weights (BUCKETS, labels) and temperature; every fifth row is left for the temperature."""
    z, n = np.zeros((BUCKETS, n_labels), np.float32), np.zeros((BUCKETS, n_labels), np.float32)
    left = np.arange(len(rows)) % 5 == 4

    def weights(at):
        return np.where(np.abs(z[at]) > L1, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / RATE + L2), 0.0)

    for _ in range(EPOCHS):
        for i in np.flatnonzero(~left):
            at, x = rows[i]
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / RATE
            z[at] += g - step * w
            n[at] += g * g
    w = weights(slice(None))
    scores = np.array([x @ w[at] for at, x in (rows[i] for i in np.flatnonzero(left))]).reshape(-1, n_labels)
    best = (np.inf, 1.0)
    for t in np.exp(np.linspace(np.log(0.02), np.log(10), 80)):
        s = scores / t
        s = s - s.max(1, keepdims=True) if len(s) else s
        loss = float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), labels[left]]).sum()) if len(s) else 0.0
        best = min(best, (loss, float(t))) if len(s) else (0.0, 1.0)
    return w, best[1]


def language_id(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = PER_LABEL) -> DataFrame:
    """One row per document: id, held_out (crc32 of the id as text, mod 5, is 0), lang_pred, score (calibrated probability)."""
    held = F.coalesce(F.crc32(docs[id_col].cast("string")) % 5 == 0, F.lit(True))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[label_col].cast("string").alias("label"), held.alias("held_out"))
    learn = rows.where("not held_out and label is not null and text is not null").select("text", "label")
    counts = {r["label"]: r["count"] for r in learn.groupBy("label").count().collect()}
    names = sorted(counts)
    model = _model(learn, counts, names, per_label) if names else None

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            lang, score = [], []
            for text in batch.column("text").to_pylist():
                if model is None or not text or not any(map(str.isalpha, text)):
                    lang.append(UNKNOWN), score.append(0.0)
                    continue
                idf, w, t = model
                at, x = weighted(text, idf)
                s = (x @ w[at]) / t
                p = np.exp(s - s.max())
                k = int(p.argmax())
                lang.append(names[k]), score.append(float(min(1.0, p[k] / p.sum())))
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.select("id", "text", "held_out").mapInArrow(predict, f"id {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def _model(learn: DataFrame, counts: dict[str, int], names: list[str], per_label: int) -> tuple[np.ndarray, np.ndarray, float]:
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS, np.int64)
        for batch in by_bytes(batches, "text"):
            for text in batch.column("text").to_pylist():
                df[grams(text)[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at.astype(np.int32)), "df": pa.array(df[at])})

    found = learn.select("text").mapInArrow(frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(BUCKETS)
    df[found["bucket"].to_numpy()] = found["df"].to_numpy()
    idf = np.log((1 + sum(counts.values())) / (1 + df)) + 1

    keys = learn.select("label", F.xxhash64("text").alias("h")).distinct()
    first = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    keys = stage(keys.withColumn("nth", first).where(F.col("nth") <= max(1, min(per_label, MOST_SAMPLE // len(names)))).select("label", "h"), "sample")
    sample = learn.withColumn("h", F.xxhash64("text")).join(bounded(keys), ["label", "h"]).groupBy("label", "h").agg(F.min("text").alias("text")).select("label", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            both = [weighted(t, idf) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "at": pa.array([a.astype(np.int32) for a, _ in both], pa.list_(pa.int32())), "x": pa.array([x.astype(np.float32) for _, x in both], pa.list_(pa.float32()))})

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        order = pd.util.hash_array(np.array([f"{len(a)}:{x[:8].sum():.6f}" for a, x in zip(rows["at"], rows["x"], strict=True)], object)).argsort(kind="stable")
        rows = rows.iloc[order]
        labels = rows["label"].map({x: i for i, x in enumerate(names)}).to_numpy()
        w, t = fit([(np.asarray(a), np.asarray(x, float)) for a, x in zip(rows["at"], rows["x"], strict=True)], labels, len(names))
        at, k = np.nonzero(w)
        return pd.DataFrame({"bucket": np.append(at, -1).astype(np.int32), "label": np.append(k, -1).astype(np.int32), "weight": np.append(w[at, k], t)})

    got = sample.mapInArrow(vectors, "label string, at array<int>, x array<float>").groupBy().applyInPandas(fitted, "bucket int, label int, weight double").toPandas()
    w = np.zeros((BUCKETS, len(names)), np.float32)
    inner = got[got["bucket"] >= 0]
    w[inner["bucket"], inner["label"]] = inner["weight"]
    t = got.loc[got["bucket"] < 0, "weight"]
    return idf, w, float(t.iloc[0]) if len(t) else 1.0
