"""Token counts: batch encoding in Arrow functions that return lengths only.

Rows are dealt to the encoder in batches balanced by bytes. A text longer than `longest` bytes is cut at safe
boundaries: a single space between two characters that are no space. No piece of the vocabulary holds a space mark
after another character, and merges are local, so tokens never cross such a boundary; the cut drops the space, which
the encoder puts before each part again.

Defined results: null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import by_bytes

MODEL = "piece_bpe_32k.model"
#: A space between two characters that are neither a space nor the space mark.
SAFE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")


def split_safely(text: str, longest: int) -> list[str]:
    """Parts of about `longest` characters whose token counts add up to the text's; longer only without boundary."""
    parts, start = [], 0
    while len(text) - start > longest:
        cut = SAFE.search(text, start + longest)
        if cut is None:
            break
        parts.append(text[start : cut.start()])
        start = cut.end()
    return [*parts, text[start:]]


def safe_to_split(model) -> bool:
    """Whether no piece of the model holds a space mark after another character and texts aren't normalized."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    plain = all("▁" not in p.lstrip("▁") for p in pieces)
    return plain and model.normalize(" a  b\nａ ") == "▁▁a▁▁b\nａ▁"


def token_counts(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, batch_bytes: int = 1 << 20, longest: int = 16384) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        cut = longest if safe_to_split(model) else 1 << 62
        for batch in by_bytes(batches, "text", batch_bytes):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            parts, owner = [], []
            for i, text in enumerate(texts):
                pieces = split_safely(text, cut)
                parts += pieces
                owner += [i] * len(pieces)
            n = [0] * len(texts)
            for i, ids in zip(owner, model.encode(parts, num_threads=1), strict=True):
                n[i] += len(ids)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n])})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
