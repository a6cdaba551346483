"""Token counts by rank-synchronous merges on ragged arrays of different pre-tokens; no tokenizer is called."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tallyhawk.llm.byte_pairs import vocabulary
from tallyhawk.llm.common import Memory, slices


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 512
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    Counts equal the tokenizers library's for the vocabulary file at ``path`` (no truncation or added
    tokens; special strings inside a text as the library's default has it). One pass, no shuffle. A null or
    empty text has 0 bytes and tokens; a very long text is split and merged like any other; repeated rows are
    counted each; a null id stays null; other columns are not read; an empty table gives an empty table.
    """
    where = path or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, known = vocabulary(where), Memory()
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            counts: list[int] = []
            for a, b in slices(pc.utf8_length(texts).to_pylist(), 1_000_000):
                counts += vocab.token_counts(texts.slice(a, b - a).to_pylist(), known)
            n = pa.array(counts, pa.int64())
            sizes = pc.binary_length(texts).cast(pa.int64())
            over = pa.array([c > limit for c in counts], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, n, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
