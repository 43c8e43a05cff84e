"""Token counts of texts, without keeping token ids.

Method: Arrow functions hand texts to the vocabulary's library in batches of bounded bytes, take the
lengths only, and cut long texts at safe boundaries (``pieces``), so memory is bounded by a window, not by
a text.  Equal pieces are encoded once per worker as long as they are remembered.  The operator is one
narrow projection: no shuffle, no driver state, and a lost task is simply run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from trellis.llm.library import encoder
from trellis.llm.memory import held
from trellis.llm.pieces import WINDOW, Pieces, windows
from trellis.llm.schema import extended
from trellis.llm.shipping import ship


def batch_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Lengths of encoded texts by the library of the vocabulary file: .json tokenizers, .model sentencepiece."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    ids = encoder(path)
    return lambda texts: [len(i) for i in ids(texts)]


def _counter(path: str) -> Callable[[str], int]:
    """Counts one text.

    Pieces between spaces are safe for the .json vocabularies.  A .model vocabulary may join pieces
    across spaces, so its texts are encoded whole.
    """
    count = batch_counter(path)
    if path.endswith(".model"):
        return lambda text: count([text])[0] if text else 0
    pieces = Pieces(count)
    return lambda text: sum(map(sum, pieces.values(text)))


def count_tokens(docs: DataFrame, path: str, *, text: str = "text", limit: int = 512, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row of ``docs``.

    Null and empty texts have 0 bytes and 0 tokens.  Repeated rows give repeated results; other columns of
    ``docs``, whatever their names, are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = held(("token counts", path), lambda: _counter(path))
        for batch in batches:
            texts = batch.column(len(keep))
            sizes, tokens = [], []
            for value in texts:
                value = value.as_py() or ""
                sizes.append(len(value.encode()) if len(value) <= WINDOW else sum(len(w.encode()) for w in windows(value)))
                tokens.append(count(value))
            columns = [batch.column(i) for i in range(len(keep))]
            over = [n > limit for n in tokens]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(over, pa.bool_())],
                names=[*keep, "n_bytes", "n_tokens", "over_limit"],
            )

    ship(docs.sparkSession)
    picked = docs.select(*keep, text)
    return picked.mapInArrow(run, extended(picked.schema.fields[: len(keep)], "n_bytes long, n_tokens long, over_limit boolean"))
