"""Token counts per document without token ids.

A piece of the model holds the space mark only at its front, so no merge crosses
from a character to the space after it. A text is therefore cut into pre-tokens,
runs of spaces with the word behind them. Each distinct pre-token is encoded once
in a worker and its count joined to the frequencies of each document's pre-tokens.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ledgerflow.llm.common import map_slices

#: Counts that a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 1_000_000
#: Pre-tokens above this length are counted but not remembered.
LONGEST_REMEMBERED = 64

_SPACE_MARK = "▁"
#: A space with nothing behind it: the model gives nothing for an empty text, but one piece here.
_LONE_SPACE = {"": 1}
_PRE_TOKEN = re.compile(" +[^ ]*")


class PieceCounts:
    """Pieces of a pre-token, given without its first space."""

    def __init__(self, model: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (self._model.id_to_piece(i) for i in range(self._model.get_piece_size()))
        if any(_SPACE_MARK in piece.lstrip(_SPACE_MARK) for piece in pieces):
            raise ValueError("the model has pieces with a space inside: words can't be counted apart")
        self._known = dict(_LONE_SPACE)

    def totals(self, texts: list[list[str]]) -> list[int]:
        """The pieces of each text, given as its pre-tokens."""
        known = self._known
        frequencies = [Counter(tokens) for tokens in texts]
        new = [*(set().union(*frequencies) - known.keys())]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            known.update(_LONE_SPACE)
            new = [*(set().union(*frequencies) - known.keys())]
        known.update(zip(new, map(len, self._model.encode(new, num_threads=1)), strict=True))
        sums = [sum([n * known[token] for token, n in own.items()]) for own in frequencies]
        for token in new:
            if len(token) > LONGEST_REMEMBERED:
                del known[token]
        return sums


@functools.cache
def _piece_counts(model: str) -> PieceCounts:
    """One per worker process: what it remembers serves the tasks that follow."""
    return PieceCounts(model)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_tokens and over_limit (more than `limit`).

    Null and empty texts have no bytes and no tokens; a null doc_id stays null;
    repeated rows are counted each; other columns are left out.
    """

    def work():
        counts = _piece_counts(model)

        def cut(text: str) -> list[str]:
            """Pre-tokens without their first space; the model puts one before the text."""
            text = text.replace(_SPACE_MARK, " ")
            if not text:
                return []
            if "  " in text or text[0] == " " or text[-1] == " ":
                return [token[1:] for token in _PRE_TOKEN.findall(f" {text}")]
            return text.split(" ")

        def batch(part: pa.RecordBatch) -> dict:
            text = pc.fill_null(part.column("text"), "")
            total = counts.totals([cut(one) for one in text.to_pylist()])
            return {
                "doc_id": part.column("doc_id"),
                "n_bytes": pc.binary_length(text).cast(pa.int64()),
                "n_tokens": pa.array(total, pa.int64()),
                "over_limit": pa.array([n > limit for n in total], pa.bool_()),
            }

        return batch

    columns = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return map_slices(columns, work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
