"""Exact token counts of whole texts and of their prefixes.

The count of a prefix is a sum over whole pieces plus the count of a beginning of one
piece. ``PrefixCounts`` holds the running sum at the end of every piece. Beginnings of short
pieces come from the worker's memo, shared by all texts; those of long ones from
``prefix_table``, one pass of dynamic programming over the piece. So a truncation or budget
question reads tables instead of encoding again. Tokenizers other than the default have
one piece, the whole text, and encode each beginning that is asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import columns_of, released, whole_text
from tilewright.llm.tokens import DEFAULT_TOKENIZER, Ids, ids_of

PIECE = re.compile(r"[^\x20\x09-\x0D]+")

#: Longer pieces, in code points, have a table; the memo holds the beginnings of shorter ones.
SHORT = 64


class PrefixCounts:
    """Token count of every prefix of one text, by code points."""

    def __init__(self, text: str, ids: Ids):
        self.text, self.ids = text, ids
        if ids.by_piece:
            spans = [m.span() for m in PIECE.finditer(text)]
            _, lengths = ids.piece_lengths(text.encode())
        else:
            spans, lengths = [(0, len(text))] * bool(text), np.array([len(ids.encode(text)) // 4] * bool(text), np.int64)
        self.starts = np.array([a for a, _ in spans], np.int64)
        self.ends = np.array([b for _, b in spans], np.int64)
        self.totals = np.cumsum(lengths)
        self.tables: dict[int, np.ndarray] = {}  # of long pieces that were asked about

    def _long(self, piece: int) -> bool:
        return self.ids.by_piece and self.ends[piece] - self.starts[piece] > SHORT

    def _table(self, piece: int) -> np.ndarray:
        if piece not in self.tables:
            counts = self.ids.table().counts(self.text[self.starts[piece] : self.ends[piece]])
            self.tables[piece] = np.fromiter(counts, np.int64, int(self.ends[piece] - self.starts[piece]))
        return self.tables[piece]

    def _begun(self, piece: int, length: int) -> int:
        if self._long(piece):
            return int(self._table(piece)[length - 1])
        part = self.text[self.starts[piece] : self.starts[piece] + length]
        return len(self.ids.cores[part.encode()] if self.ids.by_piece else self.ids.encode(part)) // 4

    def count(self, chars: int) -> int:
        """Tokens of the first ``chars`` code points."""
        whole = int(np.searchsorted(self.ends, chars, side="right"))
        base = int(self.totals[whole - 1]) if whole else 0
        if whole < len(self.starts) and chars > self.starts[whole]:
            base += self._begun(whole, chars - int(self.starts[whole]))
        return base

    def total(self) -> int:
        return int(self.totals[-1]) if len(self.totals) else 0

    def all(self) -> np.ndarray:
        """Counts of all prefixes, from none to all code points."""
        out = np.zeros(len(self.text) + 1, np.int64)
        base = 0
        for k, (a, b) in enumerate(zip(self.starts, self.ends)):
            out[a + 1 : b] = [base + self._begun(k, j) for j in range(1, b - a)]
            base = int(self.totals[k])
            out[b : (self.starts[k + 1] + 1 if k + 1 < len(self.starts) else None)] = base
        return out

    def fitting(self, budget: int) -> int:
        """Code points of the longest prefix with at most ``budget`` tokens."""
        whole = int(np.searchsorted(self.totals, budget, side="right"))
        if whole == len(self.starts):
            return len(self.text)
        base = int(self.totals[whole - 1]) if whole else 0
        start = int(self.starts[whole])
        if self._long(whole):
            return start + self.ids.table().fitting(self.text[start : self.ends[whole]], budget - base)
        for length in range(int(self.ends[whole]) - start - 1, 0, -1):
            if base + self._begun(whole, length) <= budget:
                return start + length
        return start


def token_counts(
    docs: DataFrame, budget: int = 2048, tokenizer: str = DEFAULT_TOKENIZER, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit, fit_chars.

    ``fit_chars`` is the number of code points of the longest prefix within the budget.
    Null text counts as empty (no bytes, no tokens, not over); a null id is passed on;
    other columns are ignored; repeated rows are counted each for itself. One pass
    without a shuffle.
    """
    columns_of(docs, id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer)
        for batch in batches:
            n_bytes, n_tokens, fit = [], [], []
            for value in batch.column(1):
                data = value.as_buffer().to_pybytes()
                if ids.by_piece:
                    _, lengths = ids.piece_lengths(data)
                    total = int(np.cumsum(lengths)[-1]) if len(lengths) else 0
                else:
                    total = len(ids.of(data)) // 4
                n_bytes.append(len(data))
                n_tokens.append(total)
                text = data.decode()
                fit.append(len(text) if total <= budget else PrefixCounts(text, ids).fitting(budget))
            over = [n > budget for n in n_tokens]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()),
                 pa.array(over, pa.bool_()), pa.array(fit, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(released(count), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_counts(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and ``counts``, the tokens of every prefix by code points.

    ``counts[i]`` (from 0) is the number of tokens of the first i code points. Null text
    counts as empty and gives [0].
    """
    columns_of(docs, id_col, text_col)

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer)
        for batch in batches:
            for row in range(batch.num_rows):  # a row at a time: counts are longer than texts
                counts = PrefixCounts(batch.column(1)[row].as_buffer().to_pybytes().decode(), ids).all()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, 1), pa.array([counts], pa.list_(pa.int64()))], names=["doc_id", "counts"]
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(released(table), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, counts array<long>")
