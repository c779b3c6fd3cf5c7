"""Operator 1: token counts per section by offset-mapped attribution.

A whole document is encoded once. Each token's byte span follows from its length, and spans are
joined to the sections' intervals by binary search. A token that lies in one section counts
there; a token that crosses a boundary is allocated by ``rule``:

* ``"majority"``: the section that holds most of its bytes, the earlier one on a tie;
* ``"start"``: the section that holds its first byte;
* ``"end"``: the section that holds its last byte.

Every token of a document counts in exactly one section, so the sections' counts add up to the
document's, which encoding section by section does not give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import bpe, textvec

RULES = ("majority", "start", "end")
OUT_ROWS = 100_000


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> np.ndarray:
    """Index of the section of each token; both tile the same bytes from 0."""
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends - 1, "right")
    if rule == "start":
        return first
    if rule == "end":
        return last
    out = first.copy()
    for t in np.flatnonzero(first != last):
        held = np.arange(first[t], last[t] + 1)
        shared = np.minimum(section_ends[held], token_ends[t]) - np.maximum(np.concatenate([[0], section_ends])[held], starts[t])
        out[t] = held[np.argmax(shared)]
    return out


def _counter(path: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(path)
        for batch in batches:
            doc_ids = batch.column(0)
            data, offsets = textvec.string_buffers(batch.column(1))
            for first, last, ids, at in encode.chunked(data, offsets):
                base = offsets[first]
                part = data[base : offsets[last]]
                at_byte = offsets[first : last + 1] - base
                lengths = encode.byte_lengths()[ids]
                # sections are lines with their line feed; every document has at least one, if empty
                cuts = np.unique(np.concatenate([np.flatnonzero(part == 10) + 1, at_byte[1:]]))
                cuts = cuts[cuts > 0]
                sections = np.bincount(allocate(np.cumsum(lengths), cuts, rule), minlength=len(cuts)) if len(ids) else np.zeros(0, np.int64)
                points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                starts = np.concatenate([[0], cuts])[:-1].astype(np.int64)  # none where the chunk has no text
                own = np.searchsorted(at_byte, starts, "right") - 1
                empty = np.flatnonzero(np.diff(at_byte) == 0)
                row = np.concatenate([own, empty])
                order = np.argsort(row, kind="stable")
                row = row[order]
                pad = np.zeros(len(empty), np.int64)
                begin = np.concatenate([points[starts] - points[at_byte[own]], pad])[order]
                end = np.concatenate([points[cuts] - points[at_byte[own]], pad])[order]
                tokens = np.concatenate([sections, pad])[order]
                number = np.arange(len(row)) - np.searchsorted(row, row)
                total = np.diff(at)[row]
                for k in range(0, len(row), OUT_ROWS):
                    cut = slice(k, k + OUT_ROWS)
                    yield pa.RecordBatch.from_arrays(
                        [doc_ids.take(pa.array(row[cut] + first)), *(pa.array(x[cut].astype(np.int64)) for x in (number, begin, end, tokens, total))],
                        names=["doc_id", "section", "char_start", "char_end", "n_tokens", "document_tokens"],
                    )

    return textvec.frugal(run)


def section_token_counts(docs: DataFrame, path: str, *, rule: str = "majority", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line of every document: doc_id, section (from 0), char_start, char_end (code points), n_tokens, document_tokens.

    A section is a line with its line feed. A null or empty text has one empty section of 0
    tokens. Repeated rows and null ids give rows like any other; extra columns are ignored;
    an empty table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(_counter(path, rule), "doc_id long, section long, char_start long, char_end long, n_tokens long, document_tokens long")
