"""Arrow batches regrouped by text size, so a chunk's memory is bounded."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def text_chunks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[list[int], list[str]]]:
    """(ids, texts) of the first two columns, about ``chars`` characters at a time."""
    ids, texts, n = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids.append(i)
            texts.append(t or "")
            n += len(texts[-1])
            if n >= chars:
                yield ids, texts
                ids, texts, n = [], [], 0
    if ids:
        yield ids, texts
