"""Token counts by a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, by the kind of vocabulary file."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: [len(encode(t)) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def with_tokens(df: DataFrame, path: str = TOKENIZER, text: str = "text") -> DataFrame:
    """The other columns of ``df`` and ``tokens``; a null text has none."""
    rest = [c for c in df.columns if c != text]
    schema = df.select(*rest, F.lit(0).cast("long").alias("tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for b in batches:
            count = count or counter(path)
            n = count([t or "" for t in b.column(len(rest)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(n, pa.int64())], names=[*rest, "tokens"])

    return df.select(*rest, text).mapInArrow(run, schema)
