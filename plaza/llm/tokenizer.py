"""Lengths of texts in tokens of a public byte-level tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plaza.llm.tokens import slices

#: Vocabulary used where none is named.
VOCABULARY = "byte_bpe_50k.tiktoken"
_ENCODERS: dict[str, object] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed package of public tokenizers keeps a vocabulary."""
    found = importlib.util.find_spec("public_tokenizers")
    root = Path(found.submodule_search_locations[0]) if found else Path("/opt/tokenizers")
    return str(root / name)


def encoder(path: str):
    """The tokenizer of a ranks file, made once per process."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding(Path(path).stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_lengths(df: DataFrame, keep: list[str], text: str, path: str | None = None, name: str = "tokens") -> DataFrame:
    """The columns ``keep`` with the number of tokens of ``text``; null counts as no text."""
    path = path or vocabulary_path()
    rows = df.select(*keep, text)
    ddl = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            for i, texts in slices(b.column(len(keep)), 1 << 20):
                n[i : i + len(texts)] = [len(x) for x in enc.encode_ordinary_batch([t or "" for t in texts], num_threads=1)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n)], [*keep, name])

    return rows.mapInArrow(run, f"{ddl}, {name} long")
