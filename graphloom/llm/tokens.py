"""Token counts of texts under a public tokenizer, whose files are named by a path."""

from __future__ import annotations

import base64
import functools
import importlib.util

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import pick

HOME = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"


@functools.lru_cache(4)
def _encoding(home: str, vocabulary: str):
    import tiktoken

    spec = importlib.util.spec_from_file_location("_tokenizer_files", f"{home}/__init__.py")
    files = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(files)
    with open(f"{home}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, home: str = HOME, vocabulary: str = VOCABULARY) -> list[int]:
    return _encoding(home, vocabulary).encode_ordinary(text)


def counted(df: DataFrame, id_col: str, text_col: str, *others: str, home: str = HOME, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, the other columns, n_tokens); a null or empty text has 0 tokens."""
    src = pick(df, id_col, *others, text_col)
    names = [id_col, *others]
    fields = [src.schema[c] for c in names]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens bigint"

    def run(batches):
        enc = _encoding(home, vocabulary)
        for b in batches:
            texts = b.column(len(names)).to_pylist()
            n = [len(x) for x in enc.encode_ordinary_batch([t or "" for t in texts], num_threads=1)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(n, pa.int64())], names=[*names, "n_tokens"])

    return src.mapInArrow(run, out).where(F.col(f"`{id_col}`").isNotNull())
