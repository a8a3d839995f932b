"""Fixed-size vectors per sequence from a pluggable encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtables.functions.kmers import kmer_counts


def letter_batches(texts: list[str], batch_size: int, batch_letters: int) -> Iterator[list[str]]:
    """Runs of texts of at most ``batch_size`` rows and ``batch_letters`` letters, or one text."""
    batch: list[str] = []
    letters = 0
    for text in texts:
        if batch and (len(batch) == batch_size or letters + len(text) > batch_letters):
            yield batch
            batch, letters = [], 0
        batch.append(text)
        letters += len(text)
    if batch:
        yield batch


def embed_rows(
    df: DataFrame,
    encoder_factory: Callable[[], Callable[[list[str]], list]],
    sequence: str = "sequence",
    column: str = "embedding",
    max_length: int | None = None,
    batch_size: int = 8,
    batch_letters: int = 100_000,
) -> DataFrame:
    """All columns of ``df`` and ``column`` from an encoder built once per task.

    ``encoder_factory()`` returns a function from a list of sequences to a list of vectors. Rows pass
    through the encoder's task with all they have, so nothing is joined back. A null sequence has a
    null vector; a column of the new name is replaced.
    """
    text = F.col(sequence) if max_length is None else F.substring(F.col(sequence), 1, max_length)
    kept = [f for f in df.schema if f.name != column]
    schema = T.StructType([*kept, T.StructField(column, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_factory()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            known = [t for t in texts if t is not None]
            vectors: list = []
            for part in letter_batches(known, batch_size, batch_letters):
                vectors.extend(encode(part))
            found = iter(vectors)
            cells = [None if t is None else next(found) for t in texts]
            arrays = [*batch.columns[:-1], pa.array(cells, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], column])

    plain = [F.col(f.name) for f in kept]
    return df.select(*plain, text.alias("_text")).mapInArrow(run, schema)


def embed(
    df: DataFrame,
    encoder_factory: Callable[[], Callable[[list[str]], list]],
    key: str = "id",
    sequence: str = "sequence",
    max_length: int | None = None,
    batch_size: int = 8,
) -> DataFrame:
    """``(key, embedding)``; a text only the key is needed of."""
    rows = df.select(key, F.col(sequence).alias("_sequence"))
    found = embed_rows(rows, encoder_factory, "_sequence", "embedding", max_length, batch_size)
    return found.select(key, "embedding")


def kmer_encoder(k: int = 3, dim: int = 64) -> Callable[[], Callable[[list[str]], list]]:
    """Built-in stand-in for a frozen encoder: hashed k-mer counts scaled to length 1."""

    def factory() -> Callable[[list[str]], list]:
        return lambda texts: [kmer_counts(t, k, dim) for t in texts]

    return factory


def kmer_embed(
    df: DataFrame, key: str = "id", sequence: str = "sequence", k: int = 3, dim: int = 64
) -> DataFrame:
    """``(key, embedding)`` from the built-in encoder."""
    return embed(df, kmer_encoder(k, dim), key, sequence, batch_size=256)


def kmer_embed_rows(
    df: DataFrame, sequence: str = "sequence", column: str = "embedding", k: int = 3, dim: int = 64
) -> DataFrame:
    """All columns of ``df`` and the vector of the built-in encoder."""
    return embed_rows(df, kmer_encoder(k, dim), sequence, column, batch_size=256)
