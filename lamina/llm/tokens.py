"""Encoding of whole corpora: ids and token counts of every text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm import automaton


def encode(text: Column, folder: str | None = None, name: str = automaton.TOKENIZER) -> Column:
    """Token ids of a text as ARRAY<INT>, without special tokens; the empty list for null and empty texts.

    Strings that look like special tokens are ordinary text. Texts are encoded whole, whatever their length.
    ``folder`` is where the vocabulary file lies; it is compiled on the driver and travels as tables of a few MB.
    """
    folder = folder or automaton.default_folder()
    tables = automaton.compiled(folder, name)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        table = automaton.chunks(tables, folder, name)
        packed = [automaton.encode_text(t, table) if t else b"" for t in texts.to_pylist()]
        offsets = np.zeros(len(packed) + 1, np.int32)
        np.cumsum([len(p) >> 2 for p in packed], out=offsets[1:])
        values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))])
        return pa.ListArray.from_arrays(pa.array(offsets), values)

    return ids(text)


def count(text: Column, folder: str | None = None, name: str = automaton.TOKENIZER) -> Column:
    """Number of token ids of a text; 0 for null and empty texts."""
    folder = folder or automaton.default_folder()
    tables = automaton.compiled(folder, name)

    @F.arrow_udf(T.LongType())
    def sizes(texts: pa.Array) -> pa.Array:
        table = automaton.chunks(tables, folder, name)
        return pa.array([len(automaton.encode_text(t, table)) >> 2 if t else 0 for t in texts.to_pylist()], pa.int64())

    return sizes(text)


def decode(ids: Column, folder: str | None = None, name: str = automaton.TOKENIZER) -> Column:
    """The text of token ids: the arc labels of their path, joined. Null gives null; an id without a label fails."""
    folder = folder or automaton.default_folder()

    @F.arrow_udf(T.StringType())
    def texts(lists: pa.Array) -> pa.Array:
        label = automaton.labels(folder, name).__getitem__
        return pa.array([None if x is None else b"".join(map(label, x)).decode("utf-8", "replace") for x in lists.to_pylist()], pa.string())

    return texts(ids)


def corpus_ids(documents: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, ids) of every document, those with null and empty texts too. A narrow map: nothing is shuffled."""
    return documents.select("doc_id", encode(F.col("text"), folder).alias("ids"))
