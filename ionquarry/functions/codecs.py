"""Byte layouts of legacy tables, as Arrow UDFs for importers.

Little-endian 32-bit floats (``floats``), 32-bit unsigned bits with 32-bit
signed counts (``bits``, ``counts``), and NumPy's .npy format (``npy``).  An empty
byte string is an empty array; null stays null.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _reader(dtype: str, spark_type: str):
    @F.pandas_udf(f"array<{spark_type}>")
    def read(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b, dtype=dtype))

    return read


def _writer(dtype: str):
    @F.pandas_udf("binary")
    def write(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.asarray(v).astype(dtype).tobytes())

    return write


def floats_from_bytes(blob: Column) -> Column:
    return _reader("<f4", "float")(blob)


def floats_to_bytes(values: Column) -> Column:
    return _writer("<f4")(values)


def bits_from_bytes(blob: Column) -> Column:
    return _wide("<u4")(blob)


def counts_from_bytes(blob: Column) -> Column:
    return _reader("<i4", "int")(blob)


def bits_to_bytes(values: Column) -> Column:
    return _writer("<u4")(values)


def counts_to_bytes(values: Column) -> Column:
    return _writer("<i4")(values)


def _wide(dtype: str):
    @F.pandas_udf("array<bigint>")
    def read(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b, dtype=dtype).astype(np.int64))

    return read


def npy_from_bytes(blob: Column) -> Column:
    @F.pandas_udf("array<double>")
    def read(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.load(io.BytesIO(b), allow_pickle=False).astype(np.float64).ravel() if b else np.empty(0))

    return read(blob)


def npy_to_bytes(values: Column) -> Column:
    @F.pandas_udf("binary")
    def write(arrays: pd.Series) -> pd.Series:
        def one(v):
            out = io.BytesIO()
            np.save(out, np.asarray(v, dtype=np.float64), allow_pickle=False)
            return out.getvalue()

        return arrays.map(lambda v: None if v is None else one(v))

    return write(values)
