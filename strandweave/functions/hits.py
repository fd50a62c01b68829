"""Usable rows of a stream of k-mer hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bases import BLANKS

#: Two bits a base, 4 for any other letter.
BASE_CODE = np.full(256, 4, np.uint8)
BASE_CODE[[ord(x) for x in "ACGT"]] = range(4)


def packed(bases: np.ndarray) -> np.ndarray:
    """Rows of up to 32 two-bit bases as integers, the first base lowest."""
    full = np.zeros((len(bases), 32), np.uint8)
    full[:, : bases.shape[1]] = bases
    fours = full.reshape(-1, 8, 4)
    return (fours[:, :, 0] | fours[:, :, 1] << 2 | fours[:, :, 2] << 4 | fours[:, :, 3] << 6).view("<i8").ravel()


def canonical_codes(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which texts are k letters of ACGT (in either case, blanks around them), and the canonical codes of those."""
    text = pc.utf8_trim(text, characters=BLANKS)
    mask = pc.equal(pc.binary_length(text), k).fill_null(False).to_numpy(zero_copy_only=False)
    text = text.filter(pa.array(mask))
    if not len(text):
        return mask, np.empty(0, np.int64)
    start = np.frombuffer(text.buffers()[1], np.int32)[text.offset]
    letters = np.frombuffer(text.buffers()[2], np.uint8)[start : start + k * len(text)].reshape(len(text), k)
    bases = BASE_CODE[letters & 0xDF]  # the mask makes ASCII letters upper case
    fine = (bases < 4).all(1) & (letters < 128).all(1) & (letters >= 64).all(1)
    mask[np.flatnonzero(mask)] = fine
    bases = bases[fine]
    return mask, np.minimum(packed(bases), packed(3 - bases[:, ::-1]))


def usable_hits(hits: DataFrame, *, k: int = 31, text: str = "kmer", columns: tuple[str, ...] = ("hit_id", "run_id", "read_id")) -> DataFrame:
    """Rows whose k-mer, without surrounding blanks and in upper case, is exactly ``k`` letters of ACGT, as ``columns``
    and ``code`` (canonical, BIGINT, equal to ``bases.canonical_code``). Null, empty and longer texts are not usable.
    Resent rows are still there: the counts drop them. Arrow batches: the same in column expressions takes more CPU
    time."""
    if k > 31:
        raise ValueError("two bits a base must fit into a BIGINT")
    schema = T.StructType([*(hits.schema[c] for c in columns), T.StructField("code", T.LongType())])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, code = canonical_codes(batch.column(len(columns)), k)
            kept = batch.filter(pa.array(mask))
            yield pa.RecordBatch.from_arrays([*kept.columns[: len(columns)], pa.array(code)], names=[*columns, "code"])

    return hits.select(*columns, text).mapInArrow(codes, schema)
