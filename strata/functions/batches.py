"""Record batches of Arrow passes, cut by bytes and not by rows alone, so that a worker's memory does not follow its texts."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: Bytes of the record batches that executors send to Python workers; Spark alone would fill 64 MB or 10,000 rows, held by both sides.
MOST_SENT = "4m"


def send_little(spark) -> None:
    """From now on this session's record batches hold about MOST_SENT (or one row), unless it has a bound of its own.

    A bound that ended with the caller would not hold for the plans that it returns.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, MOST_SENT)


def release() -> None:
    """Gives memory that this worker has freed back to the system, for a worker is used again by later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def slices(batches, most_bytes: int = 8 << 20, text: str = "text"):
    """Record batches cut so that each holds at most about ``most_bytes`` of a text or binary column (or one row); freed memory goes back after each batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
        del sizes, offsets, batch
        release()
