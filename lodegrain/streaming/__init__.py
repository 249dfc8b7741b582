"""Decoding of streams: decoders are row-local, so they run unchanged and need no state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.core import Decoder
from ..operators.dataset import Decoded, decode


def quarantine(stream: DataFrame, decoder: Decoder, valid: str, rejected: str, checkpoint: str, boundary: str = "object", on_batch: Callable[[Decoded, int], None] | None = None, kind: str = "parquet"):
    """A streaming query that writes values to one folder and refused rows, with their issues, to another.

    A batch that is run again replaces its own folder, so each row is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        done = decode(batch, decoder, boundary)
        frame = done.frame.persist()
        held = Decoded(frame)
        try:
            held.valid().write.mode("overwrite").format(kind).save(f"{valid}/batch={number}")
            held.rejected().write.mode("overwrite").format(kind).save(f"{rejected}/batch={number}")
            if on_batch:
                on_batch(held, number)
        finally:
            frame.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
