"""One input to many consumers."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.storagelevel import StorageLevel

Consumer = Callable[[DataFrame, int], None]


def fan_out(consumers: Mapping[str, Consumer], on_error: Callable[[str, int, Exception], None] | None = None):
    """A ``foreachBatch`` function handing every batch to every consumer.

    One consumer's failure does not keep the batch from the others.  Failures
    go to ``on_error``; without it they are raised together at the end, so the
    batch is tried again.
    """
    def consume(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        failures: list[tuple[str, Exception]] = []
        try:
            for name, write in consumers.items():
                try:
                    write(batch, batch_id)
                except Exception as problem:  # noqa: BLE001 - every consumer gets its turn
                    failures.append((name, problem))
        finally:
            batch.unpersist()
        if on_error is not None:
            for name, problem in failures:
                on_error(name, batch_id, problem)
        elif failures:
            raise RuntimeError("; ".join(f"{n}: {p}" for n, p in failures)) from failures[0][1]

    return consume
