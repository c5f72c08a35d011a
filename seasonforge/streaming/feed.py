"""Change feeds: an event only says that something of a key has changed; what it is now is read again as a whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

Load = Callable[[DataFrame], DataFrame]
Deliver = Callable[[DataFrame, int], None]


def reload(batch: DataFrame, key: str, current: DataFrame) -> DataFrame:
    """The current rows of every key that the batch names, once however often it is named."""
    return current.join(batch.where(f"`{key}` is not null").select(key).distinct(), key, "left_semi")


def follow(events: DataFrame, key: str, current: Callable[[], DataFrame], deliver: Deliver, checkpoint: str, every: str | None = "1 second") -> StreamingQuery:
    """Delivers the current rows of changed keys for each batch of ``events``; ``current`` is asked anew each time.

    A batch that is run again delivers the state of then, so a reader never falls behind for good; a reader
    that must not see a batch twice keeps its number.  Without ``every`` the stream ends with what is there.
    """

    def one(batch: DataFrame, number: int) -> None:
        deliver(reload(batch, key, current()), number)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**trigger).start()
