"""Which announcements are new, as keyed state: each address with the hash of its last text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridlore import constants as C
from gridlore.functions import text as tx

_OUT = "url string, title string, body string, content_hash string, attempt int, payload string, error string"


def unread_stream(announcements: DataFrame, days: int | None = None, extractor=None) -> DataFrame:
    """The announcements of a stream (url, title, body, published_day where there is one) to read: new
    addresses, changed texts, and texts that could not be read yet, up to the third attempt.

    ``extractor`` reads them on the spot and its answer or failure is in ``payload`` and ``error``; a text it
    has read is not read again. Without one no attempt counts as a success. With ``days``, the state of
    addresses that were not delivered for so long is dropped; such a stream polls for ever and never ends by
    itself."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if days and state.hasTimedOut:
            state.remove()
            return
        known, attempts, ok = state.get if state.exists else (None, 0, False)
        for frame in frames:
            rows = []
            for row in frame.itertuples():
                if row.content_hash != known:
                    known, attempts, ok = row.content_hash, 0, False
                if ok or attempts >= C.MAX_PARSE_ATTEMPTS:
                    continue
                attempts, payload, error = attempts + 1, None, None
                if extractor is not None:
                    try:
                        payload, ok = extractor(row.title, row.body, getattr(row, "published_day", None)), True
                    except Exception as e:
                        error = str(e) or type(e).__name__
                rows.append((key[0], row.title, row.body, known, attempts, payload, error))
            if rows:
                yield pd.DataFrame(rows, columns=["url", "title", "body", "content_hash", "attempt", "payload", "error"])
        state.update((known, attempts, ok))
        if days:
            state.setTimeoutDuration(days * 24 * 3600 * 1000)

    hashed = announcements.withColumn("content_hash", tx.article_hash(F.col("title"), F.col("body")))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if days else GroupStateTimeout.NoTimeout
    return hashed.groupBy("url").applyInPandasWithState(step, _OUT, "hash string, attempts int, ok boolean", "append", timeout)
