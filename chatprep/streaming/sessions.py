"""Sessions as their calls arrive: streaks of failures, token limits and metrics.

State is kept by session. Calls wait in it until the watermark has passed them, so that
they are read in order however they arrive; a timer on their time brings them out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chatprep.rules import MAX_TOTAL_TOKENS

#: The store that keyed state with timers needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What comes out: a streak that a success has ended, the first call beyond the token
#: limit, and the metrics after each step in time.
EVENT = (
    "session_id long, kind string, first_call long, last_call long, length long, n_calls long, n_errors long, "
    "total_tokens long, elapsed_us long"
)
_NAMES = [field.split(" ")[0] for field in EVENT.split(", ")]
#: Calls that wait in one value of the state.
PACKED_CALLS = 4096
_CALL = [("us", "<i8"), ("call_no", "<i8"), ("success", "?"), ("tokens", "<i8")]


def _sessions(max_total: int) -> StatefulProcessor:
    """The processor. Its class is made here so that it travels with its code: Spark sets state up in a
    Python process of its own, which may not find this package.
    """

    class Sessions(StatefulProcessor):
        """Reads each session's calls in order of time and number."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.event = Row(*_NAMES)
            # Many calls in one value: a value is read and written by a message of its own.
            self.waiting = handle.getListState("waiting", "calls binary")
            self.known = handle.getValueState(
                "known",
                "n_calls long, n_errors long, total_tokens long, first_us long, last_us long, run_first long, run_last long, "
                "run_length long, breached boolean, upto long",
            )

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            calls, first = [], None
            for row in rows:
                calls.append((row.us, row.call_no, row.success, row.tokens))
                if len(calls) == PACKED_CALLS:
                    first = self._keep(calls, first)
                    calls = []
            if calls:
                first = self._keep(calls, first)
            # One timer is enough: when it goes off, all calls come out that the watermark has passed.
            self.handle.registerTimer(first // 1000 + 1)
            return iter(())

        def _keep(self, calls, first):
            packed = np.array(calls, _CALL)
            self.waiting.appendValue((packed.tobytes(),))
            least = int(packed["us"].min())
            return least if first is None else min(first, least)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            expired = expiredTimerInfo.getExpiryTimeInMs()
            known = self.known.get() or (0, 0, 0, None, 0, 0, 0, 0, False, -(1 << 63))
            if expired * 1000 <= known[-1]:
                return
            upto = max(expired, timerValues.getCurrentWatermarkInMs()) * 1000
            calls = np.concatenate([np.frombuffer(packed, _CALL) for (packed,) in self.waiting.get()] or [np.empty(0, _CALL)])
            later, calls = calls[calls["us"] >= upto], calls[calls["us"] < upto]
            if not len(calls):
                return
            # Of calls with one time and number the last to arrive counts; the order is stable.
            calls = calls[np.lexsort((calls["call_no"], calls["us"]))]
            same = (calls["us"][1:] == calls["us"][:-1]) & (calls["call_no"][1:] == calls["call_no"][:-1])
            calls = calls[np.append(~same, True)]
            n, errors, total, first_us, last_us, run_first, run_last, run, breached, _ = known
            if first_us is None:
                first_us = int(calls["us"][0])
            # Metrics come after the last call of each millisecond.
            ends = np.append(calls["us"][1:] // 1000 != calls["us"][:-1] // 1000, True)
            for start in range(0, len(calls), PACKED_CALLS):
                stop = start + PACKED_CALLS
                for (us, call_no, success, tokens), end in zip(calls[start:stop].tolist(), ends[start:stop].tolist(), strict=True):
                    n, errors, total, last_us = n + 1, errors + (not success), total + tokens, us
                    if not success:
                        run_first = run_first if run else call_no
                        run_last, run = call_no, run + 1
                    elif run:
                        yield self.event(key[0], "streak", run_first, run_last, run, None, None, None, None)
                        run = 0
                    if total > max_total and not breached:
                        yield self.event(key[0], "breach", call_no, call_no, 1, n, errors, total, last_us - first_us)
                        breached = True
                    if end:
                        yield self.event(key[0], "metrics", None, None, run, n, errors, total, last_us - first_us)
            self.known.update((n, errors, total, first_us, last_us, run_first, run_last, run, breached, upto))
            if len(later):
                self.waiting.put([(later[k : k + PACKED_CALLS].tobytes(),) for k in range(0, len(later), PACKED_CALLS)])
                self.handle.registerTimer(int(later["us"].min()) // 1000 + 1)
            else:
                self.waiting.clear()

        def close(self) -> None:
            pass

    return Sessions()


def live_sessions(calls: DataFrame, watermark: str = "10 minutes", max_total: int = MAX_TOTAL_TOKENS) -> DataFrame:
    """Streaks, breaches and metrics of sessions while their calls arrive; see ``EVENT``.

    ``calls`` is a stream with ``session_id, call_no, ts, success, tokens``. Calls that are
    later than the watermark are dropped, others count in order of time and number,
    whatever order they arrive in. ``metrics`` are running figures, the last row of a
    session has the whole; ``length`` is that of the streak that is still open. The
    state of a session is a few numbers and the calls that wait, packed; those of one session
    pass a task together, as 25 bytes each. Needs ``STATE_STORE`` as
    ``spark.sql.streaming.stateStore.providerClass``.
    """
    rows = calls.select(
        F.col("session_id").cast("long").alias("session_id"),
        F.col("call_no").cast("long").alias("call_no"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.coalesce(F.col("success").cast("boolean"), F.lit(False)).alias("success"),
        F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"),
    )
    placed = rows.where("session_id IS NOT NULL AND call_no IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", watermark)
    return placed.groupBy("session_id").transformWithState(
        statefulProcessor=_sessions(max_total), outputStructType=EVENT, outputMode="Append", timeMode="EventTime"
    )
