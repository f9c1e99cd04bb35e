"""Jobs whose state outlives a batch: one-time codes, pending requests, replay of what a sink refused, live policy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.policy import as_of
from ..sources.shared import Rounds

#: The state store that keyed state with timers needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def verdict(code: dict | None, at: float, digest: str, most: int) -> tuple[str, dict | None]:
    """What a try at a code gives, and what is left of the code.

    No code, or one that was used: bad. A code past its time: expired, and gone. One that was tried ``most`` times:
    locked, and gone. Another digest: bad, and one more try. Else ok, and used.
    """
    if code is None or code["used"]:
        return "bad", code
    if code["expires"] < at:
        return "expired", None
    if code["tries"] >= most:
        return "locked", None
    if code["digest"] != digest:
        return "bad", code | {"tries": code["tries"] + 1}
    return "ok", code | {"used": True}


class _Codes(StatefulProcessor):
    def __init__(self, most: int, keep: float):
        self.most, self.keep = most, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.code = handle.getValueState("code", "digest string, expires double, tries int, used boolean")

    def _put(self, code: dict | None) -> None:
        if code is None:
            self.code.clear()
        else:
            self.code.update((code["digest"], code["expires"], code["tries"], code["used"]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        code = dict(zip(("digest", "expires", "tries", "used"), self.code.get(), strict=True)) if self.code.exists() else None
        out = []
        for e in events.sort_values(["at", "seq"]).itertuples():
            at = e.at.timestamp()
            if e.kind == "issue":
                code = {"digest": e.digest, "expires": at + e.ttl, "tries": 0, "used": False}
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(int((code["expires"] + self.keep) * 1000))
            else:
                said, code = verdict(code, at, e.digest, self.most)
                out.append((key[0], e.at, e.seq, said))
        self._put(code)
        yield pd.DataFrame(out, columns=["member", "at", "seq", "verdict"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.code.clear()
        yield pd.DataFrame([], columns=["member", "at", "seq", "verdict"])

    def close(self) -> None:
        pass


def one_time_codes(events: DataFrame, most: int = 5, keep: float = 86_400.0, late: str = "1 minute") -> DataFrame:
    """``member, at, seq, verdict`` of each try in a stream of ``(member, at, seq, kind, digest, ttl)``.

    Kind ``issue`` replaces a member's code by one that is good for ``ttl`` seconds, ``verify`` tries one. Members are
    lower-cased and trimmed. Within a batch the events of a member count in order of time, then ``seq``. The state is
    one value a member; a timer clears it ``keep`` seconds after the code ran out, so members who never come back cost
    nothing. The session needs ROCKSDB as its state store.
    """
    keyed = events.withColumn("member", F.lower(F.trim("member"))).withWatermark("at", late)
    return keyed.groupBy("member").transformWithStateInPandas(_Codes(most, keep), "member string, at timestamp, seq long, verdict string", "append", "EventTime")


def request_states(requests: DataFrame, results: DataFrame, wait: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """``request_id, ts, status`` of streams ``requests(request_id, ts)`` and ``results(request_id, done_at, error)``.

    A request is completed, or failed if its result has an error, when the result comes within ``wait``; lost when the
    watermark shows that none came. Until then it is pending and has no row: see :func:`looked_up`. Repeated requests and
    results, as at-least-once delivery gives, count once.
    """
    asked = requests.select("request_id", "ts").withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_id"])
    told = results.select(F.col("request_id").alias("_id"), "done_at", "error").withWatermark("done_at", late).dropDuplicatesWithinWatermark(["_id"])
    met = asked.join(told, F.expr(f"request_id = _id AND done_at >= ts AND done_at <= ts + INTERVAL {wait}"), "left_outer")
    return met.select("request_id", "ts", F.when(F.col("_id").isNull(), "lost").when(F.col("error").isNotNull(), "failed").otherwise("completed").alias("status"))


def looked_up(ids: DataFrame, states: DataFrame) -> DataFrame:
    """``request_id, status`` of each asked id: what was written for it, else pending, known or not."""
    latest = states.groupBy("request_id").agg(F.max_by("status", F.struct("ts", "status")).alias("status"))
    return ids.select("request_id").distinct().join(latest, "request_id", "left").select("request_id", F.coalesce("status", F.lit("pending")).alias("status"))


def replay(spark: SparkSession, letters: DataFrame, state: DataFrame | None, write: Callable[[DataFrame], None], now: float, most: int = 8, first: float = 5.0, cap: float = 600.0) -> DataFrame:
    """One pass over dead letters ``(request_id, payload)``: those that are due are written again; the new state is returned.

    The state is ``request_id, tries, next_at, status``: open letters wait ``first`` seconds, then twice as long each
    time, ``cap`` at most; after ``most`` tries a letter is given up. Letters already done or given up are passed over,
    so letters that came twice are written once, and a pass that is run again with the state it began from asks the
    sink for the same rows again: the sink has to take a request_id once, like :func:`modlake.sources.sinks.append_new`.
    What is due goes to the sink in one call, which fails as a whole.
    """
    rounds = Rounds(spark, "replay")
    each = letters.groupBy("request_id").agg(F.min("payload").alias("payload"))
    known = state if state is not None else spark.createDataFrame([], "request_id string, tries int, next_at double, status string")
    told = each.join(known.withColumn("_known", F.lit(True)), "request_id", "full_outer")
    told = rounds.write(told.select("request_id", "payload", F.coalesce("tries", F.lit(0)).alias("tries"), F.coalesce("next_at", F.lit(0.0)).alias("next_at"), F.coalesce("status", F.lit("open")).alias("status")))
    due = (F.col("status") == "open") & (F.col("next_at") <= now) & F.col("payload").isNotNull()
    try:
        write(told.where(due).select("request_id", "payload"))
        done = True
    except Exception:  # the sink's: whatever it is, the letters stay
        done = False
    tries = F.col("tries") + 1
    wait = F.least(F.lit(float(cap)), F.lit(float(first)) * F.pow(F.lit(2.0), F.col("tries")))
    after = F.when(due, F.lit("done") if done else F.when(tries >= most, "given up").otherwise("open")).otherwise(F.col("status"))
    return rounds.write(told.select("request_id", F.when(due, tries).otherwise(F.col("tries")).cast("int").alias("tries"), F.when(due, F.lit(now) + wait).otherwise(F.col("next_at")).alias("next_at"), after.alias("status")))


def with_live_policy(versions: Callable[[], DataFrame], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each batch is joined with the policy versions as they are when it starts, by its rows' own times."""

    def batch(rows: DataFrame, number: int) -> None:
        write(as_of(rows, versions()), number)

    return batch
