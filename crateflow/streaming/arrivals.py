"""Streams: files that settle, paired controllers, soft takeover, bursts, and plays per window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from crateflow.sources.files import AUDIO, PARTIAL


def settled(events: DataFrame, settle: float) -> DataFrame:
    """Files whose size has not changed for `settle` seconds: rows (name, size, ts in seconds, at_start) in, (name, size,
    ready) out. Files there at the start are ignored unless they change; partial downloads and other files always."""
    extension = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    e = events.where(extension.isin(*AUDIO) & ~extension.isin(*PARTIAL))
    w = Window.partitionBy("name").orderBy("ts")
    e = e.withColumn("_b", F.lag("size").over(w)).withColumn("_n", F.lead("ts").over(w)).withColumn("_ns", F.lead("size").over(w))
    stable = (F.col("_ns") == F.col("size")) & (F.col("_n") - F.col("ts") >= settle)
    known = F.col("at_start") & (F.col("_b").isNull() | (F.col("_b") == F.col("size")))
    ready = e.where(stable & ~known).groupBy("name").agg(F.min(F.struct((F.col("ts") + settle).alias("ready"), "size")).alias("m"))
    return ready.select("name", F.col("m.size").alias("size"), F.col("m.ready").alias("ready"))


class Takeover(StatefulProcessor):
    """A control takes a parameter over only when it comes within reach of its value or crosses it, once something else
    has moved the parameter away from what the control last set."""

    near, moved = 0.04, 0.03

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("control", "now double, applied double, hard double")

    @classmethod
    def step(cls, state: tuple, source: str, value: float) -> tuple[tuple, bool]:
        """(state after a message, whether the value is taken). state: the parameter's value, what the control last set,
        and where the control stands; nulls where not known, and a control not heard before takes over at once."""
        now, applied, hard = state
        if source == "software":
            return (value, applied, hard), False
        if applied is not None and abs(now - applied) > cls.moved and abs(value - now) > cls.near and (hard - now) * (value - now) > 0:
            return (now, applied, value), False
        return (value, value, value), True

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, out = self.state.get() if self.state.exists() else (None, None, None), []
        # the messages of one control in one trigger, in order however they were cut into chunks
        for seq, source, value in pd.concat(rows).sort_values("seq")[["seq", "source", "value"]].itertuples(index=False):
            state, taken = self.step(state, source, float(value))
            if taken:
                out.append((key[0], int(seq), float(value)))
        self.state.update(state)
        yield pd.DataFrame(out, columns=["control", "seq", "value"])

    def close(self) -> None:
        pass


SETTLED = "name string, size long, ready_ms long"


class Settling(StatefulProcessor):
    """A file is ready once its size has stayed above zero for a while, by the clock of the events. What was there at the
    start counts only when it changes; a file is ready once."""

    settle_ms = 1200
    #: Milliseconds that the stream's clock is ahead of the messages': Spark's first watermark is 1970, and what is not after it counts as late.
    ahead_ms = 1 << 40

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("file", "size long, since long, known boolean, done boolean")

    def _ready(self, key, size: int, since: int) -> pd.DataFrame:
        self.state.update((size, since, False, True))
        return pd.DataFrame([(key[0], size, since + self.settle_ms)], columns=["name", "size", "ready_ms"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        size, since, known, done = self.state.get() if self.state.exists() else (None, None, False, False)
        for new, at, start in pd.concat(rows).sort_values(["t_ms", "size"])[["size", "t_ms", "at_start"]].itertuples(index=False):
            if done:
                return
            if size and not known and at - since >= self.settle_ms:  # it was ready before this message
                yield self._ready(key, size, since)
                return
            new = None if pd.isna(new) else int(new)  # an unknown size is a change, and never ready
            if size != new:
                size, since, known = new, int(at), bool(start)
        if done:
            return
        self.state.update((size, since, known, False))
        if size and not known:
            self.handle.registerTimer(since + self.settle_ms + self.ahead_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        size, since, known, done = self.state.get()
        if size and not known and not done and since + self.settle_ms + self.ahead_ms <= expiredTimerInfo.getExpiryTimeInMs():
            yield self._ready(key, size, since)
        else:
            yield pd.DataFrame(columns=["name", "size", "ready_ms"]).astype({"size": "int64", "ready_ms": "int64"})

    def close(self) -> None:
        pass


def settling(files: DataFrame, late: str) -> DataFrame:
    """Files that settle, from a stream of (name, size, at timestamp, t_ms, at_start): partial downloads, hidden and other
    files are left out, as is what has no time; messages up to `late` behind are waited for, also those of a clock that starts at zero."""
    extension = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    wanted = extension.isin(*AUDIO) & ~F.col("name").rlike(r"^(\.|~\$)")
    ahead = F.timestamp_millis(F.unix_millis("at") + Settling.ahead_ms)
    return files.where(wanted & F.col("t_ms").isNotNull()).withColumn("at", ahead).withWatermark("at", late).groupBy("name").transformWithStateInPandas(Settling(), SETTLED, "append", "EventTime")


def watched(arrivals: DataFrame, starts: DataFrame, timeout: float = 1800.0) -> DataFrame:
    """How long each folder was watched: arrivals (folder, ts seconds) and starts (folder, ts) in; (folder, arrived,
    stopped) out. Each arrival winds the clock anew; the watch stops when `timeout` seconds pass without one, and later
    arrivals are not seen. Arrivals before the start don't count."""
    begun = starts.groupBy("folder").agg(F.min("ts").alias("start"))
    seen = arrivals.join(begun, "folder").where("ts >= start").select("folder", "ts", F.lit(1).alias("n"))
    all_rows = seen.unionByName(begun.select("folder", F.col("start").alias("ts"), F.lit(0).alias("n")))
    w = Window.partitionBy("folder").orderBy("ts", "n")
    idle = (F.col("ts") - F.lag("ts").over(w) > timeout).cast("int")
    kept = all_rows.withColumn("_idle", F.coalesce(idle, F.lit(0))).withColumn("_stops", F.sum("_idle").over(w)).where("_stops = 0")
    return kept.groupBy("folder").agg(F.sum("n").alias("arrived"), (F.max("ts") + timeout).alias("stopped"))


TAKEN = "control string, seq long, value double"


def soft_takeover(messages: DataFrame) -> DataFrame:
    """Accepted values of a stream (control, seq, source hardware or software, value)."""
    return messages.groupBy("control").transformWithStateInPandas(Takeover(), TAKEN, "append", "None")


def paired_values(messages: DataFrame, reach_ms: float = 40.0) -> DataFrame:
    """14-bit values of a controller: a coarse message (cc below 32) and the fine one (cc + 32) within reach after it.

    Rows (device, channel, cc, value, t_ms); a coarse message without a partner keeps its seven bits.
    """
    coarse = messages.where("cc < 32").select("device", "channel", "cc", F.col("value").alias("hi"), "t_ms")
    fine = messages.where("cc >= 32 AND cc < 64").select("device", "channel", (F.col("cc") - 32).alias("cc"), F.col("value").alias("lo"), F.col("t_ms").alias("t2"))
    w = Window.partitionBy("device", "channel", "cc").orderBy("t")
    both = coarse.select("device", "channel", "cc", F.col("t_ms").alias("t"), "hi", F.lit(None).cast("int").alias("lo")).unionByName(fine.select("device", "channel", "cc", F.col("t2").alias("t"), F.lit(None).cast("int").alias("hi"), "lo"))
    nxt = F.struct(F.lead("t").over(w).alias("t"), F.lead("lo").over(w).alias("lo"))
    j = both.withColumn("n", nxt).where("hi IS NOT NULL")
    partner = F.when(F.col("n.lo").isNotNull() & (F.col("n.t") - F.col("t") <= reach_ms), F.col("n.lo"))
    value = F.when(partner.isNotNull(), (F.col("hi") * 128 + partner) / 16383.0).otherwise(F.col("hi") / 127.0)
    return j.select("device", "channel", "cc", F.col("t").alias("t_ms"), value.alias("value"), partner.isNotNull().alias("fine"))


def learned_pairs(messages: DataFrame, declared: Column | None = None, window_ms: float = 40.0, tight_ms: float = 5.0, pairs: int = 4) -> DataFrame:
    """Values a controller's faders take, message by message: rows (device, channel, cc, value, t_ms) in.

    A coarse message (cc below 32) gives its seven bits. A fine one (cc + 32) less than `window_ms` after it gives 14 bits,
    if the fader is `declared` to have them or once `pairs` coarse messages in a row have each had a fine one less than
    `tight_ms` after them; until then, and without a coarse message that near, it gives nothing. At one time coarse
    messages come first.
    """
    key = ["device", "channel", "cc"]
    fine = F.col("cc").between(32, 63)
    m = messages.where("cc < 64").select("*", fine.alias("_fine"), (declared if declared is not None else F.lit(False)).alias("_declared"))
    m = m.withColumn("cc", F.when(fine, F.col("cc") - 32).otherwise(F.col("cc")))
    seen = Window.partitionBy(*key).orderBy("t_ms", "_fine", "value").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("_turn", F.sum(F.when(~F.col("_fine"), 1).otherwise(0)).over(seen))
    m = m.withColumn("_hi", F.last(F.when(~F.col("_fine"), F.col("value")), ignorenulls=True).over(seen))
    m = m.withColumn("_gap", F.col("t_ms") - F.last(F.when(~F.col("_fine"), F.col("t_ms")), ignorenulls=True).over(seen))
    tight = F.col("_fine") & (F.col("_gap") < tight_ms)
    in_turn = Window.partitionBy(*key, "_turn").orderBy("t_ms", "_fine", "value").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("_closes", (tight & (F.sum(F.when(tight, 1).otherwise(0)).over(in_turn) == 1)).cast("int"))
    turns = Window.partitionBy(*key).orderBy("_turn").rangeBetween(1 - pairs, 0)
    m = m.withColumn("_learns", (F.col("_closes") == 1) & (F.sum("_closes").over(turns) == pairs))
    wide = F.col("_declared") | F.max("_learns").over(seen)
    gives = ~F.col("_fine") | (wide & (F.col("_gap") < window_ms))
    value = F.when(F.col("_fine"), (F.col("_hi") * 128 + F.col("value")) / 16383.0).otherwise(F.col("value") / 127.0)
    return m.select(*key, "t_ms", value.alias("value"), F.col("_fine").alias("fine"), gives.alias("_gives")).where("_gives").drop("_gives")


def bursts(events: DataFrame, keys: list[str], time: str, within: str) -> DataFrame:
    """The first event of each key within a time: repeats are dropped by the stream's state, bounded by the watermark."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def plays_per_window(events: DataFrame, time: str, size: str, late: str, *keys: str | Column) -> DataFrame:
    """Counts per tumbling window of event time; windows close when the watermark has passed them."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, time: str, gap: str, late: str, *keys: str) -> DataFrame:
    """Sessions of event time: rows of a key less than a gap apart."""
    s = events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")
