"""Episodes of chats: a state machine of one chat at a time, for streams and for tables.

Messages have chat, id, ts (a timestamp), text and vector (an array, or null). The machine holds
one open episode and a bounded pool of suspended ones of the chat; both modes run the same steps.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadloom.functions.text import TOPIC_SHIFTS, extract_words, is_noise


@dataclass(frozen=True)
class Rules:
    """When an episode ends, in seconds and cosines; ``idle`` is None where no timer runs between messages."""

    gap: float = 1800.0
    idle: float | None = None
    duration: float | None = None
    size: int = 100
    diversion: float = 0.30
    semantic: float = 0.45
    reopen: float = 0.65
    baseline: int = 5
    pool: int = 20
    archive: float = 24 * 3600.0


@dataclass
class Episode:
    number: int
    start: float = 0.0
    last: float = 0.0
    n: int = 0
    vectors: list[np.ndarray] = field(default_factory=list)
    suspended: float = 0.0

    def nearest(self, v: np.ndarray) -> float:
        return max((_cosine(v, x) for x in self.vectors), default=0.0)


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    norm = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / norm if norm > 1e-9 else 0.0


@dataclass
class Chat:
    """The state of one chat: an open episode, suspended ones and how many there were."""

    rules: Rules
    current: Episode | None = None
    pool: list[Episode] = field(default_factory=list)
    begun: int = 0

    def dumped(self) -> bytes:
        """The state as plain values, so that a stream can go on with a later version of these classes."""
        one = lambda e: (e.number, e.start, e.last, e.n, [x.tolist() for x in e.vectors], e.suspended)
        return pickle.dumps((self.current and one(self.current), [one(e) for e in self.pool], self.begun))

    @classmethod
    def loaded(cls, rules: Rules, state: bytes) -> Chat:
        current, pool, begun = pickle.loads(state)
        one = lambda e: Episode(*e[:4], [np.asarray(x, float) for x in e[4]], e[5])
        return cls(rules, current and one(current), [one(e) for e in pool], begun)

    def _open(self, v: np.ndarray | None, now: float) -> str:
        """A suspended episode that is near enough, the nearest and among equals the oldest, or else a new one."""
        self.pool = [e for e in self.pool if now - e.suspended <= self.rules.archive]
        best = max(self.pool, key=lambda e: e.nearest(v), default=None) if v is not None else None
        if best is not None and best.nearest(v) >= self.rules.reopen:
            self.pool.remove(best)
            self.current = best
            return "reopened"
        self.current = Episode(self.begun)
        self.begun += 1
        return "new"

    def suspend(self, now: float) -> None:
        """The open episode goes to the pool, and beyond its bound the one suspended longest ago goes."""
        if self.current is not None and self.current.n:
            self.current.suspended = now
            self.pool.append(self.current)
            self.pool = self.pool[-self.rules.pool :]
        self.current = None

    def timer(self, now: float) -> str | None:
        """Which rule of time ends the open episode by now: idle, gap or duration, in this order."""
        e, r = self.current, self.rules
        if e is None or not e.n:
            return None
        tests = (("idle", r.idle is not None and now - e.last >= r.idle), ("gap", now - e.last >= r.gap), ("duration", r.duration is not None and now - e.start >= r.duration))
        return next((name for name, holds in tests if holds), None)

    def boundary(self, now: float, text: str, v: np.ndarray | None) -> str | None:
        e, r = self.current, self.rules
        if reason := self.timer(now):
            return reason
        if (text or "").strip().lower().startswith(tuple(TOPIC_SHIFTS)):
            return "shift"
        if v is not None and e.vectors:
            if _cosine(v, np.mean(e.vectors[: r.baseline], axis=0)) < r.diversion:
                return "diversion"
            if _cosine(v, e.vectors[-1]) < r.semantic:
                return "semantic"
        return None

    def add(self, now: float, text: str, v: np.ndarray | None) -> tuple[int, str]:
        """The number of the episode that a message goes to, and why: appended, or what ended the one before and how this one was opened."""
        why = "append"
        if self.current is None:
            why = self._open(v, now)
        elif self.current.n and (reason := self.boundary(now, text, v)):
            self.suspend(now)
            why = f"{reason}:{self._open(v, now)}"
        e = self.current
        e.start, e.last, e.n = (now if not e.n else e.start), now, e.n + 1
        if v is not None:
            e.vectors = [*e.vectors, v][-self.rules.size :]
        if e.n >= self.rules.size:
            self.suspend(now)
        return e.number, why


_SCHEMA = "chat string, id long, episode long, why string"


def _prepared(messages: DataFrame) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    kind = "array<float>" if messages.schema["vector"].dataType.simpleString() == "array<float>" else "array<double>"  # half the bytes where floats are given
    return messages.select(F.col("chat").cast("string").alias("chat"), F.col("id").cast("long").alias("id"), "ts", seconds.alias("at"), F.coalesce("text", F.lit("")).alias("text"), F.col("vector").cast(kind).alias("vector"))


def _vector(v) -> np.ndarray | None:
    return None if v is None or len(v) == 0 else np.asarray(v, float)


def episodes(messages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(chat, id, episode, why) of every message of a table, in the order of (ts, id).

    A chat's messages stream through one task in order; only its open episode and pool are held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, chat = None, None
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                if chat is None or r.chat != name:
                    name, chat = r.chat, Chat(rules)
                number, why = chat.add(r.at, r.text, _vector(r.vector))
                out.append((r.chat, r.id, number, why))
            yield pd.DataFrame(out, columns=["chat", "id", "episode", "why"])

    dealt = _prepared(messages).filter("chat IS NOT NULL").repartition("chat").sortWithinPartitions("chat", "at", "id")
    return dealt.select("chat", "id", "at", "text", "vector").mapInPandas(run, _SCHEMA)


def stream_episodes(messages: DataFrame, rules: Rules = Rules(), late: str = "1 hour") -> DataFrame:
    """The same of a stream, with the state of each chat kept between batches; a chat silent for ``rules.gap`` of event time suspends its episode.

    Within a batch messages are put in order; a message later than the watermark is dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chat = Chat.loaded(rules, bytes(state.get[0])) if state.exists else Chat(rules)
        if state.hasTimedOut:
            chat.suspend(state.getCurrentWatermarkMs() / 1000)
            state.update((chat.dumped(),))
            return
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        out = [(key[0], r.id, *chat.add(r.at, r.text, _vector(r.vector))) for r in rows.itertuples(index=False)]
        state.update((chat.dumped(),))
        if chat.current is not None:
            state.setTimeoutTimestamp(max(int((chat.current.last + rules.gap) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["chat", "id", "episode", "why"])

    source = _prepared(messages).withWatermark("ts", late)
    return source.groupBy("chat").applyInPandasWithState(step, _SCHEMA, "chat binary", "append", GroupStateTimeout.EventTimeTimeout)


def micro_groups(messages: DataFrame, window: float = 10.0) -> DataFrame:
    """(chat, id, grp) of messages that aren't noise: a thread is a group; others go on with the group before while they come within ``window`` seconds and share a word with it.

    Groups without a thread are numbered in their chat from 0; a thread's group is its name.
    """
    clear = messages.filter(~is_noise(F.col("text"))).withColumn("thread", F.coalesce("thread", F.lit("")))
    threads = clear.filter("thread <> ''").select(F.col("chat").cast("string").alias("chat"), F.col("id").cast("long").alias("id"), F.concat(F.lit("t:"), "thread").alias("grp"))
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat, n, last, words = None, -1, 0.0, set()
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                own = set(r.words)
                if r.chat != chat:
                    chat, n, words = r.chat, 0, set()
                elif r.at - last > window or not own & words:
                    n, words = n + 1, set()
                last = r.at
                words |= own
                out.append((r.chat, r.id, f"g:{n}"))
            yield pd.DataFrame(out, columns=["chat", "id", "grp"])

    rest = clear.filter("thread = ''").select(F.col("chat").cast("string").alias("chat"), F.col("id").cast("long").alias("id"), at.alias("at"), F.array_distinct(extract_words(F.col("text"))).alias("words"))
    dealt = rest.filter("chat IS NOT NULL").repartition("chat").sortWithinPartitions("chat", "at", "id")
    return threads.unionByName(dealt.mapInPandas(run, "chat string, id long, grp string"))


def debounced(changes: DataFrame, key: str, ts: str, quiet: str = "30 seconds") -> DataFrame:
    """(key, ready, n): runs of changes without a pause of ``quiet``, and when each is ready, after that pause; of a table or, with a watermark, of a stream."""
    runs = changes.groupBy(key, F.session_window(ts, quiet).alias("w")).agg(F.count("*").alias("n"))
    return runs.select(key, F.col("w.end").alias("ready"), "n")


def first_of_bursts(events: DataFrame, key: str, seconds: float) -> DataFrame:
    """(key, id) of events (key, id, ts) that come ``seconds`` or more after the last one of their key that was taken."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, last = None, None
        for rows in batches:
            kept = []
            for i, (k, at) in enumerate(zip(rows["key"], rows["at"], strict=True)):
                if k != name or at - last >= seconds:
                    name, last = k, at
                    kept.append(i)
            yield rows.iloc[kept][["key", "id"]]

    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    dealt = events.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col("id").cast("long").alias("id"), at.alias("at")).repartition("key").sortWithinPartitions("key", "at", "id")
    return dealt.mapInPandas(run, "key string, id long").withColumnRenamed("key", key)


def unexpired(messages: DataFrame, now, seconds: float = 1800.0) -> DataFrame:
    """Messages of the last ``seconds`` before a moment."""
    return messages.filter(F.col("ts") >= F.lit(now) - F.expr(f"INTERVAL {seconds} SECOND"))
