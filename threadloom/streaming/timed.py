"""Episodes with timers, a pool of suspended ones and an archive, for streams and for tables.

An episode is suspended when its rules say so, by the clock of event time: idle, gap and duration
have deadlines, which hold whether or not another message comes. A suspended episode may be
reopened by a message that is near to it; after ``archive`` seconds it leaves as a row.
Both modes give rows (chat, id, episode, event, at, step): what became of each message (id is its
own) and of each episode (id is null); step numbers a chat's rows in the order of what happened.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from threadloom.functions.text import TOPIC_SHIFTS
from threadloom.sources.scratch import beside, written
from threadloom.streaming.episodes import Rules, _cosine, _prepared, _vector

ROWS = "chat string, id long, episode long, event string, at double, step long"
#: Where the state of streams must be kept: transformWithState needs this provider.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Suspended:
    number: int
    start: float
    last: float
    n: int
    vectors: list[np.ndarray] = field(default_factory=list)
    at: float = 0.0


class TimedChat:
    """The state machine of one chat. Every method returns rows (id, episode, event, at)."""

    def __init__(self, rules: Rules, bounded: bool = True):
        self.rules, self.bounded = rules, bounded
        self.open: Suspended | None = None
        self.pool: dict[int, Suspended] = {}
        self.begun = self.steps = 0

    def numbered(self, name: str, rows: list[tuple]) -> list[tuple]:
        """``rows`` as ROWS."""
        self.steps += len(rows)
        return [(name, *x, self.steps - len(rows) + k) for k, x in enumerate(rows)]

    def deadline(self) -> tuple[float, str] | None:
        """When time ends the open episode, and by which rule: the earliest, and of equal ones idle, gap, duration."""
        e, r = self.open, self.rules
        if e is None:
            return None
        ends = [("idle", e.last + r.idle if r.idle is not None else np.inf), ("gap", e.last + r.gap), ("duration", e.start + r.duration if r.duration is not None else np.inf)]
        name, at = min(ends, key=lambda x: x[1])
        return at, name

    def suspend(self, at: float, why: str) -> list[tuple]:
        e, self.open = self.open, None
        e.at = at
        self.pool[e.number] = e
        out = [(None, e.number, f"suspended:{why}", at)]
        if self.bounded and len(self.pool) > self.rules.pool:
            old = min(self.pool.values(), key=lambda x: (x.at, x.number))
            del self.pool[old.number]
            out.append((None, old.number, "evicted", at))
        return out

    def advance(self, now: float) -> list[tuple]:
        """Timers up to a moment, itself included."""
        out = []
        if (end := self.deadline()) is not None and end[0] <= now:
            out += self.suspend(*end)
        for e in sorted(self.pool.values(), key=lambda e: (e.at, e.number)):
            if e.at + self.rules.archive <= now:
                del self.pool[e.number]
                out.append((None, e.number, "archived", e.at + self.rules.archive))
        return out

    def next_timer(self) -> float | None:
        """The earliest moment at which ``advance`` does something."""
        end = self.deadline()
        return min([*([end[0]] if end else []), *(e.at + self.rules.archive for e in self.pool.values())], default=None)

    def evict(self, number: int, suspended: float, at: float) -> list[tuple]:
        """An episode leaves that the bound over all chats puts out, if it still waits since then."""
        e = self.pool.get(number)
        if e is None or e.at != suspended:
            return []
        del self.pool[number]
        return [(None, number, "evicted", at)]

    def _differs(self, text: str, v: np.ndarray | None) -> str | None:
        e, r = self.open, self.rules
        if (text or "").strip().lower().startswith(tuple(TOPIC_SHIFTS)):
            return "shift"
        if v is not None and e.vectors:
            if _cosine(v, np.mean(e.vectors[: r.baseline], axis=0)) < r.diversion:
                return "diversion"
            if _cosine(v, e.vectors[-1]) < r.semantic:
                return "semantic"
        return None

    def add(self, id_: int, now: float, text: str, v: np.ndarray | None) -> list[tuple]:
        out = self.advance(now)
        if self.open is not None and (why := self._differs(text, v)):
            out += self.suspend(now, why)
        event = "append"
        if self.open is None:
            near = {n: max((_cosine(v, x) for x in e.vectors), default=0.0) for n, e in self.pool.items()} if v is not None else {}
            best = max(near, key=lambda n: (near[n], -self.pool[n].at, -n), default=None)
            if best is not None and near[best] >= self.rules.reopen:
                self.open, event = self.pool.pop(best), "reopened"
            else:
                self.open, event = Suspended(self.begun, now, now, 0), "new"
                self.begun += 1
        e = self.open
        e.last, e.n = now, e.n + 1
        if v is not None:
            e.vectors = [*e.vectors, v][-self.rules.size :]
        out.append((id_, e.number, event, now))
        if e.n >= self.rules.size:
            out += self.suspend(now, "size")
        return out


def timed_episodes(messages: DataFrame, rules: Rules = Rules(), until: float | None = None, evictions: DataFrame | None = None) -> DataFrame:
    """ROWS of the messages (chat, id, ts, text, vector) of a table, in the order of (ts, id); timers run up to ``until``, in epoch seconds, or the chat's last message.

    With ``evictions`` (chat, number, suspended, at) the pool has no bound of its own and these episodes
    are put out. A chat's rows stream through one task in order; only its state is held. Messages
    without a chat or a time are left out.
    """

    bounded = evictions is None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, chat = None, None
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                if chat is None or r.chat != name:
                    if chat is not None and until is not None:
                        out += chat.numbered(name, chat.advance(until))
                    name, chat = r.chat, TimedChat(rules, bounded)
                if r.kind == 0:
                    out += chat.numbered(name, chat.advance(r.at) + chat.evict(int(r.id), r.suspended, r.at))
                else:
                    out += chat.numbered(name, chat.add(r.id, r.at, r.text, _vector(r.vector)))
            yield _frame(out)
        if chat is not None and until is not None:
            yield _frame(chat.numbered(name, chat.advance(until)))

    own = _prepared(messages).filter("chat IS NOT NULL AND at IS NOT NULL").select("chat", "id", "at", "text", "vector", F.lit(1).alias("kind"), F.lit(0.0).alias("suspended"))
    if evictions is not None:
        own = own.unionByName(evictions.select("chat", F.col("number").alias("id"), "at", F.lit("").alias("text"), F.lit(None).cast(own.schema["vector"].dataType).alias("vector"), F.lit(0).alias("kind"), "suspended"))
    return own.repartition("chat").sortWithinPartitions("chat", "at", "kind", "id").mapInPandas(run, ROWS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["chat", "id", "episode", "event", "at", "step"])
    out["id"] = out["id"].astype("Int64")
    return out


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place in the order of all, from 0: numbered within ranges, plus how many the ranges before hold."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.select("_part", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def waits(events: DataFrame) -> DataFrame:
    """(chat, number, suspended, left, reopened, was): every suspension of ``events`` (ROWS), when and how it ended of itself, and when it was put out."""
    episode = W.partitionBy("chat", "episode").orderBy("step")
    moves = events.filter("event LIKE 'suspended%' OR event IN ('reopened', 'archived', 'evicted')").withColumn("next", F.lead("at").over(episode)).withColumn("how", F.lead("event").over(episode))
    out = F.coalesce(F.col("how") == "evicted", F.lit(False))
    return moves.filter("event LIKE 'suspended%'").select(
        "chat", F.col("episode").alias("number"), F.col("at").alias("suspended"), F.when(~out, F.col("next")).alias("left"), F.coalesce(F.col("how") == "reopened", F.lit(False)).alias("reopened"), F.when(out, F.col("next")).alias("was")
    )


def put_out(suspensions: DataFrame, most: int) -> DataFrame:
    """``suspensions`` (``waits``) with at: when a pool of ``most`` over all chats puts the episode out, or null.

    When a suspension makes the pool too large, the one suspended longest ago goes. So an episode
    goes with the suspension of the rank at which ``most`` later ones wait; later ones that have been
    reopened by then don't count. Where none of the next ``most`` is ever reopened that rank is known at once,
    from runs of ranks that each end with the first ``most`` of the next; else it is found step by step,
    counting the reopened ones in between. At one moment archiving comes first, then suspending and last reopening.
    """
    columns = suspensions.columns
    span = max(4096, 4 * (most + 1))
    run = F.floor(F.col("rank") / span)
    runs = F.when(F.col("rank") % span < most, F.array(run, run - 1)).otherwise(F.array(run))
    along = W.partitionBy("run").orderBy("rank")
    dealt = ranked(suspensions, ["suspended", "chat", "number"], "rank").withColumn("run", F.explode(runs))
    known = dealt.withColumn("at", F.lead("suspended", most).over(along)).withColumn("_n", F.sum(F.col("reopened").cast("long")).over(along.rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.lead("_n", most).over(along) - F.col("_n"))
    # ranks beyond the last are never reached; who has left by then isn't put out
    stays = F.expr("at IS NULL OR NOT (left IS NULL OR left > at OR left = at AND reopened)")
    rows = written(known.filter(F.col("run") == run).select(*columns, "rank", F.when(~stays, F.col("at")).alias("at"), (~stays & (F.col("_n") > 0)).alias("open")))

    moments = rows.select(F.col("rank").alias("at_rank"), F.col("suspended").alias("at"))
    width = most + 1
    gone = rows.filter("reopened").select(F.col("rank").alias("other"), F.col("left").alias("other_left")).withColumn("bucket", F.floor(F.col("other") / width))
    open_ = rows.filter("open").select("rank", "left", "reopened", (F.col("rank") + most).alias("at_rank"))
    done = []
    while not open_.isEmpty():
        timed = open_.join(moments, "at_rank").filter("left IS NULL OR left > at OR left = at AND reopened")
        bucket = F.explode(F.sequence(F.floor((F.col("rank") + 1) / width), F.floor(F.col("at_rank") / width)))
        between = timed.withColumn("bucket", bucket).join(gone, "bucket").filter("other > rank AND other <= at_rank AND other_left < at").groupBy("rank").agg(F.count("*").alias("fewer"))
        counted = written(timed.join(between, "rank", "left").withColumn("aim", F.col("rank") + most + F.coalesce("fewer", F.lit(0))))
        done.append(counted.filter("aim <= at_rank").select("rank", "at"))
        open_ = counted.filter("aim > at_rank").select("rank", "left", "reopened", F.col("aim").alias("at_rank"))
    out = rows.filter("NOT open").select(*columns, "at")
    if done:
        out = out.unionByName(rows.filter("open").drop("at").join(reduce(DataFrame.unionByName, done), "rank", "left").select(*columns, "at"))
    return out


def pooled_episodes(messages: DataFrame, rules: Rules = Rules(), until: float | None = None, rounds: int = 30) -> DataFrame:
    """``timed_episodes`` with one pool of ``rules.pool`` episodes over all chats.

    Who is put out hangs on all chats, and what a chat's messages reopen hangs on who was. Each round
    ranks all suspensions anew and runs the chats again of which others are put out than before; up to
    the first eviction that changes all is final, so that moment moves on in each round until nothing changes.
    Raises if ``rounds`` aren't enough.
    """
    none = messages.sparkSession.createDataFrame([], "chat string, number long, suspended double, at double")
    events = written(timed_episodes(messages, rules, until, none))
    suspensions = written(waits(events))
    for _ in range(rounds):
        found = put_out(suspensions, rules.pool)
        changed = written(found.filter(~F.col("at").eqNullSafe(F.col("was"))).select("chat").distinct())
        if changed.isEmpty():
            return events
        again = beside(changed)
        evictions = found.filter("at IS NOT NULL").join(again, "chat", "left_semi").select(*none.columns)
        rerun = written(timed_episodes(messages.withColumn("chat", F.col("chat").cast("string")).join(again, "chat", "left_semi"), rules, until, evictions))
        events = events.join(again, "chat", "left_anti").unionByName(rerun)
        suspensions = written(suspensions.join(again, "chat", "left_anti").unionByName(waits(rerun)))
    raise RuntimeError(f"evictions still change after {rounds} rounds")


class _Timed(StatefulProcessor):
    """Open episode, pool and count of one chat as typed state, and one timer: the next deadline."""

    EPISODE = "number long, start double, last double, n long, vectors array<array<double>>, at double"

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", self.EPISODE)
        self.pool = handle.getMapState("pool", "number long", self.EPISODE)
        self.begun = handle.getValueState("begun", "n long, steps long")

    @staticmethod
    def _plain(e: Suspended) -> tuple:
        return (e.number, e.start, e.last, e.n, [[float(x) for x in v] for v in e.vectors], e.at)

    @staticmethod
    def _loaded(row) -> Suspended:
        return Suspended(row[0], row[1], row[2], row[3], [np.asarray(v, float) for v in row[4]], row[5])

    def _chat(self) -> TimedChat:
        chat = TimedChat(self.rules)
        if self.begun.exists():
            chat.begun, chat.steps = self.begun.get()
        if self.current.exists():
            chat.open = self._loaded(self.current.get())
        chat.pool = {k[0]: self._loaded(v) for k, v in self.pool.iterator()}
        return chat

    def _keep(self, chat: TimedChat, was: dict[int, float]) -> None:
        self.begun.update((chat.begun, chat.steps))
        if chat.open is not None:
            self.current.update(self._plain(chat.open))
        elif self.current.exists():
            self.current.clear()
        for n in set(was) - set(chat.pool):
            self.pool.removeKey((n,))
        for n, e in chat.pool.items():
            if was.get(n) != e.at:
                self.pool.updateValue((n,), self._plain(e))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if (at := chat.next_timer()) is not None:
            self.handle.registerTimer(int(np.ceil(at * 1000)))

    def handleInputRows(self, key, rows, timerValues):
        chat = self._chat()
        was = {n: e.at for n, e in chat.pool.items()}
        given = pd.concat(list(rows)).sort_values(["at", "id"])
        out = [x for r in given.itertuples(index=False) for x in chat.numbered(key[0], chat.add(r.id, r.at, r.text, _vector(r.vector)))]
        self._keep(chat, was)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        chat = self._chat()
        was = {n: e.at for n, e in chat.pool.items()}
        out = chat.numbered(key[0], chat.advance(expiredTimerInfo.getExpiryTimeInMs() / 1000))
        self._keep(chat, was)
        yield _frame(out)

    def close(self) -> None:
        pass


def stream_timed_episodes(messages: DataFrame, rules: Rules = Rules(), late: str = "1 hour") -> DataFrame:
    """``timed_episodes`` of a stream: typed state by chat, and event-time timers that suspend and archive without another message.

    Set ``spark.sql.streaming.stateStore.providerClass`` to PROVIDER. Within a batch messages are put
    in order; those later than the watermark are dropped. ``rules.pool`` bounds the pool of each chat;
    for a bound over all chats see ``pooled_episodes``. The state can be read with the state data source.
    """
    source = _prepared(messages).withWatermark("ts", late)
    return source.groupBy("chat").transformWithStateInPandas(statefulProcessor=_Timed(rules), outputStructType=ROWS, outputMode="Append", timeMode="EventTime")
