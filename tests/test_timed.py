"""Episodes with timers: by hand, streamed with a restart, and with one pool over all chats."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from threadloom.streaming import timed
from threadloom.streaming.episodes import Rules

SCHEMA = "chat string, id long, ts timestamp, text string, vector array<double>"
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
S0 = T0.timestamp()


def table(spark, rows):
    return spark.createDataFrame([(c, i, T0 + timedelta(seconds=s), t, v) for c, i, s, t, v in rows], SCHEMA)


def told(rows):
    return sorted((r["chat"], round(r["at"] - S0, 3), r["id"] if r["id"] is not None else -1, r["episode"], r["event"]) for r in rows)


def test_timers_and_archive_by_hand(spark):
    rules = Rules(gap=1800.0, idle=300.0, duration=1000.0, size=3, archive=5000.0)
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [("u", 1, 0, "x", a), ("u", 2, 100, "x", a), ("u", 3, 600, "x", b), ("u", 4, 700, "x", a), ("u", 5, 9000, "x", a), ("v", 6, 0, "x", None), ("v", 7, 290, "x", None), ("v", 8, 580, "by the way", None), (None, 9, 1, "x", None)]
    got = told(timed.timed_episodes(table(spark, rows), rules, S0 + 20000).collect())
    assert [x[1:] for x in got if x[0] == "u"] == [
        (0, 1, 0, "new"), (100, 2, 0, "append"), (400, -1, 0, "suspended:idle"), (600, 3, 1, "new"), (700, -1, 0, "suspended:size"), (700, -1, 1, "suspended:diversion"), (700, 4, 0, "reopened"),
        (5700, -1, 0, "archived"), (5700, -1, 1, "archived"), (9000, 5, 2, "new"), (9300, -1, 2, "suspended:idle"), (14300, -1, 2, "archived"),
    ]
    assert [x[1:] for x in got if x[0] == "v"] == [(0, 6, 0, "new"), (290, 7, 0, "append"), (580, -1, 0, "suspended:shift"), (580, 8, 1, "new"), (880, -1, 1, "suspended:idle"), (5580, -1, 0, "archived"), (5880, -1, 1, "archived")]


def messages(seed, chats, n, step):
    rng = random.Random(seed)
    rows, at = [], 0.0
    for i in range(n):
        at += rng.choice([1, 5, 30, 200, step])
        v = rng.choice([None, [1.0, 0.1], [0.1, 1.0], [-1.0, 0.3], [0.5, 0.5]])
        rows.append((f"c{rng.randrange(chats)}", i, at, rng.choice(["a", "b", "By the way c", ""]), v))
    return rows


def one_pool(rows, rules, until):
    """All chats in one loop, message by message, with one pool."""
    chats, out = {}, []

    class Chat(timed.TimedChat):
        def suspend(self, at, why):
            made = super().suspend(at, why)
            waiting = sorted((e.at, name, number) for name, c in chats.items() for number, e in c.pool.items())
            if len(waiting) > rules.pool:
                _, name, number = waiting[0]
                del chats[name].pool[number]
                out.append((name, round(at - S0, 3), -1, number, "evicted"))
            return made

    def note(name, made):
        out.extend((name, round(x[3] - S0, 3), -1 if x[0] is None else x[0], x[1], x[2]) for x in made)

    def run_timers(now):
        while due := sorted((t, name) for name, c in chats.items() if (t := c.next_timer()) is not None and t <= now):
            note(due[0][1], chats[due[0][1]].advance(due[0][0]))

    for name, i, s, text, v in sorted(rows, key=lambda r: (r[2], r[1])):
        run_timers(S0 + s)
        chat = chats.setdefault(name, Chat(rules, False))
        note(name, chat.add(i, S0 + s, text, None if v is None else np.array(v)))
    run_timers(until)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_one_pool_over_all_chats(spark, seed):
    rules = Rules(gap=100.0, size=6, archive=3000.5, pool=3)
    rows = messages(seed, 7, 160, 150)
    until = S0 + rows[-1][2] + 10000
    assert told(timed.pooled_episodes(table(spark, rows), rules, until).collect()) == one_pool(rows, rules, until)


def test_rounds_run_only_chats_of_which_others_are_put_out(spark, monkeypatch):
    rules = Rules(gap=100.0, size=1000, archive=3000.5, pool=3)
    alone = [("alone", 1000 + k, 90000.0 + 10000 * k, "a", [1.0, 0.1]) for k in range(3)]  # never put out
    rows = messages(4, 4, 40, 150) + alone
    until = S0 + alone[-1][2] + 10000
    ran, keep = [], timed.timed_episodes
    monkeypatch.setattr(timed, "timed_episodes", lambda m, *more: (ran.append({r[0] for r in m.select("chat").distinct().collect()}), keep(m, *more))[1])
    got = told(timed.pooled_episodes(table(spark, rows), rules, until).collect())
    assert got == one_pool(rows, rules, until) and "evicted" in {x[4] for x in got}
    assert len(ran) > 1 and "alone" in ran[0] and not any("alone" in r for r in ran[1:])


def test_a_restarted_stream_equals_the_table(spark, tmp_path):
    rules = Rules(gap=100.0, idle=80.0, duration=900.0, size=6, archive=3000.0, pool=2)
    rows = messages(3, 4, 120, 400)
    parts = [rows[:40], rows[40:80], rows[80:]]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timed.PROVIDER)
    try:
        for k, part in enumerate(parts):  # a query of its own for each part: the second and third go on from the state on disk
            table(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            out = timed.stream_timed_episodes(stream, rules, "1 second")
            query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
            assert query.awaitTermination(240) and query.exception() is None
        got = told(spark.read.schema(timed.ROWS).parquet(str(tmp_path / "out")).collect())
        watermark = S0 + rows[-1][2] - 1
        want = told(timed.timed_episodes(table(spark, rows), rules, watermark).collect())
        assert [x for x in got if x[1] + S0 <= watermark] == [x for x in want if x[1] + S0 <= watermark]
        assert {x[4] for x in got} >= {"archived", "suspended:idle", "evicted", "reopened"}
        open_ = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "begun").load()
        assert open_.count() == len({r[0] for r in rows})
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
