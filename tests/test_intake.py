"""New decisions one at a time, in plain Python, against the waves."""

import random

import pytest

from threadloom.functions import status as S
from threadloom.operators import intake

NEW = "seq long, sid string, project string, topic string, title string, summary string, full_text string, status string, impact_level string, confidence double, tags array<string>"
OLD = NEW.replace("seq long", "ord long, version long")
WORDS = ["use", "grpc", "redis", "cache", "deploy", "friday", "Use", "GRPC", "queue", "zzz", "plan b", "q"]


def similarity(a, b, clear):
    a, b = (x.strip().lower() if clear else x for x in (a or "", b or ""))
    x, y = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (a, b))
    return len(x & y) / len(x | y) if x and y else 0.0


def one_at_a_time(new, existing, verdicts, near=0.15, sure=0.65):
    state = {r["sid"]: dict(r, note="") for r in sorted(existing, key=lambda r: r["ord"])}
    said, outcomes, conflicts = {}, {}, set()
    for v in verdicts:
        if v[2] in ("skip", "update", "conflict"):
            said[v[0], v[1]] = max(said.get((v[0], v[1]), ("", "")), (v[2], v[3] or ""))
    top = max((r["ord"] for r in existing), default=0)
    for row in sorted(new, key=lambda r: r["seq"]):
        row = {k: v if v is not None else ([] if k == "tags" else 0.0 if k == "confidence" else "") for k, v in row.items()}
        sid, target, info, against, dropped = row["sid"], None, "", [], False
        if sid in state:
            outcome, target = "updated", sid
        else:
            mine = [e for e in sorted(state.values(), key=lambda e: e["ord"]) if e["topic"] == row["topic"] and row["topic"]]
            sim = next((e for e in mine if e["status"] in S.ACTIVE and e["project"] == row["project"] and similarity(row["summary"], e["summary"], False) >= near), None)
            if sim is not None:
                action, word = said.get((sid, sim["sid"]), ("", ""))
                if similarity(row["summary"], sim["summary"], False) >= sure:
                    target = sim["sid"]
                elif action == "skip":
                    dropped = True
                elif action == "update":
                    target, info = sim["sid"], word
                elif action == "conflict":
                    against.append(sim["sid"])
            for e in mine if not dropped else []:
                if e["sid"] == target or e is sim:
                    continue
                if similarity(row["summary"], e["summary"], True) < near and similarity(row["full_text"], e["full_text"], True) < near:
                    continue
                action, word = said.get((sid, e["sid"]), ("", ""))
                if action == "skip":
                    dropped = True
                    break
                if action == "update":
                    target, info = e["sid"], word or info
                    break
                if action == "conflict":
                    against.append(e["sid"])
            outcome = "dropped" if dropped else "merged" if target else "created"
        outcomes[row["seq"]] = (sid, outcome, target if outcome == "merged" else sid)
        if outcome == "dropped":
            continue
        conflicts |= {p for e in against for p in ((outcomes[row["seq"]][2], e), (e, outcomes[row["seq"]][2]))}
        title = row["title"] or row["summary"]
        if outcome == "created":
            state[sid] = dict(row, ord=top + 1 + row["seq"], version=1, title=title, note="", status=row["status"] or "pending")
            continue
        e = state[target]
        e["version"] += 1
        for k, v in (("title", title), ("summary", row["summary"]), ("impact_level", row["impact_level"])):
            e[k] = v or e[k]
        if row["full_text"] or info:
            e["full_text"], e["note"] = row["full_text"], info
        e["confidence"] = max(e["confidence"], row["confidence"]) if outcome == "merged" else row["confidence"]
        e["tags"] = sorted({*e["tags"], *row["tags"]}) if outcome == "merged" else row["tags"] or e["tags"]
    for e in state.values():
        if e["note"] and e["note"] not in e["full_text"]:
            e["full_text"] += intake.SUPPLEMENT + e["note"]
    return state, outcomes, conflicts


def case(seed, n_old, n_new, topics):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(WORDS) + str(rng.randrange(30)) * rng.randrange(2) for _ in range(k))
    common = lambda: {"project": rng.choice(["p", "p", "r"]), "topic": rng.choice(topics), "title": rng.choice(["", "t1", None]), "summary": rng.choice([text(3), text(2), text(1), "", None]), "full_text": rng.choice([text(5), "", None]), "status": rng.choice(["decided", "pending", "superseded"]), "impact_level": rng.choice(["major", "minor", ""]), "confidence": rng.choice([0.5, 0.25, None]), "tags": rng.choice([["x"], ["y", "z"], [], None])}
    old = [{"ord": i, "version": rng.randrange(1, 4), "sid": f"d{i}", **common()} for i in range(n_old)]
    for r in old:
        r.update({k: r[k] if r[k] is not None else ([] if k == "tags" else 0.0 if k == "confidence" else "") for k in r})
    new = [{"seq": i, "sid": rng.choice([f"n{i}"] * 4 + [f"d{rng.randrange(n_old + 2)}", f"n{rng.randrange(n_new)}"]), **common()} for i in range(n_new)]
    sids = [r["sid"] for r in old + new]
    verdicts = [(r["sid"], rng.choice(sids), rng.choice(["skip", "skip", "update", "conflict", "conflict", "create_new"]), rng.choice(["", "more", None])) for r in new for _ in range(25)]
    return new, old, verdicts


@pytest.mark.parametrize(("seed", "n_old", "n_new", "topics"), [(1, 30, 25, ["a", "b", "c", ""]), (2, 12, 18, ["a", "b"])])
def test_waves_do_what_one_at_a_time_does(spark, seed, n_old, n_new, topics):
    new, old, verdicts = case(seed, n_old, n_new, topics)
    frame = lambda rows, schema: spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema).repartition(3)
    got = intake.take_in(frame(new, NEW), frame(old, OLD), spark.createDataFrame(verdicts, "sid string, other string, action string, info string"))
    state, outcomes, conflicts = one_at_a_time(new, old, verdicts)
    rows = got.outcomes.collect()
    assert {r["seq"]: (r["sid"], r["outcome"], r["target"]) for r in rows} == outcomes
    assert {v[1] for v in outcomes.values()} == {"updated", "merged", "dropped", "created"} and max(r["wave"] for r in rows) > 0
    assert {(r["sid"], r["other"]) for r in got.conflicts.collect()} == conflicts
    found = {r["sid"]: r.asDict() for r in got.decisions.collect()}
    assert set(found) == set(state)
    for sid, want in state.items():
        mine = found[sid]
        assert {k: sorted(mine[k]) if k == "tags" else mine[k] for k in mine} == {k: sorted(want[k]) if k == "tags" else want[k] for k in mine}, sid


def test_nothing_new(spark):
    old = spark.createDataFrame([(0, 1, "d", "p", "a", "", "s s", "", "decided", "", 0.5, [])], OLD)
    none = spark.createDataFrame([], "sid string, other string, action string, info string")
    got = intake.take_in(spark.createDataFrame([], NEW), old, none)
    assert got.decisions.count() == 1 and got.outcomes.count() == 0 and got.conflicts.count() == 0
    got = intake.take_in(spark.createDataFrame([(0, "n", "p", "a", None, "s s", None, None, None, None, None)], NEW), spark.createDataFrame([], OLD), none)
    assert [(r["sid"], r["version"], r["title"], r["status"]) for r in got.decisions.collect()] == [("n", 1, "s s", "pending")]
