"""Splitting by seams and JSON of unknown shape, against plain Python."""

import json
import random
from datetime import datetime, timezone

from threadloom.operators import documents_json, splitting


def recursive(text, seams, size):
    """Pieces by recursion over strings."""
    if len(text) <= size:
        return [text]
    if not seams:
        return [text[i : i + size] for i in range(0, len(text), size)]
    ends = [m.end() for m in seams[0].finditer(text) if 0 < m.end() < len(text)]
    parts = [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True)]
    out, held = [], ""
    for p in parts:
        if held and len(held + p) > size:
            out.append(held)
            held = ""
        held += p
        if len(held) > size:
            out += recursive(held, seams[1:], size)
            held = ""
    return out + ([held] if held else [])


def test_pieces_join_and_equal_a_recursion():
    rng = random.Random(5)
    words = ["# Head\n", "## Sub\n", "word ", "sentence. ", "\n\n", "\n", "- item\n", "```\ncode\n```\n", "def f():\n", "    return 1\n", "class A:\n", "句子。", "x" * 70, "func main() {}\n", "; "]
    for k in range(300):
        text = "".join(rng.choices(words, k=rng.randrange(1, 120)))
        language = rng.choice([*splitting.SEAMS, None, "unknown"])
        size = rng.choice([20, 60, 200])
        ends = splitting.cuts(text, language, size)
        pieces = [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        assert "".join(pieces) == text and max(map(len, pieces)) <= size and ends[-1] == len(text)
        # a lookbehind at a stretch's first character sees what stands before it, which a string cut out doesn't have
        if language in ("go", "python") and "。" not in text:
            assert pieces == recursive(text, splitting._COMPILED[language], size)


def test_split_tables(spark):
    rows = [(1, "a b " * 400, None), (2, None, None), (3, "", None), (4, "short", "markdown"), (None, "# A\n" + "text. " * 300 + "\n# B\n" + "y " * 300, "markdown")]
    found = splitting.split_texts(spark.createDataFrame(rows, "id long, text string, lang string"), "id", "text", "lang", 512).collect()
    by = {}
    for r in sorted(found, key=lambda r: r["place"]):
        by.setdefault(r["id"], []).append(r)
    assert set(by) == {1, 3, 4, None} and len(by[3]) == len(by[4]) == 1
    for i, text, _ in rows:
        if text is not None:
            assert "".join(r["content"] for r in by[i]) == text
            assert all(text[r["begin"] : r["end"]] == r["content"] for r in by[i])
    assert any(r["content"].startswith("# B") for r in by[None])
    overlapped = splitting.split_texts(spark.createDataFrame(rows[:1], "id long, text string, lang string"), "id", "text", "lang", 512, 64).orderBy("place").collect()
    assert [r["begin"] for r in overlapped][1:] == [r["begin"] - 64 for r in by[1]][1:]


def walk(v, path="$", field=""):
    if isinstance(v, dict) and v:
        return [x for k, y in v.items() for x in walk(y, f"{path}.{k}", k)]
    if isinstance(v, list) and v:
        return [x for i, y in enumerate(v) for x in walk(y, f"{path}[{i}]", field)]
    return [(path, field, v)]


def test_leaves(spark):
    docs = [
        {"created_at": "2024-01-02T03:04:05", "a": {"b": [1, {"updateTime": "2024-05-06T07:08:09Z", "note": "2024-01-01T00:00:00"}]}, "n": None, "e": {}, "l": [], "v": [None, None]},
        {"timeline": "2024-01-02T03:04:05", "joinTime": "soon", "seen_at": ["2023-12-31T23:59:59", 7], "deep": [[[{"x": True}]]], "f": 1.5},
        [1, "two"], 5, {},
    ]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(10, "{broken"), (11, None), (12, "")]
    got = documents_json.leaves(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()
    want = {(i, p, f) for i, d in enumerate(docs) for p, f, _ in walk(d)}
    assert {(r["id"], r["path"], r["field"]) for r in got if r["error"] is None} == want
    assert {r["id"] for r in got if r["error"] is not None} == {10, 12}
    times = {(r["id"], r["path"]): r["at"].replace(tzinfo=timezone.utc) for r in got if r["at"] is not None}
    assert times == {(0, "$.created_at"): datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc), (0, "$.a.b[1].updateTime"): datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc), (1, "$.seen_at[0]"): datetime(2023, 12, 31, 23, 59, 59, tzinfo=timezone.utc)}
    values = {(r["id"], r["path"]): r["value"] for r in got}
    assert values[0, "$.a.b[0]"] == "1" and values[1, "$.deep[0][0][0].x"] == "true" and values[0, "$.n"] is None
