"""Texts cut where their language has its seams, from coarse to fine."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seams of each language, the coarsest first, as patterns before whose match (an empty one) or behind whose match a text may be cut.
SEAMS = {
    "text": [r"\n\s*\n", r"\n", r"(?<=[.!?。！？])\s+|(?<=[。！？])", r"[,;:，；：]\s*", r"\s+"],
    "markdown": [r"(?m)^(?=# )", r"(?m)^(?=## )", r"(?m)^(?=#{3,6} )", r"(?m)^(?=```)", r"\n\s*\n", r"(?m)^(?=\s*(?:[-*+]|\d+\.) )", r"\n", r"(?<=[.!?。！？])\s+|(?<=[。！？])", r"\s+"],
    "python": [r"(?m)^(?=(?:class|def|async def)\b|@)", r"(?m)^(?=[ \t]+(?:(?:def|async def)\b|@))", r"\n\s*\n", r"\n", r"\s+"],
    "go": [r"(?m)^(?=(?:func|type|var|const)\b)", r"\n\s*\n", r"\n", r"\s+"],
    "javascript": [r"(?m)^(?=(?:export|function|class|const|let|var|async)\b)", r"\n\s*\n", r"\n", r";\s*", r"\s+"],
    "java": [r"(?m)^(?=(?:public|private|protected|class|interface|enum)\b|@)", r"(?m)^(?=[ \t]+(?:(?:public|private|protected)\b|@))", r"\n\s*\n", r"\n", r";\s*", r"\s+"],
}
_COMPILED = {k: [re.compile(p) for p in v] for k, v in SEAMS.items()}


def cuts(text: str, language: str | None, size: int) -> list[int]:
    """Where a text is cut, its end included, so that no piece is longer than ``size``.

    A stretch that is too long is cut at all seams of a level; the stretches between them are put
    together again, from the left, while they fit, and those still too long go to the next level.
    Beyond the last one, a stretch is cut every ``size`` characters. The stretches that wait
    are on a stack, so nesting isn't bounded by the language's depth of calls.
    """
    seams = _COMPILED.get(language or "", _COMPILED["text"])
    done, stack = [], [(0, len(text), 0)]
    while stack:
        a, b, level = stack.pop()
        if b - a <= size:
            done.append(b)
            continue
        if level == len(seams):
            done += [*range(a + size, b, size), b]
            continue
        ends = [m.end() for m in seams[level].finditer(text, a, b) if a < m.end() < b] + [b]
        joined, start, last = [], a, a
        for end in ends:
            if end - start > size and last > start:
                joined.append((start, last))
                start = last
            if end - start > size:
                joined.append((start, end))
                start = end
            last = end
        if last > start:
            joined.append((start, last))
        stack += [(x, y, level + 1) for x, y in reversed(joined)]
    return done


def split_texts(rows: DataFrame, id_col: str, text: str, language: str | None = None, size: int = 512, overlap: int = 0, whole: int = 1024) -> DataFrame:
    """(id_col, place, begin, end, content) of the pieces of every row's text, in order.

    Without overlap the pieces join to the text. With it a piece begins up to ``overlap``
    characters earlier, but at the first. ``language``: a column with the name of a language, or
    null for plain text. Texts under ``whole`` characters stay one piece; a null text has none, an empty
    one has an empty piece.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    given = rows.select(F.col(id_col).alias("id"), F.col(text).alias("text"), (F.col(language) if language else F.lit(None).cast("string")).alias("language")).filter("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                t, name = batch.column(1)[row].as_py(), batch.column(2)[row].as_py()
                ends = [len(t)] if len(t) < whole else cuts(t, name, size)
                begins = [0, *ends[:-1]]
                begins = [max(0, b - overlap) for b in begins]
                ids = batch.column(0).take(pa.array([row] * len(ends)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(range(len(ends)), pa.int64()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64()), pa.array([t[b:e] for b, e in zip(begins, ends, strict=True)], pa.string())], ["id", "place", "begin", "end", "content"])

    return given.mapInArrow(run, f"id {kind}, place long, begin long, end long, content string").withColumnRenamed("id", id_col)
