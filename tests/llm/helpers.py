"""Small tables with every awkward case, and brute-force twins."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, digest string, n_words int, label string, ord string"
#: Names that operators use for columns of their own or give to their results.
NAMES = """_row row _whole whole _rest rest _last last _before before _cut cut _key key _bucket bucket _begin begin _digest gone _gone bad _bad h tokens supply
weight capacity budget level held r begun lang_pred score best top norm letter component first first_id kept by_words _by_words shard slot part law curve_index
anchor at passage n tasks wide item_id containment value is_secret f_length stretch place piece own starts""".split()


def clashing(spark, rows):
    """A table of documents (doc_id, text, lang, source) with a column of each of NAMES, of a value of its own in each row."""
    columns = ["doc_id", "text", "lang", "source", *NAMES]
    data = [(*r[:4], *[f"{name} {i}" for name in NAMES]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in columns)).repartition(3)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def awkward_rows(seed=3):
    """Nulls, empty and very long texts, ties, repeated rows, copies, near copies and shared passages."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    passage = prose(rng, 30)
    texts = [base, base, base + " end", prose(rng, 40) + " " + passage + " " + prose(rng, 40), passage, prose(rng, 60) + "\n" + passage, None, "", "   \n\t ", "one", "one two three four", "one two three four", "a b c d e", "A B c D e", prose(rng, 9000), "rep rep " * 300, prose(rng, 13), "x\x1cy \x85z q é", base.replace("w1", "w2", 3)]
    for _ in range(30):
        near = base.split()
        for _ in range(rng.randrange(1, 6)):
            near[rng.randrange(len(near))] = f"n{rng.randrange(999)}"
        texts.append(" ".join(near))
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"src{i % 3}", 0, 7, "clash", 9, "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3]]  # repeated rows
    rows.append((None, base, "en", "src1", 0, 7, "clash", 9, "clash", "clash"))
    rng.shuffle(rows)
    return rows


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS).repartition(5)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def order(doc_id):
    return (1 << 63) - 1 if doc_id is None else doc_id


def shingles(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
