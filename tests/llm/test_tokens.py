import random

import numpy as np
import pyarrow as pa

from threadloom.llm import language, tokens


def hashes(texts):
    return [h for _, w in tokens.chunks(pa.array(texts)) for h in w.hashes().tolist()]


def test_words_of_one_set_of_letters_dont_collide():
    # two words whose polynomials agree modulo 2**64 in any base
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    b = a.translate(str.maketrans("ab", "ba"))
    for n in (8, 64, 1000, 2048, 4096):
        assert len(set(hashes([f"{a[:n]} {b[:n]}"]))) == 2


def test_a_hash_depends_on_the_word_alone():
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abcdé", k=rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 40, 2000]))) for _ in range(3000)})
    once = hashes([" ".join(words)])
    assert len(set(once)) == len(words)
    rng2 = list(enumerate(words))
    rng.shuffle(rng2)
    again = hashes([w for _, w in rng2])
    assert [once[i] for i, _ in rng2] == again
    assert hashes(["\n".join(words) + " "]) == once


def test_a_text_of_fifty_megabytes():
    text = b"some words of a very long text \n" * 1_600_000
    (_, w), = tokens.chunks(pa.array([text], pa.binary()))
    assert len(w.begin) == 7 * 1_600_000 and len(np.unique(w.hashes())) == 7
    grams = 0
    for row, rows, pieces in language._pieces(pa.array([text], pa.binary())):
        assert (row, rows) == (0, 1)
        for bucket, bounds in pieces:
            assert len(bucket) <= language._PIECE and bounds[-1] == len(bucket)
            grams += len(bucket)
    assert grams == 3 * len(text) - 1 - 2 - 3
