import hashlib
import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from threadloom.llm import pieces, queries
from tests.llm.helpers import awkward, awkward_rows, clashing, empty


@pytest.fixture(scope="module")
def vocabulary():
    with open(pieces.MODEL, "rb") as file:
        return pieces.Vocabulary(file.read())


def odd_texts(seed=1):
    rng = random.Random(seed)
    texts = ["", "a", " ", "  a  b", "\0x", "▁▁x ▁", "日本語のテキストです。漢字" * 30, "a" * 5000, "ab" * 3000, " " * 1000, "☃☃ é́ 🎉🎉", "<s></s><0x41>", "x" * 41 + " y", "\n\t\r\n", "ﬁ Ａ"]
    texts += ["".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(3000)), "".join(chr(rng.choice([rng.randrange(32, 128), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(3000))]
    return texts + ["".join(rng.choice("abc de▁th ") for _ in range(rng.randrange(80))) for _ in range(2000)]


def test_as_the_library(vocabulary):
    texts = odd_texts()
    ids = [x.tolist() for x in vocabulary.encode(texts)]
    assert ids == vocabulary.library.encode(texts)
    assert [vocabulary.decode(x) for x in ids] == vocabulary.library.decode(ids)


def test_agenda_lockstep_and_pieces_agree(vocabulary):
    rng = random.Random(2)
    words = ["▁" + "".join(rng.choice("etaoin shrdlu▁") for _ in range(rng.randrange(1, pieces.LOCKSTEP))) for _ in range(3000)]
    assert vocabulary.lockstep(words) == [vocabulary.agenda(w) for w in words]


def test_decoding_of_any_ids(vocabulary):
    rng = random.Random(3)
    some = lambda: rng.choice([0, 1, 2, 259, 28705, rng.randrange(3, 259), rng.randrange(3, 259), rng.randrange(32000)])
    for _ in range(5000):
        ids = [some() for _ in range(rng.randrange(12))]
        assert vocabulary.decode(ids) == vocabulary.library.decode(ids)


def other_model(**changes):
    """A small vocabulary with ties, without bytes, made by hand."""
    model = sentencepiece_model_pb2.ModelProto()
    model.trainer_spec.model_type = 2
    model.normalizer_spec.name = "identity"
    for k, v in changes.items():
        setattr(model.normalizer_spec, k, v)
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("ab", -1, 1), ("bc", -1, 1), ("abc", -0.5, 1), ("b▁a", -2, 1), ("aa", -3, 1), ("aaa", -3, 1), ("a", -9, 1), ("b", -9, 1), ("▁", -9, 1), ("zq", -4, 1)]:
        model.pieces.add(piece=piece, score=score, type=kind)
    return model.SerializeToString()


@pytest.mark.parametrize("changes", [{"add_dummy_prefix": True, "remove_extra_whitespaces": False}, {"add_dummy_prefix": False, "remove_extra_whitespaces": False}, {"add_dummy_prefix": True, "remove_extra_whitespaces": True}])
def test_other_vocabularies(changes):
    model = other_model(**changes)
    library, own, rng = sentencepiece.SentencePieceProcessor(model_proto=model), None, random.Random(4)
    own = pieces.Vocabulary(model)
    assert not own.words and not own.by_bytes
    texts = ["".join(rng.choice("abcazq  ☃") for _ in range(rng.randrange(90))) for _ in range(3000)]
    ids = [x.tolist() for x in own.encode(texts)]
    assert ids == library.encode(texts)
    assert [own.decode(x) for x in ids] == library.decode(ids)


def test_a_difference_from_the_library_raises(vocabulary, monkeypatch):
    monkeypatch.setattr(vocabulary, "lockstep", lambda segments: [b"\1\0\0\0"] * len(segments))
    with pytest.raises(ValueError, match="the library encodes"):
        vocabulary.encode(["never seen words qqq"])


def test_tables(spark, vocabulary):
    rows = {r["doc_id"]: r for r in pieces.decode(pieces.encode(awkward(spark))).collect()}
    given = awkward_rows()
    assert pieces.encode(awkward(spark)).count() == len(given)
    for doc_id, text, *_ in given:
        assert rows[doc_id]["ids"] == vocabulary.library.encode(text or "") and rows[doc_id]["decoded"] == (text or "")
    assert pieces.decode(pieces.encode(empty(spark))).collect() == []
    assert pieces.encode(clashing(spark, given[:20]), id_column="doc_id").columns == ["doc_id", "ids"]
    some = spark.createDataFrame([(1, None), (2, [None, 259, None]), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in pieces.decode(some).collect()} == {1: "", 2: vocabulary.library.decode([259]), 3: ""}


def test_the_query(spark, vocabulary):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = queries.op11_sentencepiece(spark, folder).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(found) == len(texts)
    for r in found:
        ids = vocabulary.library.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(",".join(map(str, ids))), digest(vocabulary.library.decode(ids)))
