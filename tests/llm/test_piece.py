import hashlib
import random

import pytest
import sentencepiece

from larder.llm import piece
from larder.llm.queries import PIECE_MODEL, tokenizer_path
from tests.llm.helpers import DOCS, awkward, documents

PATH = tokenizer_path(PIECE_MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def mine():
    return piece.Pieces(piece.read_model(PATH))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(docs, library):
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "")
        want.append((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))))
    assert sorted(map(tuple, piece.piece_digests(docs, PATH).collect()), key=str) == sorted(want, key=str)


def test_documents(spark, library):
    check(documents(spark), library)


def test_awkward_and_empty(spark, library):
    check(awkward(spark), library)
    assert piece.piece_digests(spark.createDataFrame([], DOCS), PATH).collect() == []


def same(mine, library, text):
    ids = library.encode(text)
    assert mine.encode(text) == ",".join(map(str, ids)), text
    assert mine.decode(mine.encode(text)) == library.decode(ids), text


def test_random_strings_against_the_library(mine, library):
    rng, known = random.Random(4), [p for p, _, kind in mine.vocabulary.pieces if kind == piece.NORMAL]
    odd = ["😀", " ", "\n", "é", "́", "\x00", "<0x41>", "<s>", "</s>", "<unk>", "\t", "ſ", "𐍈", "中", "▁", "  "]
    for _ in range(6000):
        same(mine, library, "".join(rng.choice(known)[: rng.randint(1, 9)].replace("▁", " ") if rng.random() < 0.8 else rng.choice(odd) for _ in range(rng.randint(0, 14))))


@pytest.mark.parametrize("n", [1, 2, 3, 15, 16, 17, 31, 46, 100])
def test_repeats(mine, library, n):
    for text in (" " * n, " " * n + "the", "a" + " " * n + "b", "a" * n, "ab" * n, "\n" * n, "0" * n, "é" * n, "--" * n, "▁" * n + "x", "ΑΒ" * n):
        same(mine, library, text)


def test_windows_of_a_long_chunk(mine, library, monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choices("aeinrst", k=400)) for _ in range(20)] + ["ab" * 300]
    want = [mine.split(t) for t in texts]
    monkeypatch.setattr(piece, "WINDOW", 7)
    assert [mine.split(t) for t in texts] == want
    for t in texts:
        same(mine, library, t)


def test_full_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(piece, "CACHE_BYTES", 3000)
    monkeypatch.setattr(piece, "JUDGED", 10)
    small, rng = piece.Pieces(piece.read_model(PATH)), random.Random(9)
    for _ in range(200):
        same(small, library, " ".join("".join(rng.choices("aeinorst", k=rng.randint(1, 9))) for _ in range(30)))


def test_chunks_end_where_no_piece_goes_over():
    cut = piece.chunk_pattern(["▁a", "ab", "▁", ".", "..", "▁▁", "x"])
    assert cut.findall("▁▁aba..x▁.xx▁") == ["▁▁aba", "..", "x", "▁.", "x", "x", "▁"]
    assert piece.chunk_pattern(["a▁b"]).findall("a▁b c\n") == ["a▁b c\n"]


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    for change in (lambda m: setattr(m.trainer_spec, "byte_fallback", False), lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), lambda m: setattr(m.trainer_spec, "model_type", 1)):
        m = sentencepiece_model_pb2.ModelProto()
        with open(PATH, "rb") as f:
            m.ParseFromString(f.read())
        change(m)
        (tmp_path / "m").write_bytes(m.SerializeToString())
        with pytest.raises(ValueError):
            piece.read_model(str(tmp_path / "m"))
