"""The encoder's lanes: many strings in step, windows that commit where paths meet, pairs of pieces by undoing merges."""

import random

import numpy as np
import pytest

from silvaframe.llm import pieces


@pytest.fixture(scope="module")
def model():
    with open(pieces.MODEL, "rb") as f:
        return f.read()


def test_pairs_by_undoing_merges_equal_merging(model):
    p = pieces.Pieces(model)
    rng = random.Random(4)
    ids = list(p.ids.values())
    a, b = (np.array([rng.choice(ids) for _ in range(4000)], np.int32) for _ in range(2))
    assert p._apart(a, b).tolist() == [p.compatible(p.names[x], p.names[y]) for x, y in zip(a, b)]


@pytest.mark.parametrize("lanes", [1, 10_000])
def test_many_windows(model, monkeypatch, lanes):
    """Long strings without a space, in step (lanes 1) and alone (lanes 10,000), equal the library's."""
    import sentencepiece

    monkeypatch.setattr(pieces, "LANES", lanes)
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    p = pieces.Pieces(model)
    rng = random.Random(6)
    texts = ["".join(rng.choice(kind) for _ in range(rng.randint(1, 600))) for kind in ("etaoinshr", "ab", "=-", "日本語の", "é́a") for _ in range(12)]
    texts += ["x" * 3000, "🙂" * 200, "word " * 400, None, ""]
    got = p.encode_many(texts)
    assert [np.frombuffer(x, np.int32).tolist() for x in got] == [sp.encode(t) if t else [] for t in texts]
    again = p.encode_many(texts)
    assert again == got


def test_remembering_changes_nothing(model, monkeypatch):
    p = pieces.Pieces(model)
    texts = [" ".join(f"w{k * j % 97}ord" for k in range(30)) for j in range(40)]
    want = p.encode_many(texts)
    monkeypatch.setattr(pieces, "REMEMBERED", 10)
    monkeypatch.setattr(pieces, "PAIRS", 16)
    q = pieces.Pieces(model)
    assert [q.encode_many([t])[0] for t in texts] == want
    assert [q.encode_many([t])[0] for t in texts[::-1]] == want[::-1]


def test_other_normalisers_are_refused(model):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    proto.normalizer_spec.add_dummy_prefix = False
    with pytest.raises(ValueError):
        pieces.Pieces(proto.SerializeToString())
    proto.ParseFromString(model)
    proto.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        pieces.Pieces(proto.SerializeToString())


def test_without_byte_pieces_a_run_of_unknown_characters_is_one(model):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    proto.trainer_spec.byte_fallback = False
    for piece in proto.pieces:
        if piece.type == 6:
            piece.type = 5
    data = proto.SerializeToString()
    sp, p = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Pieces(data)
    for t in ("a🙂🙃b", "🙂", "x 🙂🙃 🙂 y🙂"):
        assert p.encode(t) == sp.encode(t), t
