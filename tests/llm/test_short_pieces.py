"""Pieces looked up together, by their bytes."""

import numpy as np
import public_tokenizers

from sparkloom.llm.common import PieceEncoder, _ShortPieces

TEXTS = ["a a\0 a\0\0 \0  The the THE, the, ofthese ofthesethings1 ofthesethings12 ofthesethings13", "", None, " ", "été 東京タワー " * 3, "it's a\nb " + "q" * 40]


def _encoder():
    return PieceEncoder(public_tokenizers.path("word_bpe_49k.json"), False)


def _by_library(encoder, texts):
    return [np.array(e.ids, "<u4").tobytes() for e in encoder.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_equal_the_library_whatever_is_kept(monkeypatch):
    for most, block in ((700_000, 1 << 18), (6, 3), (1, 1)):
        monkeypatch.setattr(PieceEncoder, "MOST_SHORT", most)
        monkeypatch.setattr(PieceEncoder, "BLOCK", block)
        encoder = _encoder()
        for _ in range(3):
            assert encoder.encode(TEXTS) == _by_library(encoder, TEXTS)
        assert len(encoder.short) <= most + len(TEXTS[0]) + 1


def test_places_that_clash(monkeypatch):
    monkeypatch.setattr(_ShortPieces, "BITS", 2)
    encoder = _encoder()
    for _ in range(2):
        assert encoder.encode(TEXTS) == _by_library(encoder, TEXTS)


def test_short_pieces_are_encoded_once_and_kept_if_met_again(monkeypatch):
    encoder = _encoder()
    encoder.encode(["once, twice, some\nthing"])
    calls, piece = [], PieceEncoder._piece
    monkeypatch.setattr(PieceEncoder, "_piece", lambda self, p, lead: calls.append(p) or piece(self, p, lead))
    encoder.encode(["twice, twice, some\nthing"])
    assert not calls
    encoder.short = encoder.short.kept()
    encoder.encode(["twice, some\nthing"])
    assert not calls
    encoder.encode(["once,"])
    assert calls[0] == "once,"
