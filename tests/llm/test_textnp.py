import numpy as np

from rowloom.llm import neardup, textnp, toxicity


def test_pieces_are_the_text():
    t = "ab cd\n" * 50 + "x" * 40 + " end"
    got = list(textnp.pieces(t, most=16))
    assert "".join(got) == t and all(len(p) > 16 for p in got[:-1]) and not any(p[-1].isalnum() for p in got[:-1])
    assert list(textnp.pieces("", most=4)) == [""] and list(textnp.pieces("x" * 90, most=4)) == ["x" * 90]


def test_no_word_or_sentence_is_cut(monkeypatch):
    texts = ["a" * 300 + "b" * 300, "c" * 500 + " d. " + "é" * 400, "x!" * 90]
    model = {"weights": np.linspace(0, 1, toxicity.BUCKETS, dtype=np.float32), "bias": -9.0, "prior": 0.1, "learned": True}
    words, sets, score = textnp.word_hashes(texts), neardup.shingles(texts), toxicity.score_whole(texts, model)
    for m in (textnp, toxicity):
        monkeypatch.setattr(m, "LONG", 32)
    for a, b in zip([*words, *sets], [*textnp.word_hashes(texts), *neardup.shingles(texts)]):
        assert (a == b).all()
    again = toxicity.score_whole(texts, model)
    assert np.allclose(score[0], again[0]) and score[1] == again[1]


def test_long_texts_like_short_ones(monkeypatch):
    texts = ["one two three. four five six seven eight nine ten! " * 9, "", "short one"]
    whole = neardup.shingles(texts)
    model = {"weights": np.zeros(toxicity.BUCKETS, np.float32), "bias": -2.0, "prior": 0.1, "learned": True}
    score = toxicity.score_whole(texts, model)[0]
    for m in (textnp, toxicity):
        monkeypatch.setattr(m, "LONG", 64)
    for a, b in zip(whole, neardup.shingles(texts)):
        assert (a == b).all()
    assert np.allclose(score, toxicity.score_whole(texts, model)[0])
