import random

from listingflow.llm import common, simhash


def test_stretches_keep_words_whole():
    draw = random.Random(1)
    for _ in range(500):
        text = "".join(draw.choice("ab \n\té") for _ in range(draw.randint(0, 60))).encode()
        for size in (1, 3, 10, 1_000):
            parts = list(common.stretches(text, size))
            assert b"".join(parts) == text
            assert [w for p in parts for w in p.split()] == text.split()


def test_a_fingerprint_does_not_depend_on_stretches(monkeypatch):
    draw = random.Random(2)
    texts = [" ".join(draw.choice(["a", "bc", "d", "éf"]) for _ in range(n)).encode() for n in (0, 1, 2, 3, 4, 50, 333)]
    whole = [simhash.fingerprint(t) for t in texts]
    for size in (1, 7, 64):
        monkeypatch.setattr(common, "STRETCH_BYTES", size)
        assert [simhash.fingerprint(t) for t in texts] == whole
