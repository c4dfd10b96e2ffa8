"""Words of any length are counted alike before, behind and without a period."""

import numpy as np

from pagewright.llm import sentences


def test_long_words_are_counted_alike():
    for word in ("Geschwindigkeitsmesser", "достопримечательность"):
        assert sentences._features(word)[1] == sentences._features(word)[3] == word.lower() and sentences._features(word + ".")[:2] == ("dot", word.lower())
    clause = "没有人知道是谁把旧地图留在盒子里的"
    assert sentences._features(clause)[1] == sentences._features(clause)[3] == ""


class Known:
    langs = ["de"]

    def token_scores(self, toks):
        return np.zeros((len(toks), 1))


def test_long_inner_words_have_plain_counts():
    seen = sentences._observe(iter(["Der Geschwindigkeitsmesser steht. Geschwindigkeitsmesser sind alt."]), Known())
    counts = {(r.kind, r.a, r.b): r.n for r in seen.itertuples()}
    assert counts[("plain", "geschwindigkeitsmesser", "")] == 2 and counts[("after", "steht", "geschwindigkeitsmesser")] == 1
