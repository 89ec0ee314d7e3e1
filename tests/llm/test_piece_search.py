"""Pieces that a text does not hold are searched for once, not for an end as well."""

import numpy as np

from larder.llm.pieces import SPACE, Model, Searcher


def test_absent_pieces_have_no_second_search(monkeypatch):
    names = ["", "ab", "abc", "abd", "abe", SPACE + "a", "zz", "b"]
    searcher = Searcher(Model(names, np.arange(len(names), 0, -1).astype(float), 0, 0, False))
    text = np.array([ord(c) + 1 for c in "abc abc ab"], "u4")
    order, ends = searcher.suffix_array(text), []
    before = Searcher._before

    def counted(self, padded, at, piece, upper):
        if upper:
            ends.extend(piece.tolist())
        return before(self, padded, at, piece, upper)

    monkeypatch.setattr(Searcher, "_before", counted)
    first, end = searcher.ranges(text, order)
    assert (end - first).tolist() == [3, 2, 0, 0, 2, 0, 3]
    assert all(ends.count(i) <= 1 for i in (2, 3, 5)) and ends.count(0) > 1
    assert sorted(order[first[1]:end[1]].tolist()) == [0, 4]
