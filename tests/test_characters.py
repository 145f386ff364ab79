"""Rules on single characters, over Arrow arrays of many lines at once."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc

from palimpsest.operators import spans as S
from palimpsest.plans import spans as P


def test_characters_of_many_lines_at_once(monkeypatch):
    """Nulls, empty lines, clusters and several runs of lines: as the rules say, line by line."""
    monkeypatch.setattr(S, "AT_ONCE", 10)
    texts = pa.array(["x", None, "", "abcdefghijklmno", "é☀\U0001F600•!", "abcdefg hi"]).slice(1)
    x0 = pa.array([1.0, 5.0, 5.0, 5.0, 5.0, 5.0]).slice(1)
    parts = [P.chars(texts[s], x0[s]) for s in S.lines_at_once(pc.utf8_length(texts))]
    assert [len(p) for p in parts] == [2, 1, 1, 1]
    rows = [line for p in parts for line in p.to_pylist()]
    assert [line if line is None else "".join(c["c"] for c in line) for line in rows] == [None, "", *texts.to_pylist()[2:]]
    assert [c["x0"] for c in rows[3]] == [5.0, 9.0, 13.0, 17.0, 21.0] and rows[2][7]["x0"] == 35.0 and rows[2][14]["x1"] == 69.0
    both = pa.array(rows, parts[0].type)
    assert S.raw_texts(both, pa.array([10.0] * 4 + [None])).to_pylist() == [None, "", "abcdefg hijklmn o", "é☀\U0001F600•!", "abcdefg hi"]
    assert pc.list_value_length(S.picture_boxes(both)).to_pylist() == [None, 0, 0, 2, 0]
    assert pc.list_value_length(S.text_boxes(both)).to_pylist() == [None, 0, 15, 3, 10]
    odd = pa.array([[("a", 0.0, 4.0), ("", 4.0, 5.0), (None, 5.0, 6.0), ("b", 8.0, 9.0), ("c", None, 9.0), ("d", 9.0, 10.0), ("e", 10.0, 11.0)]], pa.list_(pa.struct({"c": pa.string(), "x0": pa.float64(), "x1": pa.float64()})))
    assert S.raw_texts(odd, pa.array([10.0])).to_pylist() == ["a bcde"]
