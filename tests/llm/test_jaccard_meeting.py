"""Candidates of the Jaccard join: a family of like classes meets at each gram that it shares, and is looked at once."""

import random

import numpy as np
import pyarrow as pa
import pytest

from rushes.llm import jaccard_join as j


def cells(members, n_grams, draw):
    """Rows of cells: each gram with the members that have it."""
    rows = []
    for gram in range(n_grams):
        for node, (n, known, label) in sorted(members.items()):
            if len(members) <= 3 or draw.random() < 0.95 or gram == 0:
                rows.append((2, gram, 0, 0, node, n, known, label))
    kinds = {"level": pa.int32(), "gram": pa.int64(), "i": pa.int32(), "j": pa.int32(), "node": pa.int64(), "n": pa.int32(), "known": pa.list_(pa.int16()), "label": pa.int64()}
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))
    return table.to_batches(max_chunksize=700)


def family(size, draw):
    """Classes of 400 grams of which 58 of the 60 known ones are the family's."""
    common = draw.sample(range(-32768, 32768), 60)
    return {1000 + k: (400, sorted(set(draw.sample(common, 58))) + [draw.randrange(-32768, 32768)], None) for k in range(size)}


@pytest.mark.parametrize("size", [2, 5, 60, 400])
def test_a_family_is_looked_at_once(monkeypatch, size):
    draw, looked = random.Random(size), []
    members = family(size, draw)
    whole, few = j.near, j.trees
    monkeypatch.setattr(j, "near", lambda *a, **b: looked.append(1) or whole(*a, **b))
    monkeypatch.setattr(j, "trees", lambda *a: looked.append(1) or few(*a))
    found = [r for batch in j.cells_met(90)(cells(members, 40, draw)) for r in batch.to_pylist()]
    assert len(looked) == 1
    assert {x for r in found for x in (r["a"], r["b"])} == set(members)
    assert len(found) == size - 1


def test_two_families_stay_apart():
    """Each family is joined, by single pairs or as a crowd, and no pair lies across."""
    draw = random.Random(9)
    members = family(30, draw) | {k + 5000: v for k, v in family(25, draw).items()}
    found = [(r["a"], r["b"]) for batch in j.cells_met(90)(cells(members, 12, draw)) for r in batch.to_pylist()]
    assert all((a < 5000) == (b < 5000) for a, b in found)
    assert {x for pair in found for x in pair} == set(members)


def test_groups():
    draw = random.Random(1)
    for m in (1, 2, 9, 40):
        for share in (0, 0.5, 1, 3):
            pairs = [(draw.randrange(m), draw.randrange(m)) for _ in range(int(m * share))]
            pairs = [(x, y) for x, y in pairs if x != y]
            a, b = (np.array(x, int) for x in (zip(*pairs) if pairs else ((), ())))
            least = j.groups(m, a, b)
            want = np.arange(m)
            for places, _ in j.trees(m, pairs):
                want[places] = places[0]
            assert least.tolist() == want.tolist()
