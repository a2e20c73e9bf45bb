"""The choice of a layout for every shape."""

import pytest

from fourfold.plans.layouts import DEFAULT_LAYOUTS, best, best_for_pattern, checked, path, reordered, score, valid
from fourfold.schema import NAMES, columns_of

LETTER = dict(zip("SPOG", NAMES))


def names(letters):
    return [LETTER[x] for x in letters]


@pytest.mark.parametrize(("bound", "choice"), [("SPO", 0), ("SP", 0), ("SO", 2), ("S", 0), ("PO", 1), ("P", 1), ("O", 2), ("", 0)])
def test_patterns(bound, choice):
    assert best_for_pattern(DEFAULT_LAYOUTS, names(bound)) == choice
    assert best_for_pattern(DEFAULT_LAYOUTS, names(bound + "G")) == choice
    assert best_for_pattern(DEFAULT_LAYOUTS[2:], names(bound)) == 0


@pytest.mark.parametrize(("asked", "choice"), [("G", 0), ("GS", 0), ("GSP", 0), ("GSPO", 0), ("GP", 1), ("GPO", 1), ("GPOS", 0), ("GO", 2), ("GOS", 2), ("GOSP", 0), ("S", 0), ("SP", 0), ("PO", 1), ("P", 1), ("POS", 0), ("O", 2), ("OS", 2), ("OSP", 0), ("OP", 1)])
def test_terms(asked, choice):
    assert best(DEFAULT_LAYOUTS, names(asked)) == choice


def test_scores():
    assert score(NAMES, ["subject"]) == 4 and score(NAMES, ["graph"]) == 1 and score(NAMES, NAMES) == 10 and score(NAMES, []) == 0


def test_paths():
    assert path(NAMES, ["subject"]) == [True]
    assert path(NAMES, ["predicate"]) == [False, True]
    assert path(NAMES, ["subject", "graph"]) == [True, False, False, True]
    assert path(NAMES, []) == []


def test_errors():
    with pytest.raises(ValueError, match="At least one index combination is required"):
        checked([])
    with pytest.raises(ValueError, match="Invalid index combination: subject,predicate"):
        checked([["subject", "predicate"]])
    assert valid(NAMES) and not valid([*NAMES[:3], "subject"])
    with pytest.raises(ValueError):
        columns_of(["subject", "s"])
    with pytest.raises(ValueError):
        columns_of(["verb"])


def test_reordered():
    assert reordered(DEFAULT_LAYOUTS[1], "spog") == list("gpos")
