"""Layouts: which sorted copy of the quads serves a request best."""

from __future__ import annotations

from collections.abc import Sequence

from fourfold.schema import NAMES

#: The default copies.
DEFAULT_LAYOUTS = (
    ("graph", "subject", "predicate", "object"),
    ("graph", "predicate", "object", "subject"),
    ("graph", "object", "subject", "predicate"),
)
#: A component's place in a quad.
PLACE = {name: k for k, name in enumerate(NAMES)}

Layout = Sequence[str]


def valid(layout: Layout) -> bool:
    """Is it a permutation of the four components?"""
    return sorted(layout) == sorted(NAMES)


#: What is said of layouts that can't be used.
NO_LAYOUT, BAD_LAYOUT = "At least one index combination is required", "Invalid index combination: {}"


def checked(layouts: Sequence[Layout]) -> tuple[tuple[str, ...], ...]:
    if not layouts:
        raise ValueError(NO_LAYOUT)
    for layout in layouts:
        if not valid(layout):
            raise ValueError(BAD_LAYOUT.format(",".join(layout)))
    return tuple(tuple(x) for x in layouts)


def score(layout: Layout, names: Sequence[str]) -> int:
    """The sooner the layout has the names, the higher."""
    return sum(len(layout) - place for place, name in enumerate(layout) if name in names)


def best(layouts: Sequence[Layout], names: Sequence[str]) -> int:
    """The number of the layout with the highest score, the first of equal ones."""
    return max(range(len(layouts)), key=lambda k: (score(layouts[k], names), -k))


def best_for_pattern(layouts: Sequence[Layout], bound: Sequence[str]) -> int:
    """The layout for a lookup with these components bound; the first one if all are."""
    return 0 if len(set(bound)) == len(NAMES) else best(layouts, bound)


def path(layout: Layout, names: Sequence[str]) -> list[bool]:
    """Which levels of the layout a request for `names`, given in the layout's order, takes, up to the last of them."""
    taken, waiting = [], list(names)
    for name in layout:
        if not waiting:
            break
        taken.append(name == waiting[0])
        if taken[-1]:
            waiting.pop(0)
    return taken


def reordered(layout: Layout, quad: Sequence):
    """A quad's components in the layout's order."""
    return [quad[PLACE[name]] for name in layout]
