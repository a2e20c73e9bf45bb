"""Patterns, and what they ask of a plan."""

from __future__ import annotations

from dataclasses import dataclass

from fourfold.functions.terms import Quoted, Term, Var, open_term
from fourfold.schema import NAMES, QUAD


@dataclass(frozen=True)
class Pattern:
    """Four positions: a term, or None or a variable for anything."""

    subject: Term | None = None
    predicate: Term | None = None
    object: Term | None = None
    graph: Term | None = None

    @property
    def positions(self) -> list[tuple[str, Term | None]]:
        return list(zip(QUAD, (self.subject, self.predicate, self.object, self.graph)))

    @property
    def constants(self) -> dict[str, str]:
        """column -> key of the positions that stand for one term. A blank node is a constant."""
        return {c: t.key() for c, t in self.positions if not open_term(t)}

    @property
    def quoted(self) -> dict[str, Quoted]:
        """column -> quoted pattern of the positions that hold one with variables."""
        return {c: t for c, t in self.positions if isinstance(t, Quoted) and t.has_variables()}

    @property
    def bound(self) -> list[str]:
        """The names of the positions that a lookup can start from."""
        return [n for n, (_, t) in zip(NAMES, self.positions) if not open_term(t)]

    @property
    def variables(self) -> list[str]:
        """The names of all variables, those of quoted patterns included, in order of first sight."""
        out: dict[str, None] = {}
        for _, term in self.positions:
            collect(term, out)
        return list(out)


def collect(term: Term | None, out: dict[str, None]) -> None:
    if isinstance(term, Var):
        out[term.name] = None
    elif isinstance(term, Quoted):
        for part in (*term.parts, term.graph):
            collect(part, out)


def nowhere(quoted: Quoted) -> bool:
    """Does the quoted pattern, or one in it, ask for a graph that no quoted triple is in?"""
    own = isinstance(quoted.graph, Term) and not open_term(quoted.graph) and quoted.graph.key() != ""
    return own or any(isinstance(t, Quoted) and t.has_variables() and nowhere(t) for t in quoted.parts)
