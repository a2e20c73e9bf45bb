"""The store: a handle on an immutable set of quads, with reads as DataFrames and changes that swap the set."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fourfold.folders import checkpointed
from fourfold.functions.terms import DefaultGraph, Iri, Quoted, Term
from fourfold.operators import dictionary, matching, mutation
from fourfold.plans.layouts import DEFAULT_LAYOUTS, best, best_for_pattern, checked
from fourfold.plans.pattern import Pattern
from fourfold.schema import QUAD, QUADS_SCHEMA
from fourfold.sources import files
from fourfold.sources.tables import quads_from_terms, quoted_in

#: Fixed value: what is said where nodes were not asked for.
NO_NODES = "Nodes can only be read when the store was constructed with 'indexNodes: true'"
#: Changes after which those since the base are written to the shared folder as one table.
MOST_CHANGES = 64


@dataclass(frozen=True)
class StoreOptions:
    """layouts: the sorted copies that `save` writes. index_nodes: may nodes be read? folder: where `commit` writes versions.
    inner_quoted: are triples quoted inside others found as quoted triples?"""

    layouts: Sequence[Sequence[str]] = DEFAULT_LAYOUTS
    index_nodes: bool = False
    folder: str | None = None
    inner_quoted: bool = True


class QuadStore:
    """Quads and the quoted triples in them. A DataFrame got earlier keeps its version when the store changes.

    `quads` (s, p, o, g; a set, no column null) may be given; the quoted triples in them are found by their keys unless given as
    well (k, s, p, o). Changes are lazy; each adds its own rows to the plan and nothing else. `commit` writes a version and
    reads from it. A store read from a folder answers each request from the layout that fits it best, changed or not.
    """

    def __init__(self, spark: SparkSession, quads: DataFrame | None = None, quoted: DataFrame | None = None, options: StoreOptions | None = None):
        self.spark, self.options = spark, options or StoreOptions()
        self.layouts = checked(self.options.layouts)
        self.state = mutation.Quads(spark.createDataFrame([], QUADS_SCHEMA) if quads is None else mutation.checked(quads))
        self.known_quoted = quoted_in(self.state.base, self.options.inner_quoted) if quoted is None else quoted
        self.more_quoted: list[DataFrame] = []
        self.copies: dict[tuple[str, ...], DataFrame] = {}
        self.quoted_copies: dict[tuple[str, ...], DataFrame] = {}
        self.version, self._size = 0, None

    @classmethod
    def create_default(cls, spark: SparkSession, index_nodes: bool = False) -> QuadStore:
        return cls(spark, options=StoreOptions(index_nodes=index_nodes))

    @classmethod
    def load(cls, spark: SparkSession, path: str, options: StoreOptions | None = None) -> QuadStore:
        """The store that `save` wrote."""
        options, quoted = options or StoreOptions(), files.read_quoted(spark, path)
        store = cls(spark, files.read_layout(spark, path, options.layouts[0]), quoted[files.QUOTED_LAYOUTS[0]], options)
        store.copies = {tuple(x): files.read_layout(spark, path, x) for x in store.layouts}
        store.quoted_copies = quoted
        return store

    @property
    def features(self) -> dict[str, bool]:
        return {"quotedTripleFiltering": True, "indexNodes": self.options.index_nodes, "indexDistinctTerms": True}

    @property
    def quads(self) -> DataFrame:
        return self.state.now

    @property
    def quoted(self) -> DataFrame:
        return self.quoted_rows(())

    @property
    def size(self) -> int:
        """The number of quads, counted once a version."""
        if self._size is None:
            self._size = self.quads.count()
        return self._size

    def save(self, path: str) -> None:
        """Writes the layouts and the quoted triples; both are computed once, as each copy is sampled and then written."""
        files.write_layouts(checkpointed(self.quads), path, self.layouts)
        files.write_quoted(checkpointed(self.quoted), path)

    def commit(self) -> QuadStore:
        """Writes this version to the options' folder and reads from it, which cuts the plan."""
        if self.options.folder is None:
            raise ValueError("a store without a folder can't commit")
        path = f"{self.options.folder}/v{self.version + 1}-{self.spark._jvm.java.util.UUID.randomUUID()}"
        self.save(path)
        stored = QuadStore.load(self.spark, path, self.options)
        self.state, self.known_quoted, self.more_quoted = stored.state, stored.known_quoted, []
        self.copies, self.quoted_copies, self.version = stored.copies, stored.quoted_copies, self.version + 1
        return self

    def scan(self, names: Sequence[str], whole: bool = False) -> DataFrame:
        """The copy that serves a request for these components best, with the changes since."""
        if not self.copies:
            return self.quads
        choose = best if whole else best_for_pattern
        return self.state.on(self.copies[self.layouts[choose(self.layouts, names)]])

    def quoted_rows(self, bound: Sequence[str]) -> DataFrame:
        """The quoted triples, from the copy that serves a lookup by these columns best, with those added since."""
        known = self.quoted_copies[files.quoted_layout(bound)] if self.quoted_copies else self.known_quoted
        return reduce(DataFrame.unionByName, [known, *self.more_quoted]).distinct() if self.more_quoted else known

    # Reads

    def match(self, s: Term | None = None, p: Term | None = None, o: Term | None = None, g: Term | None = None) -> DataFrame:
        pattern = Pattern(s, p, o, g)
        return matching.match(self.scan(pattern.bound), self.quoted_rows, pattern)

    def match_many(self, patterns: DataFrame) -> DataFrame:
        """The quads that each of a table of patterns fits: see `matching.match_many`."""
        return matching.match_many(self.scan, self.quoted_rows, patterns)

    def count_many(self, patterns: DataFrame) -> DataFrame:
        """How many quads each of a table of patterns fits: see `matching.count_many`."""
        return matching.count_many(self.scan, patterns)

    def get_quads(self, *terms: Term | None) -> list[Row]:
        return self.match(*terms).collect()

    def iter_quads(self, *terms: Term | None) -> Iterator[Row]:
        """The matches, a partition at a time."""
        return self.match(*terms).toLocalIterator()

    def has(self, s: Term, p: Term, o: Term, g: Term = DefaultGraph()) -> bool:
        return not self.match(s, p, o, g).isEmpty()

    def bindings(self, s: Term, p: Term, o: Term, g: Term) -> DataFrame:
        pattern = Pattern(s, p, o, g)
        return matching.bindings(self.scan(pattern.bound), self.quoted_rows, pattern)

    def get_bindings(self, *terms: Term) -> list[Row]:
        return self.bindings(*terms).collect()

    def iter_bindings(self, *terms: Term) -> Iterator[Row]:
        return self.bindings(*terms).toLocalIterator()

    def count(self, s: Term | None = None, p: Term | None = None, o: Term | None = None, g: Term | None = None) -> int:
        pattern = Pattern(s, p, o, g)
        if not pattern.constants and not pattern.quoted:
            return self.size
        return matching.count(self.scan(pattern.bound), self.quoted_rows, pattern).first()["n"]

    def distinct_terms(self, names: Sequence[str]) -> DataFrame:
        return matching.distinct_terms(self.scan(names, whole=True), names)

    def get_distinct_terms(self, names: Sequence[str]) -> list[Row]:
        return self.distinct_terms(names).collect()

    def iter_distinct_terms(self, names: Sequence[str]) -> Iterator[Row]:
        return self.distinct_terms(names).toLocalIterator()

    def count_distinct_terms(self, names: Sequence[str]) -> int:
        return matching.count_distinct_terms(self.scan(names, whole=True), names).first()["n"]

    def nodes(self, graph: Term | None = None) -> DataFrame:
        if not self.options.index_nodes:
            raise ValueError(NO_NODES)
        return matching.nodes(self.scan(Pattern(None, None, None, graph).bound), graph)

    def get_nodes(self, graph: Term | None = None) -> list[Row]:
        return self.nodes(graph).collect()

    def iter_nodes(self, graph: Term | None = None) -> Iterator[Row]:
        return self.nodes(graph).toLocalIterator()

    def count_nodes(self, graph: Term | None = None) -> int:
        return self.nodes(graph).count()

    def find_quoted(self, pattern: Quoted) -> DataFrame:
        """The quoted triples that the pattern fits; inner ones count, and so do those of quads that are gone."""
        if not pattern.has_variables():
            return self.quoted_rows(("k",)).where(F.col("k") == pattern.key())
        return matching.find_quoted(self.quoted_rows, pattern)

    def dictionary(self) -> DataFrame:
        return dictionary.dense_ids(dictionary.terms_of(self.quads, self.quoted))

    # Changes

    def _swap(self, state: mutation.Quads, changed: DataFrame) -> DataFrame:
        self.state, self._size = state, None
        if state.changes >= MOST_CHANGES:
            self.compact()
        return changed

    def compact(self) -> None:
        """Writes the changes since the base to the shared folder, of each quad the latest; the base is not rewritten."""
        log = self.state.log
        if log is not None:
            latest = log.groupBy(*QUAD).agg(F.max(F.col("seq") * 2 + F.col("added").cast("int")).alias("last"))
            log = checkpointed(latest.select(*QUAD, F.lit(0).alias("seq"), (F.col("last") % 2 == 1).alias("added")))
        self.state = mutation.Quads(self.state.base, log)
        if self.more_quoted:
            self.more_quoted = [checkpointed(reduce(DataFrame.unionByName, self.more_quoted).distinct())]

    def add(self, rows: DataFrame, quoted: DataFrame | None = None) -> DataFrame:
        """Adds rows of keys, and the quoted triples in them, each level a row; gives the quads that were new."""
        rows = mutation.checked(rows)
        self.more_quoted.append(quoted_in(rows, self.options.inner_quoted) if quoted is None else quoted.select("k", "s", "p", "o"))
        new = rows.distinct().join(self.quads, list(QUAD), "left_anti")
        return self._swap(self.state.logged(rows, True), new)

    def add_quads(self, quads) -> DataFrame:
        """Adds tuples of terms; gives the quads that were new."""
        return self.add(quads_from_terms(self.spark, quads))

    def add_quad(self, *quad: Term) -> bool:
        """Was the quad new?"""
        return not self.add_quads([quad]).isEmpty()

    def remove(self, rows: DataFrame) -> DataFrame:
        """Removes rows of keys; gives the quads that are gone."""
        rows = mutation.checked(rows)
        return self._swap(self.state.logged(rows, False), self.quads.join(rows, list(QUAD), "left_semi"))

    def remove_quad(self, *quad: Term) -> bool:
        return not self.remove(quads_from_terms(self.spark, [quad])).isEmpty()

    def remove_matches(self, s: Term | None = None, p: Term | None = None, o: Term | None = None, g: Term | None = None) -> DataFrame:
        pattern = Pattern(s, p, o, g)
        gone = self.match(s, p, o, g)
        state = self.state.without(self.quoted_rows, pattern)
        self.copies = {x: mutation.fitting(copy, self.quoted_rows, pattern, False) for x, copy in self.copies.items()}
        return self._swap(state, gone)

    def delete_graph(self, graph: str | Term) -> DataFrame:
        """Removes a graph; a string is an IRI, so the default graph needs its term."""
        return self.remove_matches(g=Iri(graph) if isinstance(graph, str) else graph)

    def as_dataset(self) -> Dataset:
        return Dataset(self)


@dataclass
class Dataset:
    """A set of quads over a store; changes go both ways."""

    store: QuadStore

    @property
    def size(self) -> int:
        return self.store.size

    def __len__(self) -> int:
        return self.store.size

    def add(self, *quad: Term) -> Dataset:
        self.store.add_quads([quad])
        return self

    def delete(self, *quad: Term) -> Dataset:
        self.store.remove(quads_from_terms(self.store.spark, [quad]))
        return self

    def has(self, *quad: Term) -> bool:
        return self.store.has(*quad)

    def match(self, *terms: Term | None) -> Dataset:
        """The matches as a dataset of its own."""
        return Dataset(QuadStore(self.store.spark, self.store.match(*terms), self.store.quoted, self.store.options))

    def __iter__(self) -> Iterator[Row]:
        return self.store.quads.toLocalIterator()
