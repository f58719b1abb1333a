"""Named sources: what a catalog, a profile or a mapping request works on."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

# Limits of a request that maps sources to each other, and what is said of others.
MIN_SOURCES = 2
MAX_SOURCES = 10
TOO_FEW_OR_MANY = f"{MIN_SOURCES} to {MAX_SOURCES} sources are required."
SOURCE_ID = re.compile(r"[a-zA-Z][a-zA-Z0-9_-]{0,63}")

RELATIONAL = "relational"
DOCUMENT = "document"
KINDS = (RELATIONAL, DOCUMENT)


@dataclass(frozen=True)
class Key:
    """A declared constraint: ``primary`` or ``unique``, columns in key order."""

    name: str
    kind: str
    columns: tuple[str, ...]

    def __post_init__(self) -> None:
        if self.kind not in ("primary", "unique"):
            raise ValueError(f"Unknown key kind: {self.kind!r}.")


@dataclass(frozen=True)
class Entity:
    """A table, or a collection of documents.

    A collection carries its documents in one VARIANT column, ``document``.
    ``identifiers`` are text columns that hold UUIDs, which Spark has no type for.
    """

    namespace: str
    name: str
    data: DataFrame
    keys: tuple[Key, ...] = ()
    indexes: tuple[str, ...] = ()
    not_null: frozenset[str] = frozenset()
    identifiers: frozenset[str] = frozenset()
    document: str | None = None

    def columns_of(self, kind: str) -> frozenset[str]:
        """Every column that takes part in a declared key of this kind."""
        return frozenset(c for k in self.keys if k.kind == kind for c in k.columns)

    @property
    def required(self) -> frozenset[str]:
        """Columns declared not null, primary keys included."""
        return self.not_null | self.columns_of("primary")


@dataclass(frozen=True)
class Source:
    source_id: str
    kind: str
    entities: tuple[Entity, ...]

    def __post_init__(self) -> None:
        if not SOURCE_ID.fullmatch(self.source_id):
            raise ValueError(f"Invalid source ID: {self.source_id!r}.")
        if self.kind not in KINDS:
            raise ValueError(f"Unknown source kind: {self.kind!r}.")
        for entity in self.entities:
            if (entity.document is not None) != (self.kind == DOCUMENT):
                raise ValueError(f"{entity.name} does not fit a {self.kind} source.")

    def entity(self, name: str, namespace: str | None = None) -> Entity:
        for entity in self.entities:
            if entity.name == name and namespace in (None, entity.namespace):
                return entity
        raise KeyError(f"{self.source_id} has no entity {name!r}.")


@dataclass(frozen=True)
class SourceSet:
    """Uniquely named sources, in request order. Mapping requests take two to ten."""

    sources: tuple[Source, ...]
    _ids: frozenset[str] = field(init=False, repr=False)

    def __init__(self, sources: Iterable[Source]):
        listed = tuple(sources)
        ids = frozenset(s.source_id for s in listed)
        if len(ids) != len(listed):
            raise ValueError("Source IDs must be unique.")
        if not listed:
            raise ValueError("A source is required.")
        object.__setattr__(self, "sources", listed)
        object.__setattr__(self, "_ids", ids)

    def __iter__(self) -> Iterator[Source]:
        return iter(self.sources)

    def __len__(self) -> int:
        return len(self.sources)

    def __getitem__(self, source_id: str) -> Source:
        for source in self.sources:
            if source.source_id == source_id:
                return source
        raise KeyError(f"No source {source_id!r}.")

    def for_mapping(self) -> SourceSet:
        """These sources, if there are as many as a mapping request may name."""
        if not MIN_SOURCES <= len(self.sources) <= MAX_SOURCES:
            raise ValueError(TOO_FEW_OR_MANY)
        return self

    def of_kind(self, kind: str) -> list[tuple[int, Source]]:
        return [(i, s) for i, s in enumerate(self.sources) if s.kind == kind]
