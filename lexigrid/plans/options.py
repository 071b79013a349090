"""Options of an index and of a search, checked when made."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields
from urllib.parse import urlparse

from ..functions.analysis import Analyzer


def _url(value: str | None, name: str, part: str | None = None) -> None:
    if value is None:
        return
    if not (urlparse(value).scheme or value.startswith("/")):
        raise ValueError(f"{name} is not a valid URL: {value}")
    if part and part not in value:
        raise ValueError(f"{name} must contain {part}")


@dataclass(frozen=True)
class IndexOptions:
    id_field: str = "id"
    indexed_fields: tuple[str, ...] | None = None
    json_columns: tuple[str, ...] = ()
    #: a language's name or an Analyzer
    language: str | Analyzer = "default"
    keep_documents: bool = False
    enable_autocomplete: bool = False
    #: columns that give the order of insertion, which breaks ties of the score
    order_by: tuple[str, ...] | None = None
    storage: object = None
    index_url: str | None = None
    patch_url: str | None = None
    fetch_document_url: str | None = None
    get_document: Callable[[str], dict | None] | None = None

    def __post_init__(self) -> None:
        if self.keep_documents and self.get_document:
            raise ValueError("keep_documents and get_document exclude each other")
        if self.indexed_fields is not None and not self.indexed_fields:
            raise ValueError("indexed_fields must name at least one field")
        _url(self.index_url, "index_url")
        _url(self.patch_url, "patch_url", "{version}")
        _url(self.fetch_document_url, "fetch_document_url", "{id}")

    def stored(self) -> dict:
        """The options that can be written down."""
        out = {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("storage", "get_document", "language")}
        return out | ({"language": self.language} if isinstance(self.language, str) else {})


@dataclass(frozen=True)
class SearchOptions:
    #: such as ``title`` or ``content^2``; all fields if None or empty
    fields: list[str] | None = None
    limit: int | None = None
    offset: int = 0
    k1: float = 1.2
    b: float = 0.75
    #: ``"AUTO"`` or a number of errors; without effect unless the index has autocomplete
    fuzziness: str | int = "AUTO"
    max_expansions: int = 5
    #: an extension: expanded words pass through the analyser
    analyze_expansions: bool = False
    include_docs: bool = True
    highlighted_fields: list[str] = field(default_factory=list)
    highlight_before: str = "<b>"
    highlight_after: str = "</b>"
    #: Column to Column, on the document's id; applied after scoring and before paging
    id_filter: Callable | None = None
    ignore_errors: bool = False
    get_document: Callable[[str], dict | None] | None = None

    def __post_init__(self) -> None:
        if self.limit is not None and self.limit <= 0 or self.max_expansions <= 0:
            raise ValueError("limit and max_expansions must be positive")
        if self.offset < 0 or self.fuzziness != "AUTO" and (isinstance(self.fuzziness, str) or self.fuzziness < 0):
            raise ValueError("offset and fuzziness must not be negative")


@dataclass(frozen=True)
class AutocompleteOptions:
    method: str = "prefix"
    limit: int | None = 10
    fuzziness: str | int = "AUTO"

    def __post_init__(self) -> None:
        if self.method not in ("prefix", "fuzzy"):
            raise ValueError(f"Unknown method: {self.method}")
        if self.limit is not None and self.limit <= 0:
            raise ValueError("limit must be positive")


@dataclass(frozen=True)
class SyncResult:
    has_loaded_index_from_storage: bool = False
    has_written_to_storage: bool = False
    has_loaded_index_from_remote: bool = False
    number_of_applied_patches: int = 0
    bytes_loaded: int = 0
