"""Index definition, search knobs and validation limits."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields, replace


class InvalidRequest(ValueError):
    """A name, field, filter or size outside the limits."""


# Limits in bytes or items.
MAX_NAME, MAX_FIELD, MAX_FIELDS, MAX_FILTERS = 128, 64, 32, 32
MAX_FILTER_ITEMS, MAX_FILTER_VALUE, MAX_FILTER_STRING = 64, 256, 2048
MAX_QUERY, MAX_RESULTS, DEFAULT_RESULTS = 512, 10_000, 100
MAX_WEIGHT, MAX_DOC_FIELDS, MAX_ID = 1000, 256, 256
_IDENTIFIER = re.compile(r"^[A-Za-z0-9_.-]+$")


def byte_length(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def check_identifier(name: str, what: str, limit: int) -> str:
    if not name or byte_length(name) > limit or not _IDENTIFIER.match(name):
        raise InvalidRequest(f"{what} must be 1 to {limit} bytes of letters, digits, '_', '.' or '-': {name!r}")
    return name


def check_query(query: str) -> str:
    if not query.strip():
        raise InvalidRequest("query is empty")
    if byte_length(query) > MAX_QUERY:
        raise InvalidRequest(f"query is longer than {MAX_QUERY} bytes")
    return query


@dataclass(frozen=True)
class Knobs:
    """Search and vector settings; ``from_env`` ignores values that are not valid."""

    max_prefix_terms: int = 64
    skip_update_prefix: bool = False
    exact_match_boost: int = 10
    single_term_max_prefix_tokens: int = 3
    single_term_max_fuzzy_tokens: int = 2
    single_term_skip_whole_scan: bool = False
    multi_term_skip_whole_scan: bool = False
    ai_category_threshold: float = 0.60
    ai_max_categories_per_doc: int = 3
    ai_max_categories: int = 100
    ai_embed_concurrency: int = 8
    ai_parallel_search_min_tokens: int = 2
    ai_search_top_n_categories: int = 3

    @classmethod
    def from_env(cls, prefix: str = "WORDLOOM_", env: Mapping[str, str] | None = None) -> Knobs:
        env, found = os.environ if env is None else env, {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is None:
                continue
            if isinstance(f.default, bool):
                if raw.strip().lower() in ("1", "t", "true", "0", "f", "false"):
                    found[f.name] = raw.strip().lower() in ("1", "t", "true")
                continue
            try:
                value = type(f.default)(raw)
            except ValueError:
                continue
            if value > 0:
                found[f.name] = value
        return replace(cls(), **found)


@dataclass(frozen=True)
class IndexConfig:
    """What is indexed: weighted text fields, filter fields and result size."""

    index_fields: tuple[str, ...]
    weights: Mapping[str, int] = field(default_factory=dict)
    filters: tuple[str, ...] = ()
    result_size: int = DEFAULT_RESULTS
    id_field: str = "id"
    popularity_field: str = "popularity"

    @classmethod
    def create(cls, index_fields: Sequence[str], weights: Mapping[str, int] | None = None, filters: Sequence[str] = (), result_size: int = 0, **more: str) -> IndexConfig:
        """A definition within the limits; size 0 means the default."""
        if not 1 <= len(index_fields) <= MAX_FIELDS:
            raise InvalidRequest(f"1 to {MAX_FIELDS} index fields are needed")
        if len(filters) > MAX_FILTERS:
            raise InvalidRequest(f"at most {MAX_FILTERS} filters are allowed")
        for names, what in ((index_fields, "index field"), (filters, "filter")):
            for name in names:
                check_identifier(name, what, MAX_FIELD)
            if len(set(names)) != len(names):
                raise InvalidRequest(f"a {what} is repeated")
        for name, weight in (weights or {}).items():
            if name not in index_fields:
                raise InvalidRequest(f"weight for {name!r}, which is no index field")
            if not 1 <= weight <= MAX_WEIGHT:
                raise InvalidRequest(f"weights are 1 to {MAX_WEIGHT}")
        if result_size == 0:
            result_size = DEFAULT_RESULTS
        if not 1 <= result_size <= MAX_RESULTS:
            raise InvalidRequest(f"result size must be 1 to {MAX_RESULTS}")
        return cls(tuple(index_fields), normalized_weights(index_fields, weights or {}), tuple(filters), result_size, **more)

    def weight(self, name: str) -> int:
        return normalized_weights(self.index_fields, self.weights)[name]


def normalized_weights(index_fields: Sequence[str], weights: Mapping[str, int]) -> dict[str, int]:
    """A weight for each index field: 1 where none or none above zero is given."""
    return {f: weights[f] if weights.get(f, 0) > 0 else 1 for f in index_fields}


def parse_filter(text: str, allowed: Sequence[str]) -> dict[str, list[str]]:
    """``field:value,field:value``; repeated fields mean any of their values."""
    if byte_length(text) > MAX_FILTER_STRING:
        raise InvalidRequest(f"filter is longer than {MAX_FILTER_STRING} bytes")
    out: dict[str, list[str]] = {}
    items = split_list(text)
    if len(items) > MAX_FILTER_ITEMS:
        raise InvalidRequest(f"more than {MAX_FILTER_ITEMS} filter values")
    for item in items:
        name, colon, value = item.partition(":")
        name, value = name.strip(), value.strip()
        if not colon or not name or not value:
            raise InvalidRequest(f"filter must be field:value: {item!r}")
        if name not in allowed:
            raise InvalidRequest(f"unknown filter field {name!r}")
        if byte_length(value) > MAX_FILTER_VALUE:
            raise InvalidRequest(f"filter value is longer than {MAX_FILTER_VALUE} bytes")
        out.setdefault(name, []).append(value)
    return out


def split_list(text: str) -> list[str]:
    """Comma-separated items, trimmed, blanks dropped."""
    return [x.strip() for x in text.split(",") if x.strip()]


def multi_term_prefix_limit(last: str) -> int:
    """Prefix candidates of the last token, by its bytes."""
    n = byte_length(last)
    return 50 if n <= 2 else 40 if n <= 5 else 30


def fuzzy_limit(term: str) -> int:
    """Fuzzy candidates of a token before the last, by its bytes."""
    n = byte_length(term)
    return 30 if n <= 4 else 20 if n <= 6 else 10
