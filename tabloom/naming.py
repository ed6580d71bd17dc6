"""Identifiers: column and table names, namespace names, slugs."""

from __future__ import annotations

import hashlib
import re
import unicodedata

MAX_IDENTIFIER = 128
MAX_SLUG = 100
HASH_DIGITS = 10

# Header words that mark a column of identifiers, which is kept as text whatever its values look like.
IDENTIFIER_WORDS = (
    "cpf", "cnpj", "cep", "telefone", "phone", "celular", "whats", "codigo", "cod", "sku", "id", "documento", "doc",
)
_IDENTIFIER_HEADER = re.compile(rf"(?:^|[_\s-])(?:{'|'.join(IDENTIFIER_WORDS)})(?:[_\s-]|$)", re.IGNORECASE)


def _ascii_fold(value: str) -> str:
    decomposed = unicodedata.normalize("NFD", value)
    return "".join(ch for ch in decomposed if not 0x300 <= ord(ch) <= 0x36F).lower()


def _fit(name: str, limit: int) -> str:
    if len(name) <= limit:
        return name
    digest = hashlib.sha256(name.encode("utf-8")).hexdigest()[:HASH_DIGITS]
    return f"{name[: limit - HASH_DIGITS - 1]}_{digest}"


def sql_identifier(value: str, limit: int = MAX_IDENTIFIER) -> str:
    """Column or table name for a free-text header."""
    words = [w for w in re.split(r"[^a-z0-9]+", _ascii_fold(value)) if w]
    name = "_".join(words) or "campo"
    return _fit(f"col_{name}" if name[0].isdigit() else name, limit)


def slugify(value: str, limit: int = MAX_SLUG) -> str:
    """URL slug of a project or dataset name."""
    words = [w for w in re.split(r"[^a-z0-9]+", _ascii_fold(value)) if w]
    if not words:
        raise ValueError(f"{value!r} yields no valid slug")
    return _fit("-".join(words), limit)


def namespace_name(project_slug: str, dataset_slug: str) -> str:
    """Name of the namespace that isolates one dataset."""
    return sql_identifier(f"d_{project_slug}_{dataset_slug}")


def header_marks_identifier(header: str) -> bool:
    """True when a header names an identifier (a document number, a phone, a code)."""
    return _IDENTIFIER_HEADER.search(header) is not None


def normalize_headers(headers: list[str]) -> list[str]:
    """Table column names for file headers: blank headers are numbered, repeats get a numeric suffix."""
    used: set[str] = set()
    names = []
    for position, header in enumerate(headers, start=1):
        base = name = sql_identifier(header or f"col_{position}")
        copy = 1
        while name in used:
            copy += 1
            name = f"{base}_{copy}"
        used.add(name)
        names.append(name)
    return names
