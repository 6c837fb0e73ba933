"""Terms of texts: maximal runs of term characters, A-Z as small letters, found on UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a text that are split at once, so that a very long text is never a list of all its terms.
PIECE_BYTES = 1 << 20

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folding(more: str = "") -> bytes:
    """A byte table: letters, the ASCII characters of ``more`` and all bytes from 0x80 on stay, all else becomes a blank."""
    kept = {*_SMALL.encode(), *more.encode(), *range(0x80, 0x100)}
    return bytes(b + 32 if 65 <= b <= 90 else b if b in kept else 32 for b in range(256))


def pieces(raw: bytes, table: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists; no term is cut."""
    folded, at = raw.translate(table), 0
    while at < len(folded):
        end = folded.find(b" ", at + size) if len(folded) - at > size else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def terms(text: Column, pattern: str) -> Column:
    """The same terms as an array, for small tables: matches of ``pattern`` after A-Z are lowered."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _CAPITALS, _SMALL), F.lit(pattern), F.lit(0))


def terms_sql(text: str, pattern: str) -> str:
    """DuckDB's form of :func:`terms`."""
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_CAPITALS}', '{_SMALL}'), '{pattern}')"
