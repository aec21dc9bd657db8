"""Words of whole texts as bytes: one translate and one split, shared by resampling and lexical search."""

from __future__ import annotations

#: Lower-cases A-Z and blanks what is no ASCII letter or digit; bytes of other characters stay as they are in UTF-8.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(raw: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8, in order; none for null."""
    return raw.translate(TABLE).split() if raw else []
