"""Words of texts as the operators count them, over bytes, without patterns."""

from __future__ import annotations

# Bytes below 0x80 that are no letter or digit end a word; A-Z are lower-cased.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def folded_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all signs beyond ASCII; none for null."""
    return text.encode().translate(FOLD).split() if text else []


def blank_words(text: str | None) -> list[bytes]:
    """Runs of anything but the six ASCII white-space signs; none for null."""
    return text.encode().split() if text else []
