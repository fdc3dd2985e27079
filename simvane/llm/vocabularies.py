"""Where the public vocabulary files are; a parameter, never copied."""

from __future__ import annotations


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
