"""Where the public tokenizers' files lie; the operators take the path as a parameter."""

from __future__ import annotations


def _path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def WORD_BPE() -> str:  # noqa: N802
    return _path("word_bpe_49k.json")


def BYTE_BPE() -> str:  # noqa: N802
    return _path("byte_bpe_50k.tiktoken")


def BYTE_BPE_MULTI() -> str:  # noqa: N802
    return _path("byte_bpe_multi_50k.tiktoken")


def BYTE_PATTERN() -> str:  # noqa: N802
    """The pattern that splits text before the merges of the rank files."""
    import public_tokenizers

    return str(public_tokenizers.PATTERN)
