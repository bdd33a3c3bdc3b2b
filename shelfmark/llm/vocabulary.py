"""Where vocabulary files of public tokenizers are."""

from __future__ import annotations


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
