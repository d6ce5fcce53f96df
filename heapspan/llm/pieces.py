"""Pre-tokens of SentencePiece BPE models.

No piece of such a model has a space after another character, and none holds a line break or tab, so no merge crosses a
place before a run of spaces or beside such a control. Encoding the pre-tokens between these places one by
one gives what encoding the whole text gives. `model_fits` checks that of a model, and that it leaves texts as they are: one that
normalises them (NFKC, runs of spaces) is refused.
"""

from __future__ import annotations

import re

import sentencepiece

SPACE = "▁"
#: What a normaliser would change.
_PROBE = "a  b ﬁ①Ａ é\u0301  \n\t c "
_PRE = re.compile("[ ▁]*[^ ▁\n\t]+|[ ▁]+|[\n\t]")
_PRE_EXACT = re.compile(" *[^ \n\t]+| +|[\n\t]")


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(model: bytes) -> sentencepiece.SentencePieceProcessor:
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    if not model_fits(sp):
        raise ValueError("a piece of the model crosses a pre-token, or the model normalises texts")
    return sp


def model_fits(sp: sentencepiece.SentencePieceProcessor) -> bool:
    return sp.decode(sp.encode(_PROBE)) == _PROBE and not any(re.search(f"[^{SPACE}]{SPACE}|[\n\t ]", sp.id_to_piece(i)) for i in range(sp.get_piece_size()))


def pre_tokens(text: str) -> list[str]:
    """With the space that the library puts before a text; U+2581 is a space, as it is to the library."""
    return _PRE.findall(" " + text) if text else []


def exact_pre_tokens(text: str) -> list[str]:
    """The same, but U+2581 is a character of its own."""
    return _PRE_EXACT.findall(" " + text) if text else []
