"""Pre-tokens of the public vocabularies, cut in Python workers.

Texts of code points below U+0250 take a pattern of Python's own `re`; others take the same pattern in Unicode
properties.  Both cut as the tokenizers library does; tests compare every code point.
"""

from __future__ import annotations

import re
import unicodedata

import regex

# Letters, numbers and white space below U+0250, as Unicode has them.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
_BEYOND = re.compile("[^\x00-ɏ]")
_BYTE_NEAR = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WORD_FAR = regex.compile(r"'(?:[stmd]|re|ve|ll)|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_WORD_NEAR = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


def beyond(text: str) -> bool:
    return not text.isascii() and _BEYOND.search(text) is not None


class ByteCutter:
    """Pre-tokens of a byte-level vocabulary: they join to the whole text."""

    def __init__(self, pattern: str):
        self.far = regex.compile(pattern)

    def __call__(self, text: str) -> list[str]:
        return self.far.findall(text) if beyond(text) else _BYTE_NEAR.findall(text)


def word_cut(text: str) -> list[str]:
    """Pre-tokens of the lower-casing word vocabulary.  A capital sigma has one small form, wherever it stands."""
    near = not beyond(text)
    text = unicodedata.normalize("NFC", text)
    return _WORD_NEAR.findall(text.lower()) if near else _WORD_FAR.findall(text.replace("\u03a3", "\u03c3").lower())
