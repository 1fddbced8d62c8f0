"""Whole-text encoding by the tokenizers library, with the ids of frequent units kept.

Both vocabularies split a text at white space before they merge anything, so the ids of a text
are the ids of its units in order. A unit is encoded by the library once for each worker; then
a text costs one look-up for each unit. Texts with control or separator characters that regex
dialects class differently are encoded whole, and so are texts that hold an added token such as
<|endoftext|>, which the library takes out before it splits.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable

#: White space on which Unicode and the regex dialects involved agree.
_SPACE = r"\t-\r \xa0\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What they may class differently: separators of old, next line, the Ogham and Mongolian spaces, joiners.
_ODD = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x9f\u0085\u1680\u180e\u200b\u2060\ufeff]")
_UNITS = {
    # A space before a word belongs to it; of a longer run of white space the last one may.
    "byte_level": re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"),
    # White space is dropped.
    "word_level": re.compile(rf"[^{_SPACE}]+"),
}
# Texts of Latin-1 characters only are split into the vocabularies' own pre-tokens, which the
# library's model encodes directly; those texts need no normalising but lower case.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
_LATIN = {
    "byte_level": re.compile(rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"),
    "word_level": re.compile(rf"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[^{_S}{_L}{_N}]+"),
}
#: Units that a worker keeps in a generation; there are two. It bounds memory, not results. Byte-level
#: units have their space and case, so there are more of them.
KEPT_UNITS = {"byte_level": 700_000, "word_level": 300_000}
_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabets write a printable byte as itself, the others as letters from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def _pack(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class Kept:
    """The ids of units in two generations: a full young one becomes the old one, from which used units return."""

    def __init__(self, encode: Callable[[str], bytes], most: int):
        self.encode, self.most = encode, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, units: list[str]) -> list[bytes | None]:
        """The ids of each unit, None for those not in the young generation."""
        return list(map(self.young.get, units))

    def fill(self, units: list[str], found: list[bytes | None]) -> None:
        """Put the missing ids into `found` and the young generation."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        for i in [i for i, ids in enumerate(found) if ids is None]:
            unit = units[i]
            ids = young.get(unit) or old.get(unit)
            if ids is None:
                ids = self.encode(unit)
            young[unit] = found[i] = ids


class Encoder:
    """encode(texts) gives each text's ids, add_special_tokens=False, as little-endian uint32."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.units, self.latin, self.lower = _UNITS[kind], _LATIN[kind], kind == "word_level"
        self.letters = _byte_letters()
        self.kept, self.pretokens = Kept(self._whole_unit, KEPT_UNITS[kind] // 4), Kept(self._pretoken, KEPT_UNITS[kind])

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [_pack(x.ids) for x in found]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self._one(t) if t else b"" for t in texts]

    def _one(self, text: str) -> bytes:
        for token in self.added:
            if token in text:
                return self.whole([text])[0]
        try:
            text.isascii() or text.encode("latin-1")
        except UnicodeEncodeError:
            return self._joined(text, self.units.findall(text), self.kept)
        if self.lower:
            text = text.lower()
        return self._joined(text, self.latin.findall(text), self.pretokens)

    def _joined(self, text: str, units: list[str], kept: Kept) -> bytes:
        found = kept.ids(units)
        try:
            return b"".join(found)
        except TypeError:  # some are missing
            pass
        if _ODD.search(text):
            return self.whole([text])[0]
        kept.fill(units, found)
        return b"".join(found)

    def _whole_unit(self, unit: str) -> bytes:
        return self.whole([unit])[0]

    def _pretoken(self, pretoken: str) -> bytes:
        spelt = (pretoken if pretoken.isascii() else pretoken.encode().decode("latin-1")).translate(self.letters)
        return _pack([t.id for t in self.model.tokenize(spelt)])


def encoder(path: str, kind: str) -> Encoder:
    key = (path, kind)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, kind)
    return _ENCODERS[key]
