"""Token ids of whole texts by the ``tokenizers`` library, with a memory.

A byte-level BPE splits text with a fixed pattern before it merges.  That
pattern always has a boundary before a blank whose left neighbour is no white
space, so a text may be cut there into *units* (`` word``) whose ids simply
follow one another.  Units repeat, so each worker keeps a bounded table of
unit -> ids and asks the library only for units it has not seen.
"""

from __future__ import annotations

import array
import json
import re

from .common import per_process

#: Units remembered by one Python worker, about 210 bytes each, unless the caller says otherwise.
MAX_UNITS = 400_000
#: Longer units are encoded but not remembered.
MAX_UNIT_CHARS = 64

#: Text bytes that are handled at once.
BATCH_BYTES = 6 << 20

#: A blank after white space, as :data:`_AFTER_SPACE`, in Arrow's regular expressions.
_ODD = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_AFTER_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
_L = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Texts of these characters alone fall into letters, digits, white space and others by plain ranges.
_PLAIN = re.compile(f"[\\t\\n\\r -~{_L}]*")
_SPLIT_PLAIN = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[0-9]+| ?[^\\s{_L}0-9]+|\\s+(?!\\S)|\\s+")

_WORD = re.compile(f" ?[{_L}]+")
_WORD_END = frozenset(c for c in map(chr, range(0x250)) if re.match(f"[0-9{_L}]", c))


def after_blanks(text: str) -> list[str]:
    """The text cut at every blank that follows a non-blank (these blanks left out)."""
    if _AFTER_SPACE.search(text):
        first, *rest = _CUT.split(text)
        return [first, *[x[1:] for x in rest]]
    return text.split(" ")


def byte_alphabet() -> dict[int, str]:
    """Byte -> the character that stands for it in byte-level vocabularies."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return {b: chr(b if b in printable else next(spare)) for b in range(256)}


class Units(dict):
    """word -> ids of a blank and the word, as little-endian uint32 bytes, in
    bounded memory: once the table has ``max_units`` / 2 entries it becomes
    the older half, from which words are taken over as they come up again.
    ``bare`` does without the blank."""

    def __init__(self, max_units: int | None = None):
        self.max_units = max_units or MAX_UNITS
        self.older: dict[str, bytes] = {}
        self.bares: dict[str, bytes] = {}

    def ids(self, unit: str) -> bytes:
        """The ids of a unit that is not remembered."""
        raise NotImplementedError

    def bare(self, unit: str) -> bytes:
        out = self.bares.get(unit)
        if out is None:
            if len(self.bares) > self.max_units // 8:
                self.bares.clear()
            out = self.ids(unit)
            if len(unit) <= MAX_UNIT_CHARS:
                self.bares[unit] = out
        return out

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            if word[-1:] in ".,;:!?" and word[-2:-1] in _WORD_END:  # the mark is a piece of its own
                out = self[word[:-1]] + self.bare(word[-1])
            else:
                out = self.ids(" " + word)
        if len(word) < MAX_UNIT_CHARS:
            self[word] = out
        return out

    def together(self, pieces: list[str]) -> bytes:
        return b"".join([self[p[1:]] if p[0] == " " else self.bare(p) for p in pieces])

    def encode(self, text: str) -> bytes:
        """All ids of the text."""
        first, *rest = after_blanks(text)
        out = self.bare(first) + b"".join(map(self.__getitem__, rest))
        if len(self) > self.max_units // 2:
            self.older = self.copy()
            self.clear()
        return out

    def encode_all(self, texts) -> list[bytes]:
        """All ids of each text of a non-null Arrow string array.  Words are
        told apart in Arrow, so only the different ones of some texts become
        Python objects; the ids are put together from theirs."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts.cast(pa.large_string())
        out: list[bytes] = []
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + BATCH_BYTES, side="right")))
            out += self._encode_some(texts.slice(at, to - at))
            at = to
        return out

    def _encode_some(self, texts) -> list[bytes]:
        import numpy as np
        import pyarrow.compute as pc

        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(texts, " ")
        first = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        words = cut.flatten().dictionary_encode()
        code, different = words.indices.to_numpy().astype(np.int64), words.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.__getitem__, different))
        found += [b"" if o else self.bare(different[k]) for o, k in zip(odd, code[first], strict=True)]  # no blank before a text's first word
        code[first] = len(different) + np.arange(len(first))
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        start = np.cumsum(size) - size
        n = size[code]
        ids = np.frombuffer(b"".join(found), dtype="<u4")
        kind = np.int32 if n.sum() < 1 << 31 else np.int64
        place = np.repeat((start[code] - (np.cumsum(n) - n)).astype(kind), n)
        place += np.arange(len(place), dtype=kind)
        flat = ids[place]
        ends = np.cumsum(np.add.reduceat(n, first)).tolist()
        out = [self.encode(t.as_py()) if o else flat[a:b].tobytes() for t, o, a, b in zip(texts, odd, [0, *ends], ends, strict=False)]
        if len(self) > self.max_units // 2:
            self.older = self.copy()
            self.clear()
        return out


def byte_level(path: str) -> dict:
    """The specification in a tokenizer file, if it is of the kind that units
    are right for: a plain byte-level BPE that splits by the usual pattern and
    takes text as it is.  Any other raises ValueError."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [what for what, bad in (
        ("its model is no BPE", model.get("type", "BPE") != "BPE"),
        ("it changes text first (normalizer)", spec.get("normalizer")),
        ("its pre-tokenizer is not byte-level with the usual pattern", split.get("type") != "ByteLevel" or not split.get("use_regex", True)),
        ("it puts a blank before texts", split.get("add_prefix_space", True)),
        ("its words have prefixes or suffixes", model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")),
        ("its merges are random or left out", model.get("dropout") or model.get("ignore_merges")),
        ("its bytes are not all tokens", not set(byte_alphabet().values()) <= set(model.get("vocab", ()))),
        ("its added tokens hold blanks, match beside them, in words alone or in changed text",
         any(" " in t["content"] or any(t.get(flag) for flag in ("lstrip", "rstrip", "single_word", "normalized")) for t in spec.get("added_tokens") or ())),
    ) if bad]
    if wrong:
        raise ValueError(f"{path}: not a tokenizer that this operator encodes for: {'; '.join(wrong)}")
    return spec


class UnitEncoder(Units):
    """Units by the ``tokenizers`` library: ids as ``Tokenizer.encode`` gives them."""

    def __init__(self, path: str, max_units: int | None = None):
        from tokenizers import Tokenizer

        super().__init__(max_units)
        byte_level(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        alphabet = byte_alphabet()
        #: plain character -> its bytes in the vocabulary's alphabet
        self.spelled = {c: "".join(alphabet[b] for b in chr(c).encode()) for c in range(0x250)}
        self.merge = self.library.model.tokenize
        #: tokens of their own, without a merge (the vocabulary's words in its alphabet)
        self.whole = {t: array.array("I", [i]).tobytes() for t, i in self.library.get_vocab(with_added_tokens=False).items() if [x.id for x in self.merge(t)] == [i]}
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: whether no added token goes beyond a line
        self.lines = not any("\n" in a for a in self.added)

    def ids(self, unit: str) -> bytes:
        bare = unit[1:] if unit[:1] == " " else unit
        if bare.isascii() and bare.isalpha():  # letters stand for themselves
            mapped = unit if bare is unit else self.spelled[32] + bare
            return self.whole.get(mapped) or array.array("I", [t.id for t in self.merge(mapped)]).tobytes()
        if unit.count("\n") == 1 and self.lines:
            # a line end between characters that are no white space is a piece of its own
            a, b = unit.split("\n", 1)
            if a and b and not a[-1].isspace() and not b[0].isspace():
                return (self[a[1:]] if a[0] == " " else self.bare(a)) + self.bare("\n") + self.bare(b)
        word = _WORD.fullmatch(unit)
        if word or _PLAIN.fullmatch(unit) and not any(a in unit for a in self.added):
            pieces = [unit] if word else _SPLIT_PLAIN.findall(unit)
            if len(pieces) > 1:
                return self.together(pieces)
            mapped = unit.translate(self.spelled)
            return self.whole.get(mapped) or array.array("I", [t.id for t in self.merge(mapped)]).tobytes()
        return array.array("I", self.library.encode(unit, add_special_tokens=False).ids).tobytes()


def unit_encoder(path: str, max_units: int | None = None) -> UnitEncoder:
    return per_process(("units", path, max_units), lambda: UnitEncoder(path, max_units))
