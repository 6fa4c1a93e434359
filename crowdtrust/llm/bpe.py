"""Exact BPE encoding by backtracking, and decoding by an offset table.

Encoding of one piece (what the split pattern gives): an Aho-Corasick pass
lists every vocabulary token inside the piece, hence the longest one that
starts at each byte.  Tokens are laid left to right, longest first.  A token
may follow another only if the two are *compatible*: encoding their joint
bytes gives exactly these two.  That is read off the merge table by taking the
two apart again, and kept in a table.  If no shorter token fits either, the
position is marked dead and the last token is given up for a shorter one.  A
position is given up once at most, so the work is linear in the piece.

A sequence whose neighbours are all compatible is the BPE encoding of its
bytes, so the ids equal those of merging by rank.

Decoding: all tokens' bytes lie in one blob; ``offsets[id]`` says where.  A
whole id sequence is gathered from the blob at once.
"""

from __future__ import annotations

import array
import hashlib
import re

from pyspark.sql import DataFrame

from .common import id_and_text, per_process
from .tokens import _PLAIN, _SPLIT_PLAIN, _WORD, Units, byte_alphabet, byte_level

SCHEMA = "doc_id long, ids binary, n_tokens long, ids_sha256 string, decoded string, decoded_sha256 string"
#: Pieces of text whose ids a worker remembers (see ``tokens.Units``).
WORKER_UNITS = 1_200_000
#: Compatible and incompatible pairs remembered by one Python worker.
MAX_PAIRS = 1_000_000


class BacktrackingBPE(Units):
    """Units by backtracking (see ``tokens.Units``).

    Inside, tokens are numbered by merge rank: 0..255 single bytes, 256 + i
    the result of merge i.
    """

    def __init__(self, path: str, max_units: int | None = None):
        import ahocorasick
        import numpy as np
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__(max_units)
        spec = byte_level(path)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        byte_of = {c: b for b, c in byte_alphabet().items()}
        self.to_bytes = {ord(c): b for c, b in byte_of.items()}
        text_of = sorted(byte_of, key=byte_of.get)
        rank = {c: b for b, c in enumerate(text_of)}
        self.parts = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for pair in merges:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.joined[rank[left], rank[right]] = r = len(text_of)
            self.parts.append((rank[left], rank[right]))
            text_of.append(left + right)
            rank[left + right] = r
        raw = ["".join(chr(byte_of[c]) for c in t) for t in text_of]
        self.size = [len(t) for t in raw]
        self.public_id = [vocab[t] for t in text_of]
        automaton = ahocorasick.Automaton()
        for r, t in enumerate(raw):
            automaton.add_word(t, r)
        automaton.make_automaton()
        self.matches = automaton.iter
        by_text = {t: r for r, t in enumerate(raw)}
        self.shorter = [next((by_text[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_text), -1) for t in raw]
        self.fits: dict[tuple[int, int], bool] = {}
        self.split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        # decoding: bytes of id i are blob[offsets[i]:offsets[i + 1]]
        by_id = {i: t.encode("latin-1") for i, t in zip(self.public_id, raw, strict=True)} | {i: t.encode() for t, i in self.added.items()}
        sizes = np.zeros(max(by_id) + 2, dtype=np.int64)
        for i, t in by_id.items():
            sizes[i + 1] = len(t)
        self.offsets = np.cumsum(sizes)
        self.blob = np.frombuffer(b"".join(by_id[i] for i in sorted(by_id)), dtype=np.uint8)

    def compatible(self, a: int, b: int) -> bool:
        """True if the encoding of a's and b's joint bytes is [a, b]: no merge
        across the seam comes before the merges that made a and b."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > MAX_PAIRS:
                self.fits.clear()
            known = self.fits[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        joined, parts = self.joined, self.parts
        below = len(parts) + 1  # a merge across the seam of a lower rank than this would have come first
        while True:
            if joined.get((a, b), below) < below:
                return False
            # undo the later of the two last merges; at equal rank, merging runs left to right
            if a > b and a >= 256:
                below, a = a, parts[a][1]
            elif b >= 256:
                below, b = b + 1, parts[b][0]
            elif a >= 256:
                below, a = a, parts[a][1]
            else:
                return True

    def piece(self, piece: str) -> list[int]:
        """Ranks of the tokens of a piece (bytes as latin-1 characters)."""
        n, size, shorter, fits = len(piece), self.size, self.shorter, self.compatible
        longest = [0] * n
        reach = [0] * n
        for end, r in self.matches(piece):
            start = end - size[r] + 1
            if size[r] > reach[start]:
                reach[start], longest[start] = size[r], r
        alive = [True] * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0 and not (alive[at + size[token]] and (not out or fits(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
            else:
                alive[at] = False
                last = out.pop()
                at -= size[last]
                token = shorter[last]
        return out

    def _pieces(self, text: str) -> list[str]:
        """What the split pattern gives, bytes as latin-1 characters.  Beyond
        the plain alphabet the library's own splitter has the say, since
        Unicode classes differ from one regex engine to the next."""
        if _PLAIN.fullmatch(text):
            return [p.encode().decode("latin-1") for p in _SPLIT_PLAIN.findall(text)]
        return [p.translate(self.to_bytes) for p, _ in self.split(text)]

    def ids(self, unit: str) -> bytes:
        word = _WORD.fullmatch(unit)
        if not word and self.cut_added and self.cut_added.search(unit):
            parts = self.cut_added.split(unit)
            return b"".join(array.array("I", [self.added[p]]).tobytes() if k % 2 else self.bare(p) for k, p in enumerate(parts))
        if not word and _PLAIN.fullmatch(unit) and len(pieces := _SPLIT_PLAIN.findall(unit)) > 1:
            return self.together(pieces)
        return array.array("I", [self.public_id[r] for p in self._pieces(unit) for r in self.piece(p)]).tobytes()

    def decode(self, ids: bytes) -> str:
        import numpy as np

        i = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        start, size = self.offsets[i], self.offsets[i + 1] - self.offsets[i]
        shift = np.repeat(start - (np.cumsum(size) - size), size)
        return self.blob[np.arange(len(shift)) + shift].tobytes().decode("utf-8", errors="replace")


def backtracking_bpe(path: str) -> BacktrackingBPE:
    return per_process(("backtracking", path), lambda: BacktrackingBPE(path, WORKER_UNITS))


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text encoded and decoded again, one row per input row.

    Columns: doc_id, ids (little-endian uint32 bytes), n_tokens, ids_sha256,
    decoded, decoded_sha256.  Null text counts as empty (no tokens); a null
    id stays null; repeated rows give repeated rows; an empty table gives an
    empty one; other columns are not read.  Narrow: no shuffle.  A worker
    holds one Arrow batch of texts plus tables of bounded size.

    ``vocabulary``: path of a byte-level BPE in the ``tokenizers`` JSON
    format, readable on every worker.
    """

    def run(batches):
        import pyarrow as pa

        bpe = backtracking_bpe(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = bpe.encode_all(part.column("text"))
                back = [bpe.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array(back, pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string())],
                    names=["doc_id", "ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
