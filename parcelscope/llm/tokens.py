"""Token ids by way of the tokenizers library, with a bounded cache of text pieces.

A text is cut only where no token can cross and nothing on one side changes the other:

* ``byte level``: before a single white-space character between two others that are none;
  the pre-tokenizer gives that character to what follows or makes it a token of its own;
* ``word level``: at blanks, tabs and line ends, which that tokenizer drops;
* either: before a full stop or comma after a letter or digit, if the text has these marks only there.

Cutting and telling equal pieces apart is done on Arrow columns, a slice of texts at a time; texts that need care (NUL, or
runs of white space) are cut one by one. Equal pieces are encoded once; pieces not seen yet are encoded
together, a bar as a word of its own between them, so that its id says where one ends. Words of common letters need no bar if the
tokenizer marks the last id of each word. Ids are kept as little-endian
unsigned 32-bit bytes, so a document is a span of the bytes of its pieces.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROUGH = re.compile(r"\s\s")
SINGLE = re.compile(r"(?<=\S)(?=\s\S)")
WORD_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"  # letters that stay one letter when normalised
PLAIN_LETTERS = "0-9" + WORD_LETTERS
PLAIN_WORD = re.compile(f"[{WORD_LETTERS}]+")
STRAY = re.compile(f"(?<![{PLAIN_LETTERS}])[.,]")
#: The same two as patterns for columns.
STRAY_IN = f"(?:^|[^{PLAIN_LETTERS}])[.,]"
ROUGH_IN = "[\t-\r\x1c- \x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2}"
NO_BAR = re.compile(r"[^|]*")
MAY_FOLLOW = re.compile(r"\s[^\s|](?:[^|]*[^\s|])?")  # byte-level pieces that may stand right after another one in a joined text
SLICE_BYTES = 1 << 20  # text cut at once; one longer document is cut alone
GROUP = 100  # pieces encoded in one call
_CACHES: dict[tuple[str, int], PieceCache] = {}


class PieceCache:
    def __init__(self, path: str, limit: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the generation before; pieces met again move up
        one, two = (self.tokenizer.encode(t, add_special_tokens=False).ids for t in ("a b", "a\tb"))
        self.word_level = one == two  # white space leaves no trace in the ids
        (self.bar,) = self.tokenizer.encode(" |", add_special_tokens=False).ids
        self.last = self._last_ids() if self.word_level else None

    def _last_ids(self) -> np.ndarray | None:
        """Which ids stand at the end of a word, if every word of common letters ends with such an id and has no other."""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            return None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        letters = [c for c in map(chr, range(0x250)) if PLAIN_WORD.fullmatch(c)]
        each = [last[e.ids].tolist() for e in self.tokenizer.encode_batch_fast(letters, add_special_tokens=False)]
        return last if all(marks[-1:] == [True] and sum(marks) == 1 for marks in each) else None

    def pieces(self, text: str) -> list[str]:
        if "\0" in text:
            return text.split(" ") if self.word_level else SINGLE.split(text)
        if not STRAY.search(text):
            text = text.replace(",", "\0,").replace(".", "\0.")
        if self.word_level:
            return text.replace("\n", "\0").replace(" ", "\0").split("\0")
        if ROUGH.search(text):
            return [p for part in SINGLE.split(text) for p in part.split("\0")]
        return text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")

    def _learn(self, fresh: list[str]) -> None:
        if self.last is not None:
            kinds = list(map(PLAIN_WORD.fullmatch, fresh))
            plain = [p for p, kind in zip(fresh, kinds, strict=True) if kind]
            fresh = [p for p, kind in zip(fresh, kinds, strict=True) if not kind]
            for at in range(0, len(plain), GROUP):
                part = plain[at : at + GROUP]
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
                ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
                self._keep(part, ids.tobytes(), ends, [0, *ends[:-1]])
        fits = list(map((NO_BAR if self.word_level else MAY_FOLLOW).fullmatch, fresh))
        joint = [p for p, fit in zip(fresh, fits, strict=True) if fit]
        alone = [p for p, fit in zip(fresh, fits, strict=True) if not fit]
        for at in range(0, len(alone), 1000):
            part = alone[at : at + 1000]
            for piece, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[piece] = np.array(got.ids, dtype="<u4").tobytes()
        gap = " | " if self.word_level else " |"
        for at in range(0, len(joint), GROUP):
            part = joint[at : at + GROUP]
            ids = np.array(self.tokenizer.encode_batch_fast([gap.join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            marks = np.flatnonzero(ids == self.bar)
            self._keep(part, ids.tobytes(), [*(4 * marks).tolist(), 4 * len(ids)], [0, *(4 * marks + 4).tolist()])

    def _keep(self, pieces: list[str], raw: bytes, ends: list[int], starts: list[int]) -> None:
        self.known.update(zip(pieces, map(raw.__getitem__, map(slice, starts, ends)), strict=True))

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces, learned where they are new."""
        if len(self.known) > self.limit:
            self.older, self.known = self.known, {}
        got = list(map(self.known.get, pieces))
        missing = [p for p, ids in zip(pieces, got, strict=True) if ids is None]
        if missing:
            again = [(p, ids) for p in missing if (ids := self.older.get(p)) is not None]
            self.known.update(again)
            self._learn([p for p in missing if p not in self.known] if again else missing)
            got = [self.known[p] if ids is None else ids for p, ids in zip(pieces, got, strict=True)]
        return got

    def _cut(self, texts: pa.Array) -> list[tuple[np.ndarray, pa.Array, np.ndarray]]:
        """(places of texts, their pieces, where each text's pieces begin) for the kinds of texts."""
        zero = pc.match_substring(texts, "\0")
        odd = zero if self.word_level else pc.or_(zero, pc.match_substring_regex(texts, ROUGH_IN))
        stray = pc.match_substring_regex(texts, STRAY_IN)
        out = []
        for marks in (True, False):
            chosen = pc.and_not(pc.invert(odd), stray) if marks else pc.and_not(stray, odd)
            at = np.flatnonzero(chosen.to_numpy(zero_copy_only=False))
            if not len(at):
                continue
            some = texts.take(pa.array(at))
            for sign in ",." * marks:
                some = pc.replace_substring(some, sign, "\0" + sign)
            for blank in "\n ":
                some = pc.replace_substring(some, blank, "\0" if self.word_level else "\0" + blank)
            lists = pc.split_pattern(some, "\0")
            out.append((at, lists.flatten(), lists.offsets.to_numpy()))
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(at):
            cut = [self.pieces(t) for t in texts.take(pa.array(at)).to_pylist()]
            out.append((at, pa.array([p for c in cut for p in c], pa.large_string()), np.concatenate([[0], np.cumsum([len(c) for c in cut])])))
        return out

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text as bytes."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy())
        low = 0
        while low < len(texts):
            past = sizes[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(sizes, past + SLICE_BYTES, side="right")))
            out: list[bytes] = [b""] * (high - low)
            for at, pieces, off in self._cut(texts.slice(low, high - low)):
                coded = pieces.dictionary_encode()
                ids = pa.array(self._ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(coded.indices)
                raw = ids.buffers()[2]
                ends = np.frombuffer(ids.buffers()[1], dtype=np.int64)[: len(ids) + 1][off].tolist() if len(ids) else [0] * len(off)
                for i, a, b in zip(at.tolist(), ends[:-1], ends[1:], strict=True):
                    out[i] = raw[a:b].to_pybytes() if b > a else b""
            yield from out
            low = high

    def encode(self, texts: list[str]) -> list[bytes]:
        return list(self.encode_column(pa.array(texts, pa.large_string())))


def piece_cache(path: str, limit: int = 300_000) -> PieceCache:
    """The worker's cache for a tokenizer file; it holds two generations of ``limit`` pieces and a batch at most."""
    if (path, limit) not in _CACHES:
        _CACHES[path, limit] = PieceCache(path, limit)
    return _CACHES[path, limit]
