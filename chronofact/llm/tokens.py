"""Token ids of texts, by the tokenizers library.

Byte-level BPE never merges across the pieces of its split pattern, and that pattern always starts a new piece at a
space that follows a non-space. So texts are cut there, a slice of a few megabytes at a time; Arrow numbers the different
pieces of the slice, the library encodes each of these once, and numpy lays their ids out. Ids of pieces that repeat are
remembered from slice to slice, in a memory bounded in bytes.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A run of white space up to its last character, a word with a space before it, or one character of white space: cuts
#: that agree with those of the tokenizer's own pattern.
PIECE = re.compile(r"\s+(?!\S)| ?\S+|\s")
#: White space to re, but not to the tokenizer: texts with these go to the library whole.
ODD = "".join(map(chr, (0, *range(0x1C, 0x20))))
#: What needs PIECE: white space other than spaces and line ends, and runs of these.
SPACES = "".join(map(chr, (0x09, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPACED = rf"[{SPACES}]|  |\n\n| \n|\n "
#: Bytes of text that are cut into pieces at a time; a longer text is a slice of its own.
SLICE = 2 << 20
#: Bytes of remembered pieces, over both generations.
MEMORY = 32 << 20
#: Marks that end a piece of letters and are a piece of their own to the tokenizer. No apostrophe: it may start a piece with letters.
MARKS = "!#$%&()*+,-./:;<=>?@"
#: Characters of the longest piece that is remembered.
LONGEST = 64


def _byte_characters() -> dict[int, str]:
    """The character that byte-level BPE writes for each byte: printable ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def slices(texts: pa.Array, most: int | None = None) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of runs of texts of `most` bytes (SLICE) or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, most = 0, most or SLICE
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of runs with these starts and lengths, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """Ids as the library gives them without added special tokens. A special token's own string in a text is that token, as
    it is to the library by default; with special_as_text it is ordinary text. memory: bytes of remembered pieces; two
    generations of half of it are kept, so that what is in use outlives the others."""

    def __init__(self, path: str, special_as_text: bool = False, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # pieces that come again are remembered here
        self.table = _byte_characters()
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.whole = "|".join([f"[{ODD}]", *added])
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.memory, self.used = memory, 0
        self.tails: dict[str, list[int]] = {}

    def _by_library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _tail(self, text: str) -> list[int]:
        """Ids of a run of marks, which is a piece of its own to the tokenizer. Up to a thousand short runs are remembered."""
        if len(text) > LONGEST:
            return self._by_library([text])[0]
        if text not in self.tails:
            if len(self.tails) > 1000:
                self.tails.clear()
            self.tails[text] = self._by_library([text])[0]
        return self.tails[text]

    def _letters(self, word: str) -> list[int]:
        """Ids of letters with or without a space before: one piece, so the library's model gets it without its splitter."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.table)
        elif word[0] == " ":
            word = self.table[0x20] + word[1:]
        return [x.id for x in self.model.tokenize(word)]

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after the other, and how many each has."""
        ids, counts, rest = [], [], []
        for p in pieces:
            if (p[1:] if p[0] == " " else p).isalpha():
                own = self._letters(p)
            elif (p[1 : len(stem)] if p[0] == " " else stem).isalpha() if len(stem := p.rstrip(MARKS)) < len(p) else False:
                own = self._letters(stem) + self._tail(p[len(stem) :])
            else:
                rest.append(p)
                counts.append(-1)
                continue
            ids += own
            counts.append(len(own))
        ids, counts = np.array(ids, np.uint32), np.array(counts, np.int64)
        if not rest:
            return ids, counts
        found = self._by_library(rest)
        other = counts < 0
        counts[other] = [len(x) for x in found]
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        out[_spread(starts[other], counts[other])] = [x for own in found for x in own]
        out[_spread(starts[~other], counts[~other])] = ids
        return out, counts

    def _remember(self, piece: str, ids: bytes) -> None:
        if self.used > self.memory // 2:
            self.old, self.known, self.used = self.known, {}, 0
        self.known[piece] = ids
        self.used += sys.getsizeof(piece) + sys.getsizeof(ids) + 100  # 100: an entry of the dictionary

    def _of_pieces(self, pieces: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after the other, and how many each has. counts: pieces of each text."""
        numbered = pieces.dictionary_encode()
        place, words = numbered.indices.to_numpy(), numbered.dictionary.to_pylist()
        del numbered
        own: list[bytes | None] = [self.known.get(w) if w else b"" for w in words]
        for i in [i for i, x in enumerate(own) if x is None]:
            if (ids := self.old.get(words[i])) is not None:
                own[i] = ids
                self._remember(words[i], ids)
        new = [i for i, x in enumerate(own) if x is None]
        fresh, sizes_new = self._learn([words[i] for i in new])
        sizes = np.fromiter((len(x) // 4 if x is not None else 0 for x in own), np.int64, len(own))
        flat = np.frombuffer(b"".join(x for x in own if x is not None), "<u4")
        starts = np.cumsum(sizes) - sizes
        sizes[new], starts[new] = sizes_new, len(flat) + np.cumsum(sizes_new) - sizes_new
        flat = np.concatenate([flat, fresh])
        often = np.bincount(place, minlength=len(words)) > 1
        for i in new:
            if often[i] and len(words[i]) <= LONGEST:
                self._remember(words[i], flat[starts[i] : starts[i] + sizes[i]].tobytes())
        lengths = sizes[place]
        before = np.concatenate([[0], np.cumsum(lengths)])
        ids = flat[_spread(starts[place], lengths)]
        return ids, np.diff(before[np.cumsum(counts)], prepend=0)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none) one after the other, and the end of each text's."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        spaced = pc.match_substring_regex(texts, SPACED).to_numpy(zero_copy_only=False) & ~whole
        groups = []
        if (rows := np.flatnonzero(~whole & ~spaced)).size:
            cut = pc.replace_substring(pc.replace_substring(texts.take(rows), " ", "\0 "), "\n", "\0\n\0")
            cut = pc.split_pattern(cut, "\0")
            groups.append((rows, *self._of_pieces(cut.flatten(), np.diff(cut.offsets.to_numpy()))))
        if (rows := np.flatnonzero(spaced)).size:
            found = [PIECE.findall(t) for t in texts.take(rows).to_pylist()]
            flat = pa.array([p for own in found for p in own], pa.large_string())
            groups.append((rows, *self._of_pieces(flat, np.array([len(own) for own in found]))))
        if (rows := np.flatnonzero(whole)).size:
            found = [np.array(x, np.uint32) for x in self._by_library(texts.take(rows).to_pylist())]
            groups.append((rows, np.concatenate(found), np.array([len(x) for x in found])))
        if len(groups) == 1:
            return groups[0][1], np.cumsum(groups[0][2])
        sizes = np.zeros(len(texts), np.int64)
        for rows, _, n in groups:
            sizes[rows] = n
        ends = np.cumsum(sizes)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        for rows, ids, n in groups:
            out[_spread((ends - sizes)[rows], n)] = ids
        return out, ends

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in turn; a slice of texts is held at a time."""
        for _, some in slices(texts):
            ids, ends = self.encode_array(some)
            at = 0
            for end in ends.tolist():
                yield ids[at:end]
                at = end

    def encode(self, text: str | None) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit integers."""
        return self.encode_array(pa.array([text], pa.large_string()))[0].astype("<u4").tobytes()


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One for each worker process and vocabulary."""
    key = (path, special_as_text)
    if key not in _encoders:
        _encoders[key] = Encoder(path, special_as_text)
    return _encoders[key]
