"""Token ids of many texts by the tokenizers library, each distinct piece encoded once.

Both kinds of vocabulary cut a text at white space before they merge symbols, so the ids of a
text are those of its pieces in order. Arrow splits and numbers the pieces of a whole batch, the
library encodes the pieces that it hasn't seen yet, and numpy puts the ids together.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space in the sense of any of the libraries, as an RE2 class.
_SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: White space beside a space or line end, or at either end of the text: the pieces there aren't independent.
_TIGHT = rf"(?:[ \n]{_SPACE}|{_SPACE}[ \n]|^{_SPACE}|{_SPACE}$|\x02)"
#: A full stop or comma after anything but a Latin-1 letter or a digit: punctuation may run on into it.
_RUN = r"[^A-Za-z0-9\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff} ][.,] "
#: Marks a full stop or comma that no space stands before.
_JOINED = "\x02"
#: Text that is cut up at once, and pieces that are remembered.
#: in memory that is shared with other stages, and where an encoder has the worker for itself.
_SMALL, _ROOMY = (6 << 20, 500_000), (16 << 20, 1_000_000)
_MARK = "\x1e"


class PieceEncoder:
    """Ids of texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    Strings of special tokens inside a text are ordinary text. ``keeps_space`` tells whether the
    vocabulary encodes white space (byte level) or drops it (word ends).
    """

    def __init__(self, path: str, keeps_space: bool, roomy: bool = False):
        self.slice_bytes, self.remember = _ROOMY if roomy else _SMALL
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.keeps_space = keeps_space
        self.glue = "\n" if keeps_space else f" {_MARK} "
        mark = self._whole(self.glue)
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.used = np.empty(1 << 16, np.int32), 0
        self.start, self.length = np.empty(1 << 14, np.int32), np.empty(1 << 14, np.int32)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _add(self, words: list[str], ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        n, more = len(self.known), len(ids)
        while self.used + more > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while n + len(words) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.length))
        self.pool[self.used : self.used + more] = ids
        self.start[n : n + len(words)], self.length[n : n + len(words)] = self.used + start, length
        self.used += more
        self.known.update(zip(words, range(n, n + len(words))))

    def _learn(self, new: list[str]) -> None:
        """Encodes pieces, many glued to one text, and appends their ids to the pool."""
        alone = new
        if self.mark is not None:
            alone = [x for x in new if _MARK in x or "\n" in x or not x.strip()]
            if alone:
                seen = set(alone)
                new = [x for x in new if x not in seen]
            groups = [new[i : i + 400] for i in range(0, len(new), 400)]
            glued = [self.glue.join(g) + self.glue for g in groups]
            ids = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(glued, add_special_tokens=False)]
            fits = [np.count_nonzero(x == self.mark) == len(g) for x, g in zip(ids, groups)]
            alone += [x for g, fit in zip(groups, fits) if not fit for x in g]
            words = [x for g, fit in zip(groups, fits) if fit for x in g]
            if words:
                run = np.concatenate([x for x, fit in zip(ids, fits) if fit])
                end = np.flatnonzero(run == self.mark)
                start = np.concatenate([[0], end[:-1] + 1])
                self._add(words, run, start, end - start)
        if alone:
            ids = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)]
            length = np.array([len(x) for x in ids])
            self._add(alone, np.concatenate(ids), np.cumsum(length) - length, length)

    def _entries(self, pieces: list[str]) -> np.ndarray:
        get = self.known.get
        at = np.fromiter((get(x, -1) for x in pieces), np.int32, len(pieces))
        unknown = np.flatnonzero(at < 0).tolist()
        if unknown:
            self._learn([pieces[i] for i in unknown])
            at[unknown] = [self.known[pieces[i]] for i in unknown]
        return at

    @staticmethod
    def _plainer(texts: pa.Array) -> pa.Array:
        """Texts with the same ids, and fewer distinct pieces, for a vocabulary without case and white space.

        A full stop or comma between a word and white space is a piece of its own. After characters
        that may be punctuation, or become a letter and a mark in lower case, the text stays as it is.
        """
        texts = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
        return PieceEncoder._parted(texts, "")

    @staticmethod
    def _parted(texts: pa.Array, mark: str) -> pa.Array:
        apart = pc.replace_substring(pc.replace_substring(texts, ". ", f" {mark}. "), ", ", f" {mark}, ")
        return pc.if_else(pc.match_substring_regex(texts, _RUN), texts, apart)

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose pieces are independent, and how many each has."""
        spaced = self._parted(pc.replace_substring(texts, "\n", " \n "), _JOINED) if self.keeps_space else self._plainer(texts)
        lists = pc.split_pattern(spaced, " ")
        coded = lists.flatten().dictionary_encode()
        words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        if self.keeps_space:
            newline = np.fromiter((x == "\n" for x in words), bool, len(words))[code]
            bare = newline.copy()
            bare[1:] |= newline[:-1]
            bare[bounds[:-1]] = True
            code = 2 * code + bare
            present = np.zeros(2 * len(words), bool)
            present[code] = True
            used = np.flatnonzero(present)
            entry = np.zeros(2 * len(words), np.int32)
            known = [(words[i >> 1], i & 1) for i in used.tolist()]
            entry[used] = self._entries([w[1:] if w[:1] == _JOINED else w if alone else " " + w for w, alone in known])
        else:
            entry = self._entries(words)
        at = entry[code]
        lengths = self.length[at]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        shift = self.start[at] - upto[:-1].astype(np.int32)
        ids = self.pool[np.repeat(shift, lengths) + np.arange(upto[-1], dtype=np.int32)]
        return ids, np.diff(upto[bounds])

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First text, ids and counts of bounded slices of the texts; null is empty text."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)).astype(np.int64)
        lo = 0
        while lo < len(texts):
            base = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, base + self.slice_bytes, side="right")))
            part = texts.slice(lo, hi - lo)
            if len(self.known) > self.remember:
                self._forget()
            empty = pc.equal(pc.binary_length(part), 0)
            odd = pc.or_(empty, pc.match_substring_regex(part, _TIGHT)) if self.keeps_space else empty
            odd = odd.to_numpy(zero_copy_only=False)
            if not odd.any():
                ids, counts = self._pieces(part)
            else:
                counts = np.zeros(hi - lo, np.int64)
                runs: list[np.ndarray | None] = [None] * (hi - lo)
                plain = np.flatnonzero(~odd)
                if len(plain):
                    got, n = self._pieces(part.take(pa.array(plain)))
                    counts[plain] = n
                    for i, run in zip(plain, np.split(got, np.cumsum(n)[:-1])):
                        runs[i] = run
                for i in np.flatnonzero(odd):
                    runs[i] = self._whole(part[int(i)].as_py())
                    counts[i] = len(runs[i])
                ids = np.concatenate(runs)
            yield lo, ids, counts
            lo = hi


_ENCODERS: dict[tuple[str, bool, bool], PieceEncoder] = {}


def encoder(path: str, keeps_space: bool, roomy: bool = False) -> PieceEncoder:
    """One encoder for each vocabulary in a Python worker."""
    key = (path, keeps_space, roomy)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(*key)
    return _ENCODERS[key]


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the end id after each text's, and where each text's begin and the last ends."""
    bounds = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.empty(int(bounds[-1]), np.uint32)
    own = np.ones(len(out), bool)
    own[bounds[1:] - 1] = False
    out[own] = ids
    out[~own] = end
    return out, bounds
