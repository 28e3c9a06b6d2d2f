"""Encoding whole texts with the ``tokenizers`` library, each distinct part of a batch once.

A byte-level pre-tokenizer with the usual pattern always starts a new pre-token at a single space,
or a single line feed, that stands between two characters which aren't white space. A text can
therefore be cut there, and its parts encoded on their own have the same ids as in the whole. The
parts of a batch are told apart by Arrow's dictionaries; new ones are encoded together, a few dozen
in one string, and each begins at the id whose piece starts with its separator. Parts that occur
more than once are kept for later batches, up to a bound. A text with other white space at its
parts' ends, or with an added token's content in it, is given to the library as a whole.
"""

from __future__ import annotations

import gc
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _tidy(unit: str) -> bool:
    """Not empty and without white space at either end, but for one line feed before it."""
    return bool(unit) and not unit[-1].isspace() and not unit[unit[0] == "\n"].isspace()


class CachedEncoder:
    """Encodes texts to little-endian uint32 id bytes; keeps at most about ``max_parts`` parts."""

    def __init__(self, tokenizer_file: str, max_parts: int = 1_000_000, group: int = 64, batch_bytes: int = 16_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.opens = {sep: np.zeros(max(vocab.values()) + 1, dtype=bool) for sep in " \n"}
        for piece, i in vocab.items():
            self.opens[" "][i] = piece.startswith("Ġ")
            self.opens["\n"][i] = piece.startswith("Ċ")
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        pre = spec.get("pre_tokenizer") or {}
        self.cuttable = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None and not spec["model"].get("dropout") and not any(c.isspace() for t in self.added for c in t)
        self.max_parts, self.group, self.batch_bytes = max_parts, group, batch_bytes
        self._forget()

    def _forget(self) -> None:
        self.keys = pa.array([], pa.string())  # parts without their space, or with their line feed
        self.ids = np.zeros(0, "<u4")
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text (null: of the empty text), as bytes of little-endian uint32."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not self.cuttable:
            return self._plain(column.to_pylist())
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        collects = gc.isenabled()
        gc.disable()  # what follows makes millions of strings and no cycles
        try:
            out: list[bytes] = []
            lo = 0
            while lo < len(column):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + self.batch_bytes)))
                out += self._some(column.slice(lo, hi - lo))
                lo = hi
            return out
        finally:
            if collects:
                gc.enable()

    def _together(self, sep: str, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of tidy units of one separator, and where each unit's start."""
        groups = [units[i : i + self.group] for i in range(0, len(units), self.group)]
        ids = np.frombuffer(b"".join(self._plain([sep + sep.join(g) if sep == " " else "".join(g) for g in groups])), "<u4")
        starts = np.flatnonzero(self.opens[sep][ids])
        if len(starts) != len(units):  # a unit holds its separator, or a piece starts unexpectedly: one by one
            each = self._plain([sep + u if sep == " " else u for u in units])
            ids = np.frombuffer(b"".join(each), "<u4")
            starts = np.cumsum([0, *(len(e) // 4 for e in each[:-1])])
        return ids, starts

    def _some(self, column: pa.Array) -> list[bytes]:
        if len(self.keys) > self.max_parts:
            self._forget()
        lists = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        at, flat = at - at[0], lists.flatten().dictionary_encode()
        code, words = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
        head = np.zeros(len(code), bool)
        head[at[:-1]] = True
        heads = words.take(pa.array(code[at[:-1]])).to_pylist()
        times = np.bincount(code[~head], minlength=len(words))
        place = pc.fill_null(pc.index_in(words, value_set=self.keys), -1).to_numpy(zero_copy_only=False)
        known, new = np.flatnonzero(place >= 0), np.flatnonzero((place < 0) & (times > 0))
        text = words.take(pa.array(new)).to_pylist()
        holds = np.zeros(len(words), bool)
        for content in self.added:
            holds |= pc.match_substring(words, content).to_numpy(zero_copy_only=False)
        tidy = np.fromiter(map(_tidy, text), bool, len(text)) & ~holds[new]
        untidy = np.zeros(len(words), bool)
        untidy[new[~tidy]] = True
        fine = np.array([n == 1 or bool(h) and not h[-1].isspace() for n, h in zip(np.diff(at).tolist(), heads, strict=True)], bool) & ~holds[code[at[:-1]]]
        odd = ~fine | np.logical_or.reduceat(untidy[code] & ~head, at[:-1])

        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        start[known], size[known] = self.start[place[known]], self.size[place[known]]
        buffers, held = [self.ids], len(self.ids)
        by: dict[str, list[int]] = {" ": [], "\n": []}
        for i in np.flatnonzero(tidy).tolist():
            by["\n" if text[i][0] == "\n" else " "].append(i)
        for sep, which in by.items():
            if which:
                ids, starts = self._together(sep, [text[i] for i in which])
                start[new[which]], size[new[which]] = starts + held, np.diff(starts, append=len(ids))
                buffers.append(ids)
                held += len(ids)
        first = self._plain(heads)
        first_size = np.array([len(p) >> 2 for p in first], np.int64)
        buffers.append(np.frombuffer(b"".join(first), "<u4"))
        s, n = start[code], size[code]
        s[at[:-1]], n[at[:-1]] = np.cumsum(first_size) - first_size + held, first_size
        every = np.concatenate(buffers)
        raw = self._gather(every, s, n).tobytes()
        bounds = (np.concatenate([[0], np.cumsum(n)[at[1:] - 1]]) * 4).tolist()
        out = [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        which = np.flatnonzero(odd).tolist()
        for i, ids in zip(which, self._plain(column.take(pa.array(which, pa.int64())).to_pylist()), strict=True):
            out[i] = ids
        self._keep(words, new[tidy & (times[new] > 1)], every, start, size)
        return out

    @staticmethod
    def _gather(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Runs of ids one after the other."""
        ends = np.cumsum(size)
        return ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)]

    def _keep(self, words: pa.Array, which: np.ndarray, every: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        more = self._gather(every, start[which], size[which])
        self.start = np.concatenate([self.start, np.cumsum(size[which]) - size[which] + len(self.ids)])
        self.size = np.concatenate([self.size, size[which]])
        self.ids = np.concatenate([self.ids, more])
        self.keys = pa.concat_arrays([self.keys, words.take(pa.array(which))])


_ENCODERS: dict[str, CachedEncoder] = {}


def encoder(tokenizer_file: str) -> CachedEncoder:
    """One encoder a worker process and file."""
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = CachedEncoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]
