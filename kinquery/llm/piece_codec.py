"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The normalised text is cut into words (a word's piece sign starts it), which no piece crosses.
The symbols of all new words lie in one flat numpy array. In each round every word finds the
least rank among its pairs (a segmented minimum), merges all pairs of that rank, leftmost first,
at once, and the arrays are compacted; words without a pair leave. Encoded words are kept in a
bounded cache, so that a frequent word is merged once a worker.

Two cases aren't the same when merged at once, and go through one word's sequential merges:
words with piece signs in a row (their pieces have equal scores), and words in which a merge of
several pairs made a pair of lower rank than its own.

Null and empty texts have no ids and decode to the empty text. Characters without a piece become
byte pieces. Only models with byte fallback, a dummy prefix and no other normalisation are taken.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kinquery.llm.batches import slices

SIGN = "▁"
_WORDS = re.compile(f"{SIGN}*[^{SIGN}]+|{SIGN}+")
_NONE = np.int32(2**31 - 1)


class PairTable:
    """(left, right) symbols to the merged piece's rank; open addressing in numpy."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(len(keys) * 4).bit_length())
        self.mask, self.keys, self.values = size - 1, np.full(size, -1, np.int64), np.full(size, _NONE, np.int32)
        left, rest = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(rest):
            self.probes += 1
            free = self.keys[left[rest]] < 0
            first = np.zeros(len(rest), bool)
            first[np.unique(left[rest], return_index=True)[1]] = True
            put = rest[free & first]
            self.keys[left[put]], self.values[left[put]] = keys[put], values[put]
            rest = rest[~(free & first)]
            left[rest] = (left[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(32)).astype(np.int64)) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 20) | right
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        out = np.full(len(keys), _NONE, np.int32)
        todo = np.arange(len(keys))
        for _ in range(self.probes):
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            more = ~hit & (there >= 0)
            if not more.any():
                break
            todo, slot = todo[more], (slot[more] + 1) & self.mask
        return out


class PieceCodec:
    def __init__(self, model_file: str, max_words: int = 150_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if sp.Normalize("  ﬁ Å  x ") != f"{SIGN}{SIGN}{SIGN}ﬁ{SIGN}Å{SIGN}{SIGN}x{SIGN}":
            raise ValueError("the model normalises texts in a way that isn't implemented")
        n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes_at = np.array([sp.PieceToId(f"<0x{i:02X}>") for i in range(256)], np.int32)
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        byte_ids = set(self.bytes_at.tolist())
        if len(byte_ids) != 256 or byte_ids & special:
            raise ValueError("the model has no byte pieces")
        normal = [i for i in range(n) if i not in special and i not in byte_ids]
        if any(SIGN in pieces[i].lstrip(SIGN) for i in normal):
            raise ValueError("a piece goes across words")
        order = sorted(normal, key=lambda i: -sp.get_score(i))
        self.rank_of = {pieces[i]: r for r, i in enumerate(order)}
        score = {pieces[i]: sp.get_score(i) for i in normal}
        self.score = score
        counted: dict[float, int] = {}
        for p in normal:
            if len(pieces[p]) > 1:
                counted[score[pieces[p]]] = counted.get(score[pieces[p]], 0) + 1
        if any(counted[s] > 1 and p.strip(SIGN) for p, s in score.items() if len(p) > 1):
            raise ValueError("pieces other than runs of signs have equal scores")
        self.id_of = {pieces[i]: i for i in normal}
        symbols = dict(self.id_of)  # characters in pieces that aren't pieces get symbols of their own
        for i in normal:
            for c in pieces[i]:
                symbols.setdefault(c, n + len(symbols))
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for p, i in symbols.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        keys, values = [], []
        for p, r in self.rank_of.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k], -1), symbols.get(p[k:], -1)
                if a >= 0 and b >= 0:
                    keys.append(a << 20 | b)
                    values.append(r)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(values, np.int32))
        self.piece_at_rank = np.array([*order, -1], np.int32)
        self.n, self.max_words, self.cache = n, max_words, {}
        text = [b"" if i in special else bytes([int(pieces[i][3:5], 16)]) if i in byte_ids else pieces[i].replace(SIGN, " ").encode() for i in range(n)]
        text[sp.unk_id()] = " ⁇ ".encode()
        self.starts_word = np.array([i not in byte_ids and i not in special and p.startswith(SIGN) for i, p in enumerate(pieces)])
        self.silent = np.array([sp.is_control(i) for i in range(n)])
        self.size = np.array([len(t) for t in text], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(text), np.uint8)

    def _bytes(self, char: str) -> list[int]:
        return self.bytes_at[list(char.encode("utf-8"))].tolist()

    def _sequential(self, word: str) -> bytes:
        """One word by best score first, leftmost of equals, as a queue of pairs."""
        sym: list[str] = list(word)
        n = len(sym)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (s := self.score.get(sym[i] + sym[j])) is not None:
                heapq.heappush(queue, (-s, i, j, sym[i] + sym[j]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, j, piece = heapq.heappop(queue)
            if not sym[i] or not sym[j] or sym[i] + sym[j] != piece or after[i] != j:
                continue
            sym[i], sym[j] = piece, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        ids: list[int] = []
        for s in filter(None, sym):
            ids += [self.id_of[s]] if s in self.id_of else [x for c in s for x in self._bytes(c)]
        return np.array(ids, "<i4").tobytes()

    def merge_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word (with its leading sign) as bytes of little-endian int32."""
        out: list[bytes] = [b""] * len(words)
        slow = [i for i, w in enumerate(words) if SIGN * 2 in w]
        fast = [i for i, w in enumerate(words) if SIGN * 2 not in w and w]
        for i in slow:
            out[i] = self._sequential(words[i])
        for lo in range(0, len(fast), 100_000):
            self._rounds(words, fast[lo : lo + 100_000], out)
        return out

    def _rounds(self, words: list[str], which: list[int], out: list[bytes]) -> None:
        lengths = np.array([len(words[i]) for i in which])
        chars = np.frombuffer("".join([words[i] for i in which]).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.symbol_of[chars]
        word = np.repeat(np.arange(len(which), dtype=np.int64), lengths)
        first = np.cumsum(lengths) - lengths  # where each symbol's characters start
        place = np.arange(len(chars))
        redo: set[int] = set()
        done_sym, done_place, done_word = [], [], []
        rank = self._ranks(sym, word)
        last_min, last_many = np.full(len(which), -1, np.int32), np.zeros(len(which), bool)
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            who = word[starts]
            least = np.minimum.reduceat(rank, starts)
            odd = who[last_many[who] & (least < last_min[who])]
            redo.update(odd.tolist())
            sizes = np.diff(np.append(starts, len(sym)))
            over = np.repeat(least == _NONE, sizes)
            if over.any():
                done_sym.append(sym[over])
                done_place.append(place[over])
                done_word.append(word[over])
                live = ~over
                sym, word, place, rank = sym[live], word[live], place[live], rank[live]
                sizes, who, least = sizes[least != _NONE], who[least != _NONE], least[least != _NONE]
                if not len(sym):
                    break
            hit = rank == np.repeat(least, sizes)
            at = np.flatnonzero(hit)
            # in a run of overlapping pairs every other one merges, from the left
            run = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            merged = np.bincount(word[at], minlength=len(which))
            last_min[who], last_many[who] = least, merged[who] > 1
            sym[at] = self.piece_at_rank[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            before = at - 1
            before = before[before >= 0]
            before = np.where(keep[before], before, before - 1)
            touched[before[before >= 0]] = True
            sym, word, place, rank, touched = sym[keep], word[keep], place[keep], rank[keep], touched[keep]
            new = np.flatnonzero(touched)
            nxt = np.minimum(new + 1, len(sym) - 1)
            found = self.pairs.find(sym[new], sym[nxt])
            found[(nxt == new) | (word[new] != word[nxt])] = _NONE
            rank[new] = found
        self._collect(words, which, out, chars, first, lengths, np.concatenate(done_sym), np.concatenate(done_place), np.concatenate(done_word))
        for i in redo:
            out[which[i]] = self._sequential(words[which[i]])

    def _ranks(self, sym: np.ndarray, word: np.ndarray) -> np.ndarray:
        rank = np.full(len(sym), _NONE, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.pairs.find(sym[inner], sym[inner + 1])
        return rank

    def _collect(self, words, which, out, chars, first, lengths, sym, place, word) -> None:
        """Put the final symbols in order, unknown characters as their bytes."""
        order = np.argsort(place)
        sym, place, word = sym[order], place[order], word[order]
        ids = sym.astype("<i4")
        unknown = np.flatnonzero((sym < 0) | (sym >= self.n))
        if len(unknown):
            pieces = [self._bytes(chr(c)) for c in chars[place[unknown]].tolist()]
            reps = np.ones(len(sym), np.int64)
            reps[unknown] = [len(p) for p in pieces]
            spread = np.repeat(np.arange(len(sym)), reps)
            ids, word = ids[spread], word[spread]
            at = (np.cumsum(reps) - reps)[unknown]
            for a, p in zip(at.tolist(), pieces, strict=True):
                ids[a : a + len(p)] = p
        raw = ids.tobytes()
        ends = (np.cumsum(np.bincount(word, minlength=len(which))) * 4).tolist()
        a = 0
        for i, b in zip(which, ends, strict=True):
            out[i] = raw[a:b]
            a = b

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes of little-endian int32."""
        if len(self.cache) > self.max_words:
            self.cache.clear()
        get = self.cache.get
        split, got, new = [], [], set()
        for t in texts:
            # words are kept by what follows their sign; one with signs in it, or none, is kept whole
            plain = t and "  " not in t and SIGN not in t and t[0] != " " and t[-1] != " "
            s = t.split(" ") if plain else [w[1:] if w[:1] == SIGN and SIGN not in w[1:] and len(w) > 1 else w for w in _WORDS.findall(SIGN + t.replace(" ", SIGN))] if t else []
            g = list(map(get, s))
            new.update(w for w, ids in zip(s, g, strict=True) if ids is None)
            split.append(s)
            got.append(g)
        fresh = list(new)
        self.cache.update(zip(fresh, self.merge_words([w if w[:1] == SIGN else SIGN + w for w in fresh]), strict=True))
        full = self.cache.__getitem__
        return [b"".join([full(w) if ids is None else ids for w, ids in zip(s, g, strict=True)]) for s, g in zip(split, got, strict=True)]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The text of each id array."""
        flat = np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64)
        if len(flat) and (flat.min() < 0 or flat.max() >= self.n):
            raise ValueError("an id is out of range")
        sizes = self.size[flat]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(flat) else 0
        raw = self.blob[np.arange(total) + np.repeat(self.at[flat] - (ends - sizes), sizes)].tobytes()
        ends = np.concatenate([[0], ends])
        out, at = [], 0
        for x in ids:
            a, b = int(ends[at]), int(ends[at + len(x)])
            at += len(x)
            x = np.asarray(x, dtype=np.int64)
            if len(x) and self.silent[x[0]]:
                x = x[~self.silent[x]][:1]
            if len(x) and self.starts_word[x[0]]:
                a += 1
            try:
                out.append(raw[a:b].decode("utf-8"))
            except UnicodeDecodeError:
                out.append(_lenient(raw[a:b]))
        return out


def _lenient(raw: bytes) -> str:
    """Each byte that isn't part of a valid character becomes one replacement character."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_CODECS: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """One codec a worker process and model."""
    if model_file not in _CODECS:
        _CODECS[model_file] = PieceCodec(model_file)
    return _CODECS[model_file]


def _lists(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def encode_documents(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """All columns of ``docs``, and ``ids`` array<int>; with ``decoded`` also the text decoded from the ids.

    Decoding in the same pass saves a second Python worker a task. Columns that have one of those
    names already are replaced.
    """
    added = [ids, *([decoded] if decoded else [])]
    if text in added:
        raise ValueError(f"{text} can't be both read and added")
    docs = docs.drop(*added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, text):
                parts = codec(model_file).encode(some.column(text).to_pylist())
                out = some.append_column(ids, _lists(parts))
                if decoded:
                    back = codec(model_file).decode([np.frombuffer(p, "<i4") for p in parts])
                    out = out.append_column(decoded, pa.array(back, pa.string()))
                yield out

    kinds = {ids: T.ArrayType(T.IntegerType()), decoded: T.StringType()}
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, kinds[c]) for c in added)]))


def decode_documents(encoded: DataFrame, model_file: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns, and the text of the ``ids`` (null: empty); a column of that name is replaced."""
    if text == ids:
        raise ValueError(f"{text} can't be both read and added")
    encoded = encoded.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, ids):
                lists = some.column(ids).fill_null([]) if some.column(ids).null_count else some.column(ids)
                flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
                found = codec(model_file).decode([flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
                yield some.append_column(text, pa.array(found, pa.string()))

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(text, T.StringType())]))
