"""Simple-8b coding of id streams in numpy.

A word has 64 bits: four for the selector and sixty for as many ids as fit with the selector's
width. Blocks of 256 ids are packed on their own, and their offsets are kept, so that any block
can be decoded alone and all of them at once. Ids of 2**60 or more are escapes: selector 15, whose
payload is a place in the list of raw 64-bit values at the segment's end.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60, 60])
ESCAPE = 15
_BITS = np.array([max(1, i.bit_length()) for i in range(1 << 16)], dtype=np.uint8)
#: How each count's sliding maximum comes from two shorter ones: count: (first, second).
_FROM = {2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (4, 1), 6: (4, 2), 7: (4, 3), 8: (4, 4), 10: (8, 2), 12: (8, 4), 15: (8, 7), 20: (10, 10), 30: (15, 15), 60: (30, 30)}


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    if len(ids) and ids.max() < 1 << 16:
        return _BITS[ids]
    out = np.ones(len(ids), dtype=np.uint8)
    rest, shift = ids.astype(np.uint64), 0
    while True:
        low = _BITS[(rest & np.uint64(0xFFFF)).astype(np.int64)]
        out = np.where(rest > 0, low + np.uint8(shift), out).astype(np.uint8)
        rest, shift = rest >> np.uint64(16), shift + 16
        if not rest.any():
            return out


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, word offsets of the blocks (one more than blocks) and raw escapes of an id stream."""
    n = len(ids)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(1, "<u4"), np.zeros(0, "<u8")
    ids = ids.astype(np.uint64)
    bits = bit_lengths(ids)
    raw = np.flatnonzero(bits > 60)
    escapes = ids[raw].astype("<u8")
    blocks = -(-n // BLOCK)
    wide = np.zeros((blocks, BLOCK + 60), dtype=np.uint8)  # after a block's end all fits
    flat = np.zeros(blocks * BLOCK, dtype=np.uint8)
    flat[:n] = bits
    wide[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    most = {1: wide}
    for c, (a, b) in _FROM.items():
        left, right = most[a], most[b]
        top = left.copy()
        np.maximum(left[:, :-a], right[:, a:], out=top[:, :-a])
        most[c] = top
    choice = np.full((blocks, BLOCK), 13, dtype=np.uint8)
    for s in range(12, -1, -1):
        choice[most[int(COUNTS[s])][:, :BLOCK] <= WIDTHS[s]] = s
    choice[wide[:, :BLOCK] > 60] = ESCAPE
    lengths = np.full(blocks, BLOCK)
    lengths[-1] = n - (blocks - 1) * BLOCK
    at, live, row = np.zeros(blocks, dtype=np.int64), np.arange(blocks), []
    while len(live):
        picked = choice[live, at[live]]
        row.append((live, at[live], picked))
        at[live] += COUNTS[picked]
        live = live[at[live] < lengths[live]]
    block = np.concatenate([r[0] for r in row])
    order = np.argsort(block, kind="stable")
    block = block[order]
    start = np.concatenate([r[1] for r in row])[order] + block * BLOCK
    sel = np.concatenate([r[2] for r in row])[order]
    words = sel.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    end = block * BLOCK + lengths[block]
    for s in range(15):
        if not len(k := np.flatnonzero(sel == s)):
            continue
        c, w = int(COUNTS[s]), int(WIDTHS[s])
        for j in range(c):
            p = start[k] + j
            words[k] |= np.where(p < end[k], padded[p], np.uint64(0)) << np.uint64(w * j)
    if len(raw):
        k = np.flatnonzero(sel == ESCAPE)
        words[k] |= np.searchsorted(raw, start[k]).astype(np.uint64)
    offsets = np.zeros(blocks + 1, dtype="<u4")
    offsets[1:] = np.cumsum(np.bincount(block, minlength=blocks))
    return words.astype("<u8"), offsets, escapes


def decode(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """All ids of a segment as uint64."""
    out = np.zeros(n + 60, dtype=np.uint64)
    if not n:
        return out[:0]
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[sel]
    before = np.cumsum(counts) - counts
    first = offsets[:-1].astype(np.int64)
    block = np.repeat(np.arange(len(first)), np.diff(offsets.astype(np.int64)))
    start = before - before[first][block] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    for s in range(15):
        if not len(k := np.flatnonzero(sel == s)):
            continue
        c, w = int(COUNTS[s]), int(WIDTHS[s])
        mask, x, p = np.uint64((1 << w) - 1), words[k], start[k]
        full = c == 1 or bool((p + c <= end[k]).all())
        for j in range(c):
            v = (x >> np.uint64(w * j)) & mask
            if full:
                out[p + j] = v
            else:
                ok = p + j < end[k]
                out[p[ok] + j] = v[ok]
    k = np.flatnonzero(sel == ESCAPE)
    if len(k):
        out[start[k]] = escapes[(words[k] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out[:n]


HEAD = np.dtype([("magic", "S4"), ("version", "<u4"), ("docs", "<u4"), ("block", "<u4"), ("ids", "<u8"), ("words", "<u8"), ("escapes", "<u8")])


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment: header, document ids with null marks, lengths, block offsets, words, escapes."""
    words, offsets, escapes = encode(ids)
    head = np.zeros(1, dtype=HEAD)
    head[0] = (b"KS8B", 1, len(doc_ids), BLOCK, len(ids), len(words), len(escapes))
    keys = np.array([d or 0 for d in doc_ids], dtype="<i8")
    nulls = np.array([d is None for d in doc_ids], dtype="u1")
    return b"".join(x.tobytes() for x in (head, keys, nulls, lengths.astype("<u4"), offsets, words, escapes))


def unpack(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and the whole id stream of a segment."""
    h = np.frombuffer(blob, HEAD, 1)[0]
    if h["magic"] != b"KS8B" or h["version"] != 1 or h["block"] != BLOCK:
        raise ValueError("not a segment of token ids")
    at, d, n = HEAD.itemsize, int(h["docs"]), int(h["ids"])

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(blob, kind, count, at)
        at += found.nbytes
        return found

    keys, nulls, lengths = take("<i8", d), take("u1", d), take("<u4", d)
    offsets, words, escapes = take("<u4", -(-n // BLOCK) + 1), take("<u8", int(h["words"])), take("<u8", int(h["escapes"]))
    doc_ids = [None if z else int(k) for k, z in zip(keys, nulls, strict=True)]
    return doc_ids, lengths, decode(words, offsets, escapes, n)
