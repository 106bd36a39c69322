"""Encoding of whole texts by a byte-level BPE vocabulary, with words cut and known words fetched in numpy.

Texts of plain bytes (printable ASCII but the apostrophe, common white space, composed Latin letters) are cut by byte classes as the
vocabulary's pattern would cut them, and each word that was met before is fetched by a 64-bit hash of its bytes; other texts are cut by the
pattern itself. Words not met before are encoded together over the contiguous rank array. The memory of words is bounded.
"""

from __future__ import annotations

import numpy as np

from .bpe import Codec
from .common import mix, powers

MEMORY = 1_000_000
_U = np.uint64


def _classes() -> np.ndarray:
    """Of each byte: 0 white space, 1 letter, 2 digit, 3 other sign, 4 not plain."""
    out = np.full(256, 4, np.uint8)
    out[33:127] = 3
    out[[9, 10, 13, 32]] = 0
    out[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = 1
    out[48:58] = 2
    out[39] = 4  # an apostrophe may begin a contraction
    return out


_CLASS = _classes()
#: Two signs among the letters' bytes.
_SIGNS = np.zeros(1 << 16, bool)
_SIGNS[[0xC397, 0xC3B7]] = True


def cut_plain(flat: np.ndarray, starts: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first bytes, ends) of the words of plain texts that stand one after another in ``flat``.

    A word is a run of one class with the one space before it. Of a longer run of white space the last sign stands alone, unless it is that
    space or the text ends there.
    """
    edge = np.concatenate([[True], kinds[1:] != kinds[:-1]])[: len(kinds)]
    edge[starts[:-1][starts[:-1] < len(flat)]] = True
    first = np.flatnonzero(edge)
    stop = np.append(first[1:], len(flat))[: len(first)]
    row = np.searchsorted(starts, first, "right") - 1
    blank = kinds[first] == 0
    more = blank & np.append(row[1:] == row[:-1], False)[: len(row)]
    space = more & (flat[stop - 1] == 32)
    begin, end = first.copy(), stop - more
    begin[1:] -= space[:-1]
    alone = more & ~space
    keep = begin < end
    begin, end = np.concatenate([begin[keep], stop[alone] - 1]), np.concatenate([end[keep], stop[alone]])
    order = np.argsort(begin)
    return begin[order], end[order]


class ByteEncoder:
    def __init__(self, path: str):
        self.codec = Codec(path)
        self.vocabulary = self.codec.vocabulary
        self.special = [s.encode() for s in self.codec.special]
        self.known: dict[int, bytes] = {}

    def run(self, data: np.ndarray, at: np.ndarray, i: int, j: int) -> list[np.ndarray]:
        """Ids of the texts of rows i..j-1."""
        flat, starts = data[at[i] : at[j]], at[i : j + 1] - at[i]
        kinds = _CLASS[flat]
        bad = np.concatenate([np.flatnonzero(kinds == 4), np.flatnonzero(_SIGNS[(flat[:-1].astype(np.uint16) << 8) | flat[1:]])])
        slow = np.zeros(j - i, bool)
        slow[np.searchsorted(starts, bad, "right") - 1] = True
        raw = flat.tobytes()
        for sign in self.special:
            place = raw.find(sign)
            while place >= 0:
                slow[np.searchsorted(starts, place, "right") - 1] = True
                place = raw.find(sign, place + 1)
        out = self._plain(flat, starts, kinds, slow, raw)
        rows = np.flatnonzero(slow).tolist()
        for k, ids in zip(rows, self.codec.run([raw[starts[k] : starts[k + 1]].decode() for k in rows]) if rows else [], strict=True):
            out[k] = ids
        return out

    def _plain(self, flat: np.ndarray, starts: np.ndarray, kinds: np.ndarray, slow: np.ndarray, raw: bytes) -> list[np.ndarray]:
        first, stop = cut_plain(flat, starts, kinds)
        row = np.searchsorted(starts, first, "right") - 1
        if slow.any():
            keep = ~slow[row]
            first, stop, row = first[keep], stop[keep], row[keep]
        if not len(first):
            return [np.zeros(0, np.int32)] * len(slow)
        up, down = powers(len(flat) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat * up[: len(flat)])])
        hashed = mix((total[stop] - total[first]) * down[first] + (stop - first).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        order = np.argsort(hashed)
        ordered = hashed[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        where, inverse = order[new], np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        keys = ordered[new].tolist()
        fresh = [k for k, h in enumerate(keys) if h not in self.known]
        if len(self.known) + len(fresh) > MEMORY:  # what these texts need is learnt anew
            self.known.clear()
            fresh = list(range(len(keys)))
        words = [raw[a:b] for a, b in zip(first[where[fresh]].tolist(), stop[where[fresh]].tolist())]
        for k, ids in zip(fresh, self.vocabulary.encode_words(words), strict=True):
            self.known[keys[k]] = np.array(ids, np.int32).tobytes()
        found = [self.known[h] for h in keys]
        pool, sizes = np.frombuffer(b"".join(found), np.int32), np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin = np.cumsum(sizes) - sizes
        counts = sizes[inverse]
        stops = np.cumsum(counts)
        ids = pool[np.repeat(begin[inverse] - stops + counts, counts) + np.arange(stops[-1])]
        ends = np.append(0, stops)[np.searchsorted(row, np.arange(len(slow) + 1))]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
