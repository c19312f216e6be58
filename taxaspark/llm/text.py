"""Words, hashes and groups of whole texts, in NumPy over their UTF-8 bytes."""

import functools

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

PRIME = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64


def lower_table():
    """A ``bytes.translate`` table that lower-cases A-Z and nothing else."""
    return bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def binary_column(batch, name):
    """A string column of an Arrow batch as a list of ``bytes``, nulls as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


BLANKS = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")


def blocks(data, size=1 << 20):
    """Pieces of about ``size`` bytes, cut behind white space only, so no word is cut."""
    start = 0
    while len(data) - start > size:
        cut = max(data.rfind(c, start, start + size) for c in BLANKS)
        if cut < 0:
            cut = min((c for c in (data.find(c, start + size) for c in BLANKS) if c >= 0), default=len(data) - 1)
        yield data[start:cut + 1]
        start = cut + 1
    yield data[start:]


def groups(texts, size=1 << 18, pieces=blocks):
    """Runs of ``(index, piece)`` of about ``size`` bytes; a long text comes in several pieces."""
    held, total = [], 0
    for index, data in enumerate(texts):
        for piece in pieces(data):
            held.append((index, piece))
            total += len(piece) + 2
            if total >= size:
                yield held
                held, total = [], 0
    if held:
        yield held


FEW = 1 << 16


def powers(n):
    """``PRIME**i`` and ``PRIME**-i`` modulo 2**64 for i below n."""
    return [p[:n] for p in _few_powers()] if n <= FEW else _powers(n)


@functools.cache
def _few_powers():
    return _powers(FEW)


def _powers(n):
    both = []
    for base in (PRIME, pow(PRIME, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[:1] = 1
        both.append(np.cumprod(steps, dtype=np.uint64))
    return both


def mixed(h):
    """Bits of a 64-bit hash spread over the whole word."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Pieces:
    """Several texts side by side, each between two blanks, with hashes of any byte range."""

    def __init__(self, texts, word_bytes=None, lower=False):
        table = bytes(0x20 if SPACE[i] else i for i in range(256))
        raw = b" " + b"  ".join(texts) + b" "
        if lower:
            raw = raw.translate(lower_table())
        self.bytes = np.frombuffer(raw.translate(table), np.uint8)
        sizes = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if texts else np.zeros(0, np.int64)
        self.n = len(texts)
        up, self._down = powers(len(raw) + 1)
        self.prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=self.prefix[1:])
        self.is_word = (~SPACE if word_bytes is None else word_bytes)[self.bytes]

    def words(self):
        """Start, end and text index of every word."""
        # The first and the last byte are blanks.
        edge = np.flatnonzero(self.is_word[1:] != self.is_word[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        return start, end, np.searchsorted(self.starts, start, side="right") - 1

    def hashes(self, start, end):
        """Hashes of byte ranges; equal bytes have equal hashes wherever they stand."""
        return mixed((self.prefix[end] - self.prefix[start]) * self._down[start])

    def grams(self, n):
        """Hashes at every start of ``n`` bytes, and which of them lie in one word with its blanks.

        ``n`` is 2 at least. Only the first and the last byte may be a blank.
        """
        count = len(self.bytes) - n + 1
        h = mixed((self.prefix[n:] - self.prefix[:count]) * self._down[:count] + np.uint64(n))
        blank = np.concatenate(([0], np.cumsum(~self.is_word)))
        inside = (blank[n - 1:len(self.bytes)] - blank[1:count + 1]) == 0
        return h, inside

    def sums(self, values, offset=0):
        """Sum of per-byte ``values`` by text."""
        padded = np.zeros(len(self.bytes), np.float64)
        padded[offset:offset + len(values)] = values
        return np.add.reduceat(padded, self.starts) if self.n else np.zeros(0)
