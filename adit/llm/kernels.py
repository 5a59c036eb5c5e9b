"""Vectorised text kernels that run inside Arrow tasks.

Texts stay UTF-8 bytes. A word is a maximal run of bytes of a class; as every
byte of a non-ASCII character is 0x80 or more, a class that holds all of these
splits bytes exactly as it splits characters. A word's 64-bit hash mixes it
eight bytes at a time (A-Z as a-z), each piece with its place, so that no step
loops over words in Python.
"""

import ctypes
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

#: Bytes that one vectorised step handles; longer texts are cut between words.
STEP = 1 << 19
#: Bytes of text, and documents, that one group holds, unless one document is longer.
GROUP, GROUP_DOCS = 1 << 21, 8192
#: Words of more pieces are hashed one by one.
PIECES = 32

_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), in place on a copy."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    v = np.arange(256, dtype=np.uint8)
    v[ord("A") : ord("Z") + 1] = v[ord("a") : ord("z") + 1]
    return v


@lru_cache(maxsize=1)
def _places() -> np.ndarray:
    return mix(np.arange(1, PIECES + 1, dtype=np.uint64) * _MULT)


#: Masks that keep the first 0 .. 8 bytes of a piece.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _pieces(data: np.ndarray) -> np.ndarray:
    """At each place of ``data`` the next eight bytes, lower-cased, as one number."""
    padded = np.zeros(len(data) + 8, np.uint8)
    np.take(_lower(), data, out=padded[: len(data)])
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))


def hashes(lanes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, from _pieces(); equal lower-cased bytes, equal hashes."""
    acc = np.zeros(len(start), np.uint64)
    some, places = np.arange(len(start)), _places()
    for k in range(PIECES):
        left = length[some] - 8 * k
        if k:
            some, left = some[left > 0], left[left > 0]
        if not len(some):
            break
        acc[some] += mix((lanes[start[some] + 8 * k] & _KEEP[np.minimum(left, 8)]) ^ places[k])
    for i in np.flatnonzero(length > 8 * PIECES):
        at = np.arange(8 * PIECES, length[i], 8)
        acc[i : i + 1] += mix((lanes[start[i] + at] & _KEEP[np.minimum(length[i] - at, 8)]) ^ mix((at // 8 + 1).astype(np.uint64) * _MULT)).sum(dtype=np.uint64, keepdims=True)
    return mix(acc ^ length.astype(np.uint64))


@lru_cache(maxsize=4)
def _class(kind: str) -> np.ndarray:
    b = np.arange(256)
    if kind == "space":  # words are runs of [^\x20\x09-\x0D]
        return ~((b == 32) | ((b >= 9) & (b <= 13)))
    # "alnum": words are runs of [0-9A-Za-z] and everything from U+0080 on
    return (b >= 128) | ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    n = len(column)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def groups(offs: np.ndarray, size: int = GROUP):
    """Runs (first, last) of documents with about ``size`` bytes, and at most GROUP_DOCS documents, each."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + size, "right")) - 1
        j = min(max(j, i + 1), n, i + GROUP_DOCS)
        yield i, j
        i = j


def words(data: np.ndarray, offs: np.ndarray, kind: str = "space", of=None):
    """Words of the documents ``data[offs[i]:offs[i+1]]``.

    Returns (hash, start, end, first): per word its hash and byte range, and
    per document the index of its first word (with one entry more at the end).
    ``of``: another function (bytes, start, end) that gives a number for each word, instead of the hash.
    """
    cls = _class(kind)
    total, base = len(data), int(offs[0])
    data = data[base : int(offs[-1])] if base or int(offs[-1]) != total else data
    offs = offs - base
    out_h, out_s, out_e = [], [], []
    at, n = 0, len(data)
    while at < n:
        end = min(at + STEP, n)
        if end < n:  # cut before a separator or a document, else grow
            k = int(np.searchsorted(offs, end, "right")) - 1
            if offs[k] > at and offs[k] != end:
                sep = np.flatnonzero(~cls[data[max(at, end - 4096) : end]])
                end = max(at, end - 4096) + int(sep[-1]) if len(sep) and max(at, end - 4096) + int(sep[-1]) > at else int(offs[k])
            elif offs[k] != end:
                sep = np.flatnonzero(~cls[data[max(at, end - 4096) : end]])
                if len(sep) and max(at, end - 4096) + int(sep[-1]) > at:
                    end = max(at, end - 4096) + int(sep[-1])
                else:  # one long word: to its end
                    stop = int(offs[k + 1])
                    while end < stop:
                        sep = np.flatnonzero(~cls[data[end : min(end + STEP, stop)]])
                        if len(sep):
                            end += int(sep[0])
                            break
                        end = min(end + STEP, stop)
        piece = data[at:end]
        on = cls[piece]
        edge = np.empty(len(piece) + 1, bool)
        edge[0], edge[-1] = on[0], on[-1]
        np.not_equal(on[1:], on[:-1], out=edge[1:-1])
        lo, hi = np.searchsorted(offs, at, "left"), np.searchsorted(offs, end, "left")
        bounds = np.unique(offs[lo:hi]) - at
        bounds = bounds[bounds > 0]
        joined = bounds[on[bounds - 1] & on[bounds]] if len(bounds) else bounds  # a word ends and another starts here
        where = np.flatnonzero(edge)
        if len(joined):
            where = np.sort(np.concatenate([where, joined, joined]))
        s, e = where[::2], where[1::2]
        out_h.append(of(piece, s, e) if of else hashes(_pieces(piece), s, e - s))
        out_s.append(s + at)
        out_e.append(e + at)
        at = end
    start = np.concatenate(out_s) if out_s else np.zeros(0, np.int64)
    stop = np.concatenate(out_e) if out_e else np.zeros(0, np.int64)
    h = np.concatenate(out_h) if out_h else np.zeros(0, np.uint64)
    return h, start + base, stop + base, np.searchsorted(start, offs, "left")


def prefixes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lengths: tuple[int, ...]):
    """For each length k in bytes, in increasing order: (words longer than k, hash of their first k bytes)."""
    some = np.arange(len(start))
    base = int(start[0]) if len(start) else 0
    lanes = _pieces(data[base : int(end[-1])] if len(start) else data[:0])
    for k in lengths:
        some = some[end[some] - start[some] > k]
        yield some, mix(hashes(lanes, start[some] - base, np.full(len(some), k)) ^ np.uint64(k << 56))


def shingles(h: np.ndarray, first: np.ndarray, width: int):
    """Hashes of runs of ``width`` words, all documents after one another.

    A document with fewer words has its whole sequence as one shingle; one
    without words has none. Returns (hash, first): as for words().
    """
    count = np.diff(first)
    made = np.where(count >= width, count - width + 1, (count > 0).astype(count.dtype))
    out_first = np.concatenate([[0], np.cumsum(made)])
    if not out_first[-1]:
        return np.zeros(0, np.uint64), out_first
    mult = mix(np.arange(1, width + 1, dtype=np.uint64) * _MULT) | np.uint64(1)
    full = count >= width
    idx = np.repeat(first[:-1][full] - np.concatenate([[0], np.cumsum(made[full])])[:-1], made[full]) + np.arange(made[full].sum())
    acc = np.zeros(len(idx), np.uint64)
    for k in range(width):
        acc += h[idx + k] * mult[k]
    out = np.empty(int(out_first[-1]), np.uint64)
    is_full = np.repeat(full, made)
    out[is_full] = acc
    for d in np.flatnonzero(~full & (count > 0)):
        w = h[first[d] : first[d + 1]]
        out[out_first[d]] = (w * mult[: len(w)]).sum(dtype=np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5 + len(w))
    return mix(out), out_first


def row_sums(x: np.ndarray, first: np.ndarray, op: np.ufunc = np.add) -> np.ndarray:
    """Sums (or another reduction) of the runs of x that begin at ``first``; 0 for an empty run."""
    out = np.zeros((len(first) - 1, *x.shape[1:]), x.dtype)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        out[some] = op.reduceat(x, first[:-1][some], axis=0)
    return out


def others(names: list[str], new) -> list[str]:
    """The names that none of ``new`` equals, whatever the case: Spark resolves columns so."""
    taken = {n.lower() for n in new}
    return [n for n in names if n.lower() not in taken]


def append(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns added; input columns of the same names, in any case, are replaced."""
    taken = {n.lower() for n in columns}
    keep = [i for i, n in enumerate(batch.schema.names) if n.lower() not in taken]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + list(columns.values()), [batch.schema.names[i] for i in keep] + list(columns))


_LARGE: dict = {}


def large(owner: str):
    """A decorator for a cached function of a worker whose results take much memory: tasks of any but its ``owner`` empty the cache."""

    def named(cache):
        _LARGE[owner] = cache
        return cache

    return named


def give_back(owner: str | None = None) -> None:
    """Empty the large caches of all but ``owner``, and give what allocators hold in reserve back to the system."""
    for name, cache in _LARGE.items():
        if name != owner:
            cache.cache_clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def released(run, owner: str | None = None):
    """The function of a task's batches, before and after which memory goes back to the system: Python workers live on from stage to stage.

    Only what ``owner`` has cached stays for its next task.
    """

    @wraps(run)
    def to_the_end(batches):
        give_back(owner)
        yield from run(batches)
        give_back(owner)

    return to_the_end
