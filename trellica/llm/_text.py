"""Vectorised byte-level text helpers used inside Arrow tasks.

Everything works on the raw UTF-8 buffer of an Arrow string column, so the cost per character is a few array passes and
no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key, base = ("inverse", INVERSE) if inverse else ("power", BASE)
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        table = np.full(size, base, np.uint64)
        table[0] = 1
        have = np.multiply.accumulate(table)
        if size <= 1 << 23:  # a longer table, for a single very long text, is not kept
            _POWERS[key] = have
    return have[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased (A-Z only) bytes and the offset of each text; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.empty(0, np.uint8)
    return LOWER[raw], off - off[0]


def prefix(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; see span_hash()."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data)), out=out[1:])
    return out


def span_hash(run: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span [start, end): equal bytes give equal hashes wherever they stand."""
    return mix((run[end] - run[start]) * powers(len(run), True)[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and words per text. Words are runs of bytes outside [\\x20\\x09-\\x0D]."""
    gap = SPACE[data]
    inner = off[(off > 0) & (off < len(data))]
    before = np.concatenate(([True], gap[:-1])) if len(gap) else gap
    after = np.concatenate((gap[1:], [True])) if len(gap) else gap
    before[inner] = True
    after[inner - 1] = True
    start = np.flatnonzero(~gap & before)
    end = np.flatnonzero(~gap & after) + 1
    cut = np.searchsorted(start, off)
    return start, end, np.diff(cut)


#: Bytes of text hashed at a time where the results are smaller than the passes: a pass takes 8 bytes for each of them.
PASS = 1 << 19


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `most` bytes of text; a longer text comes alone."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        size = np.asarray(pc.binary_length(column).fill_null(0)).astype(np.int64)
        total = np.cumsum(size)
        at = 0
        while at < len(size):
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def shingles(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in text order, and how many each text has.

    A text with fewer than k words has its whole sequence as one shingle; without words it has none.
    """
    start, end, count = words(data, off)
    word = span_hash(prefix(data), start, end)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    made = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    out_first = np.concatenate(([0], np.cumsum(made)))
    out = np.zeros(out_first[-1], np.uint64)
    factor = powers(k + 2)
    full = np.flatnonzero(count >= k)
    at = np.repeat(first[full] - out_first[full], made[full])
    place = np.repeat(out_first[full], made[full]) + (np.arange(made[full].sum()) - np.repeat(np.cumsum(made[full]) - made[full], made[full]))
    at = at + place
    total = np.zeros(len(at), np.uint64)
    for j in range(k):
        total += word[at + j] * factor[j + 1]
    out[place] = mix(total + np.uint64(k))
    for size in range(1, k):
        short = np.flatnonzero(count == size)
        total = np.zeros(len(short), np.uint64)
        for j in range(size):
            total += word[first[short] + j] * factor[j + 1]
        out[out_first[short]] = mix(total + np.uint64(size))
    return out, made


def text_shingles(texts: pa.Array, k: int, most: int = PASS) -> tuple[np.ndarray, np.ndarray]:
    """shingles() of a column of whole texts, about `most` bytes hashed at a time."""
    found = [shingles(*buffers(piece.column(0)), k) for piece in chunks(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text", most)]
    return np.concatenate([np.empty(0, np.uint64), *(x for x, _ in found)]), np.concatenate([np.empty(0, np.int64), *(n for _, n in found)])


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    off = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))
