"""Words of UTF-8 texts as codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of UTF-8 text to lower-cased word bytes: digits, a-z and everything beyond ASCII stay, the rest is a space.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def word_codes(texts: list[bytes | None]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of UTF-8 texts as codes: (code of each word in order, dictionary of word bytes, words of each text)."""
    sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    flat = np.frombuffer(b" ".join(t or b"" for t in texts).translate(WORD_BYTES), np.uint8)
    inside = flat != 32
    edge = np.diff(inside, prepend=False, append=False) if len(flat) else np.zeros(0, bool)
    edges = np.flatnonzero(edge)
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(flat[inside])]
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    counts = np.diff(np.append(np.searchsorted(starts, begins), len(starts)))
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, counts
