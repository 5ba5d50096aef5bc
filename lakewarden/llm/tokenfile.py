"""A file of token ids that can be read document by document.

Layout (all numbers little-endian):

* data frames: independent zstandard frames, each with a content checksum,
  each holding the ids of whole documents one after another (2 or 4 bytes an id);
* one index frame: ``LWTI``, version, bytes an id, number of documents, then the
  columns doc_id, first id in the file, number of ids, data frame, and a bitmap
  of documents without an id;
* a seek table in a skippable frame, in the public zstandard seekable format:
  for every frame its compressed and plain size and the low half of the XXH64 of
  its plain bytes, then the number of frames, a flag byte and a magic number.

A reader fetches the end of the file, the index, and then only the frames of
the documents it is asked for.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator, Sequence
from typing import BinaryIO

import numpy as np
import xxhash
import zstandard

# Fixed values of the public zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

INDEX_MAGIC = b"LWTI"
INDEX_HEAD = struct.Struct("<4sHHQ")
FOOTER = struct.Struct("<IBI")
ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])

#: Plain bytes of a frame, so what a reader of one document decompresses at most beside the document.
FRAME_BYTES = 1 << 16


class TokenFileWriter:
    """Append documents in order; :meth:`close` writes index and seek table."""

    def __init__(self, out: BinaryIO, width: int, level: int = 3, frame_bytes: int = FRAME_BYTES):
        self.out, self.width, self.frame_bytes = out, width, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.kind = np.dtype("<u2" if width == 2 else "<u4")
        self.pending: list[bytes | memoryview] = []
        self.held = 0
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int | None, int, int, int]] = []
        self.total = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.extend([doc_id], ids, np.array([len(ids)]))

    def extend(self, doc_ids: Sequence[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents whose ids stand one after another."""
        raw = memoryview(ids.astype(self.kind, copy=False)).cast("B")
        at = 0
        for doc_id, size in zip(doc_ids, sizes.tolist()):
            length = size * self.width
            if self.held and self.held + length > self.frame_bytes:
                self._flush()
            self.docs.append((doc_id, self.total, size, len(self.entries)))
            self.pending.append(raw[at : at + length])
            self.held += length
            self.total += size
            at += length

    def _frame(self, plain: bytes) -> None:
        packed = self.zstd.compress(plain)
        self.out.write(packed)
        self.entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if self.pending:
            self._frame(b"".join(self.pending))
            self.pending, self.held = [], 0

    def close(self) -> None:
        self._flush()
        ids = np.array([d[0] or 0 for d in self.docs], "<i8")
        nulls = np.packbits(np.array([d[0] is None for d in self.docs], bool))
        columns = [np.array([d[k] for d in self.docs], "<i8") for k in (1, 2, 3)]
        self._frame(b"".join([INDEX_HEAD.pack(INDEX_MAGIC, 1, self.width, len(self.docs)), ids.tobytes(), *(c.tobytes() for c in columns), nulls.tobytes()]))
        table = np.array(self.entries, ENTRY).tobytes() + FOOTER.pack(len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class TokenFileReader:
    """Random access to the documents of one file (``source`` can seek)."""

    def __init__(self, source: BinaryIO):
        self.source = source
        end = source.seek(0, 2)
        source.seek(end - FOOTER.size)
        count, flag, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != SEEKABLE_MAGIC or not flag & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end")
        size = count * ENTRY.itemsize
        source.seek(end - FOOTER.size - size)
        self.table = np.frombuffer(source.read(size), ENTRY)
        self.at = np.concatenate(([0], np.cumsum(self.table["packed"], dtype=np.int64)))
        self.zstd = zstandard.ZstdDecompressor()
        index = self.frame(count - 1)
        magic, _, self.width, n = INDEX_HEAD.unpack_from(index)
        if magic != INDEX_MAGIC:
            raise ValueError("the last frame is no index")
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        columns = np.frombuffer(index, "<i8", 4 * n, INDEX_HEAD.size).reshape(4, n)
        self.doc_ids, self.first, self.size, self.frames = columns
        self.null = np.unpackbits(np.frombuffer(index, np.uint8, offset=INDEX_HEAD.size + 32 * n))[:n].astype(bool)

    def frame(self, k: int) -> bytes:
        """Plain bytes of frame k; wrong bytes raise."""
        self.source.seek(int(self.at[k]))
        plain = self.zstd.decompress(self.source.read(int(self.table["packed"][k])))
        if len(plain) != self.table["plain"][k] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.table["check"][k]:
            raise ValueError(f"frame {k} is damaged")
        return plain

    def rows(self, places: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id in the file, ids) of the documents at ``places`` (all if None), opening each frame once if they ascend."""
        held, plain, base = -1, b"", 0
        for i in range(len(self.doc_ids)) if places is None else places:
            if (k := int(self.frames[i])) != held:
                held, plain = k, self.frame(k)
                base = int(self.first[np.searchsorted(self.frames, k)])
            start = (int(self.first[i]) - base) * self.width
            yield None if self.null[i] else int(self.doc_ids[i]), int(self.first[i]), np.frombuffer(plain, self.kind, int(self.size[i]), start)

    def find(self, doc_id: int) -> list[np.ndarray]:
        """Ids of every document with this id, decompressing its frames only."""
        return [ids for _, _, ids in self.rows(np.flatnonzero((self.doc_ids == doc_id) & ~self.null))]
