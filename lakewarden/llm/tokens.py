"""Token ids of whole documents, written as seekable files and read back.

Documents are range-partitioned by id, so file k holds ids below those of file
k + 1, and every task streams its documents into one file (see ``tokenfile``).
A task writes under a name of its own attempt and moves the file into place, so
a repeated task leaves the same file.
"""

from __future__ import annotations

import codecs
import os
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from lakewarden.llm import scratch
from lakewarden.llm.tokenfile import TokenFileReader, TokenFileWriter
from lakewarden.sources.tables import table

END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
#: Pieces whose ids a worker remembers, and the longest of them in bytes.
REMEMBERED, LONGEST = 500_000, 64
#: Bytes of text encoded at a time (a longer text goes by itself).
SLICE_BYTES = 10 << 20
#: Pieces that go to the tokenizer as one text.
PIECES = 4096
_loaded: dict[str, PieceEncoder] = {}

# Kinds of bytes. OTHER parts nothing: only the tokenizer knows what it does beside its neighbours.
LETTER, DIGIT, MARK, SPACE, LINE, OTHER, NONE = range(7)
_KINDS = np.full(256, OTHER, np.uint8)
_KINDS[0x21:0x7F] = MARK
_KINDS[ord("0") : ord("9") + 1] = DIGIT
_KINDS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = LETTER
_KINDS[ord("'")] = OTHER  # can begin a contraction
_KINDS[ord(" ")], _KINDS[ord("\n")] = SPACE, LINE


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """The kind of every byte of UTF-8; both bytes of a Latin letter (U+00C0 to U+024F) are letters."""
    kinds = _KINDS[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
    lead = lead[lead + 1 < len(data)]
    first, second = data[lead], data[lead + 1]
    # No letters: the signs for times and divided by, and what follows U+024F.
    lead = lead[~((first == 0xC3) & ((second == 0x97) | (second == 0xB7)) | (first == 0xC9) & (second > 0x8F))]
    kinds[lead] = kinds[lead + 1] = LETTER
    return kinds


def byte_letters() -> str:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from U+0100 on."""
    prints = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    later = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in prints else chr(next(later)) for b in range(256))


class PieceEncoder:
    """Encodes texts with one byte-level BPE tokenizer, each different piece once.

    The tokenizer first parts a text into runs of letters, digits or marks, each
    with the space before it, and runs of white space; the ids of a run do not
    depend on what is beside it. It always parts where white space follows
    another character, so what lies between two such places can be encoded by
    itself too. Runs are cut here from the kinds of all bytes at once; a stretch
    with a byte of unknown kind is one piece, and so is a text with an added
    token. Pieces are numbered by Arrow, new ones encoded - runs in one text a
    few thousand, told apart by a delimiter, other pieces whole - and ids are
    gathered by number. Pieces are remembered from slice to slice, at most
    ``REMEMBERED`` and those of the last slice.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.runs = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.runs.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # byte-level tokens have a character a byte
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)
        self.letters = "\n" + byte_letters()[1:]  # no run holds a zero byte, so it can be the delimiter
        self.known, self.ids = pa.array([], pa.binary()), pa.array([], pa.binary())

    @classmethod
    def get(cls, path: str) -> PieceEncoder:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _cuts(self, data: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Where pieces begin in the texts that end at ``ends``; those marked ``whole`` are one piece each."""
        kinds = byte_kinds(data)
        before, after = np.empty_like(kinds), np.empty_like(kinds)
        before[1:], after[:-1] = kinds[:-1], kinds[1:]
        starts = np.concatenate(([0], ends[:-1]))
        filled = ends > starts
        before[starts[filled]] = after[ends[filled] - 1] = NONE
        word, blank = kinds <= MARK, (kinds == SPACE) | (kinds == LINE)
        after_word, after_blank = before <= MARK, (before == SPACE) | (before == LINE)
        hard = blank & after_word | (before == NONE)
        soft = word & after_word & (kinds != before) | word & (before == LINE) | blank & after_blank & (after <= MARK)
        # Nothing is cut softly in a stretch with a byte of unknown kind or in a whole text, and the latter not at all.
        places = np.flatnonzero(hard)
        closed = np.logical_or.reduceat(kinds == OTHER, places) if len(places) else np.zeros(0, bool)
        for a, b in zip(starts[whole & filled].tolist(), ends[whole & filled].tolist()):
            inside = slice(*np.searchsorted(places, [a, b]))
            closed[inside] = True
            hard[a + 1 : b] = False
        soft &= ~np.repeat(closed, np.diff(places, append=len(data)))
        return np.flatnonzero(hard | soft)

    def _runs(self, pieces: pa.BinaryArray) -> list[np.ndarray]:
        """Ids of runs, one after another; the bytes of the tokens tell where each ends."""
        found = []
        for at in range(0, len(pieces), PIECES):
            text = codecs.charmap_decode(b"\0".join(pieces.slice(at, PIECES).to_pylist()), "strict", self.letters)[0]
            found.append(np.array(self.runs.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind))
        return found

    def _encode_pieces(self, pieces: pa.BinaryArray) -> pa.BinaryArray:
        """The ids of each of different pieces, as bytes."""
        if not len(pieces):
            return pa.array([], pa.binary())
        offsets = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1, pieces.offset * 4)
        data = np.frombuffer(pieces.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        other = np.logical_or.reduceat(byte_kinds(data) == OTHER, offsets[:-1] - offsets[0])
        for token in self.added:
            other |= pc.match_substring(pieces, token).to_numpy(zero_copy_only=False)
        runs = np.flatnonzero(~other)
        flat = np.concatenate([np.zeros(0, self.kind), *self._runs(pieces.take(pa.array(runs)))])
        ends = np.searchsorted(np.cumsum(self.bytes[flat]), np.cumsum(np.diff(offsets)[runs])) + 1
        texts = [p.decode() for p in pieces.take(pa.array(np.flatnonzero(other))).to_pylist()]
        others = [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        sizes = np.zeros(len(pieces), np.int64)
        sizes[runs] = np.diff(ends, prepend=0)
        sizes[other] = [len(o) for o in others]
        made = binary(np.concatenate([flat, *others]).tobytes(), np.concatenate((sizes[runs], sizes[other])) * self.kind.itemsize)
        place = np.empty(len(pieces), np.int64)
        place[np.concatenate((runs, np.flatnonzero(other)))] = np.arange(len(pieces))
        return made.take(pa.array(place))

    def encode(self, texts: pa.StringArray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each followed by ``end_id`` if given, and their numbers; a null is an empty text."""
        texts = pc.fill_null(texts, "")
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4) if len(texts) else np.zeros(1, np.int32)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
        ends = (offsets[1:] - offsets[0]).astype(np.int64)
        whole = np.zeros(len(texts), bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        cuts = self._cuts(data, ends, whole)
        coded = binary(data, np.diff(cuts, append=len(data))).dictionary_encode()
        pieces, number = coded.dictionary, coded.indices.to_numpy()
        place = pc.index_in(pieces, value_set=self.known)
        fresh = pc.is_null(place)
        added = pieces.filter(fresh)
        ids = pa.concat_arrays([self.ids, self._encode_pieces(added)])
        at = pc.fill_null(place, 0).to_numpy().astype(np.int32)
        at[fresh.to_numpy(zero_copy_only=False)] = np.arange(len(self.known), len(ids))
        # The end id is one more piece behind every text.
        counts = np.searchsorted(cuts, ends)
        codes = at[number]
        if end_id is not None:
            codes = np.insert(codes, counts, len(ids))
            counts = counts + np.arange(1, len(ends) + 1)
            ids_and_end = pa.concat_arrays([ids, pa.array([np.array([end_id], self.kind).tobytes()], pa.binary())])
        else:
            ids_and_end = ids
        gathered = ids_and_end.take(pa.array(codes))
        bounds = np.frombuffer(gathered.buffers()[1], np.int32, len(gathered) + 1) if len(gathered) else np.zeros(1, np.int32)
        flat = np.frombuffer(gathered.buffers()[2] or b"", self.kind, int(bounds[-1]) // self.kind.itemsize) if len(gathered) else np.zeros(0, self.kind)
        self._remember(pieces, added, ids, at)
        return flat, np.diff(bounds[counts].astype(np.int64) // self.kind.itemsize, prepend=0)

    def _remember(self, pieces: pa.BinaryArray, added: pa.BinaryArray, ids: pa.BinaryArray, at: np.ndarray) -> None:
        """Keep the ids of short pieces: of all so far, or, if they are too many, of the last texts."""
        if len(ids) <= REMEMBERED:
            known, ids = pa.concat_arrays([self.known, added]), ids
        else:
            known, ids = pieces, ids.take(pa.array(at))
        short = pc.less_equal(pc.binary_length(known), LONGEST)
        self.known, self.ids = known.filter(short), ids.filter(short)


def binary(data: bytes | np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    """Byte strings of these sizes that stand one after another."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _slices(texts: pa.StringArray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes of text."""
    held = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // most
    cuts = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), len(texts)]
    return zip(cuts, cuts[1:])


def write_tokens(
    docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, order_by: Sequence[Column] | None = None
) -> DataFrame:
    """Write ``docs`` below ``folder`` by ascending id, or by ``order_by``; one row a file: file_no, path, n_docs, n_tokens. Starts the job.

    A null text is empty, so its document is the end id alone; a null id comes
    first; rows of equal keys stay, side by side, in the order in which they are
    read; an empty table writes no file; other columns are ignored. ``folder``
    is any place pyarrow can write.
    """
    path = tokenizer or public_tokenizers.path(VOCABULARY)
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number, attempt = PieceEncoder.get(path), TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        files, base = pafs.FileSystem.from_uri(folder)
        target, partial = f"{base}/tokens-{number:06d}.ztok", f"{base}/.tokens-{number:06d}.{attempt}"
        out = writer = None
        for batch in batches:
            for a, b in _slices(batch.column(1), SLICE_BYTES):
                if writer is None:
                    files.create_dir(base, recursive=True)
                    out = files.open_output_stream(partial)
                    writer = TokenFileWriter(out, encoder.kind.itemsize)
                writer.extend(batch.column(0).slice(a, b - a).to_pylist(), *encoder.encode(batch.column(1).slice(a, b - a), end_id))
        if writer is not None:
            writer.close()
            out.close()
            if files.get_file_info(target).type != pafs.FileType.NotFound:
                files.delete_file(target)
            files.move(partial, target)
            found = {"file_no": number, "path": f"{folder}/tokens-{number:06d}.ztok", "n_docs": len(writer.docs), "n_tokens": writer.total}
            yield pa.RecordBatch.from_pylist([found])

    keys = [F.col(id_col).cast("long")] if order_by is None else list(order_by)
    places = [f"_place{k}" for k in range(len(keys) + 1)]
    # The row's number parts rows of one key, so that no task gets all of them.
    placed = [*keys, F.monotonically_increasing_id()]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[k.alias(p) for k, p in zip(placed, places)])
    ordered = rows.repartitionByRange(*places).sortWithinPartitions(*places).select("doc_id", "text")
    return scratch.stage(ordered.mapInArrow(run, "file_no long, path string, n_docs long, n_tokens long"), "token-files")


def read_tokens(files: DataFrame) -> DataFrame:
    """Per document of the written files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    ``files`` has one row a file, so the running sum over it is small. Every
    frame is decompressed once and checked.
    """
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                place, path = pafs.FileSystem.from_uri(uri)
                with place.open_input_file(path) as source:
                    held: list[tuple] = []
                    for doc_id, first, ids in TokenFileReader(source).rows():
                        held.append((doc_id, base + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(held) == 8192:
                            yield _rows(held)
                            held = []
                    yield _rows(held)

    count = files.count()
    spread = files.withColumn("before", before).select("path", "before").repartition(max(1, min(count, 8192)))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(held: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*held)) or [()] * 4
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def written_order(docs: DataFrame) -> list[Column] | None:
    """The order in which the rows of a Parquet scan were written; None for frames that are no scan, which have none."""
    order = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    try:
        docs.select(*order)
    except AnalysisException:
        return None
    return order


def tokenize(docs: DataFrame, **options) -> DataFrame:
    """Write to a new folder below the shared one and read back."""
    return read_tokens(write_tokens(docs, scratch.new_path(docs.sparkSession, "tokens"), **options))


def op7_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize(table(spark, folder, "documents"))


QUERIES = {"op7_tokens": op7_tokens}
ORACLES: dict[str, str] = {}
