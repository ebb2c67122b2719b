"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model holds a white space marker after another character, and
none holds a line break with anything else, so a marked text falls apart into
chunks (markers and what follows up to the next marker, or line breaks) that are
segmented independently. Both properties are checked against the model when it is
loaded.

Texts are read in blocks with a bounded number of distinct chunks. A first pass
gives these, numbered in the order in which the block meets them; all blocks'
chunks are dealt by the chunk and sorted, so that each distinct one is segmented
and decoded once, on whatever worker, for all blocks that ask; and the answers are
packed and written to the shared folder, block by block. A second pass reads the
same texts and a block's answers, and puts every text together from them by
position. So neither texts nor positions are shuffled. An answer spells its chunk:
should an input come in another order the second time, what does not fit is
segmented where it is met.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import sentencepiece
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm._shared import arrow_batches
from lexiloom.plans.materialise import materialise

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n+")
PART = 1 << 16  # chunks of a long text that are handled at once
BLOCK = 1_000_000  # distinct chunks after which a block ends, at the end of a batch
PACK = 1 << 19  # answers that are packed at once


class Segmenter:
    """The library, for chunks as parts of marked texts."""

    def __init__(self, model: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(self.library.get_piece_size())
        self.pieces = [self.library.id_to_piece(i) for i in ids]
        if any(MARK in p.lstrip(MARK) or "\n" in p for i, p in zip(ids, self.pieces) if not self.library.is_byte(i)):
            raise ValueError("pieces of this model cross white space markers or line breaks")
        probe = "A  b ①ﬁ　é "
        if self.library.decode(self.library.encode(probe)) != probe:
            raise ValueError("this model normalises text, so chunks are not independent")
        self.bytes = {i: int(self.pieces[i][1:-1], 16) for i in ids if self.library.is_byte(i)}
        self.names = list(map(str, ids))
        self.head = self.library.encode("\n")  # the marker put before every text, and a line break
        self.cover = self.library.piece_to_id("a")

    def ids(self, chunks: list[str]) -> list[list[int]]:
        """The ids of each chunk. A line break before each keeps the library's own marker apart."""
        found = self.library.encode(["\n" + c for c in chunks], num_threads=1)
        n = len(self.head)
        if any(x[:n] != self.head for x in found):
            raise AssertionError("a chunk's context changed its segmentation")
        return [x[n:] for x in found]

    def decoded(self, found: list[list[int]]) -> list[str]:
        """What the ids of each chunk decode to behind other text."""
        return [d[1:] for d in self.library.decode([[self.cover, *x] for x in found], num_threads=1)]

    def spells(self, ids: list[int], chunk: str) -> bool:
        """Whether the chunk is what the ids' pieces and bytes spell."""
        if "".join([self.pieces[i] for i in ids]) == chunk:
            return True
        if self.bytes.keys().isdisjoint(ids):
            return False
        raw = b"".join(bytes([self.bytes[i]]) if i in self.bytes else self.pieces[i].encode() for i in ids)
        return raw == chunk.encode("utf-8", "surrogatepass")


@lru_cache(2)
def segmenter(model: str) -> Segmenter:
    return Segmenter(model)


class Positions(dict):
    """chunk -> its position among the distinct chunks met so far."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        return n

    def of(self, text: str) -> np.ndarray:
        """The positions of a text's chunks, in order; a long text goes part by part."""
        marked = MARK + text.replace(" ", MARK) if text else ""
        if len(marked) <= PART:
            chunks = CHUNK.findall(marked)
            return np.fromiter(map(self.__getitem__, chunks), np.uint32, len(chunks))
        hits, parts = CHUNK.finditer(marked), []
        while chunks := [hit[0] for hit in islice(hits, PART)]:
            parts.append(np.fromiter(map(self.__getitem__, chunks), np.uint32, len(chunks)))
        return np.concatenate(parts)


class Blocks:
    """Numbers the blocks of a partition, alike in both passes."""

    def __init__(self):
        self.block = TaskContext.get().partitionId() << 32
        self.known = Positions()

    def full(self) -> bool:
        return len(self.known) >= BLOCK

    def next(self) -> None:
        self.block += 1
        self.known = Positions()


def asked(source: DataFrame, column: int) -> DataFrame:
    """(block, at, chunk): the distinct chunks of every block of texts, numbered as the block meets them."""

    def rows(blocks: Blocks, start: int) -> pa.RecordBatch:
        fresh = pa.array(list(islice(blocks.known, start, None)), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(fresh), blocks.block)), pa.array(np.arange(start, start + len(fresh), dtype=np.int32)), fresh], names=["block", "at", "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks()
        for batch in batches:
            start = len(blocks.known)
            for text in batch.column(column).to_pylist():
                blocks.known.of(text)
            yield rows(blocks, start)
            if blocks.full():
                blocks.next()

    return source.mapInArrow(run, "block long, at int, chunk string")


ANSWERS = "block long, n array<int>, packed binary, odd array<struct<at:int,text:string>>"


def meeting(chunks: DataFrame) -> DataFrame:
    """(block, at, chunk) with equal chunks one after another in one partition."""
    return chunks.select("block", "at", "chunk").repartition("chunk").sortWithinPartitions("chunk")


def packed(at: np.ndarray, size: np.ndarray, ids: np.ndarray) -> bytes:
    """Answers of a block: positions (ascending), numbers of ids, and ids."""
    return pa.Codec("zstd").compress(np.diff(at, prepend=0).astype("<u4").tobytes() + size.astype("<u4").tobytes() + ids.astype("<u4").tobytes(), asbytes=True)


def unpacked(data: bytes, n: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = np.frombuffer(pa.Codec("zstd").decompress(data, decompressed_size=4 * (2 * n + total), asbytes=True), "<u4")
    return np.cumsum(values[:n], dtype=np.int64), values[n : 2 * n].astype(np.int64), values[2 * n :]


def segment_batches(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    """ANSWERS of rows that ``meeting`` has brought together; each distinct chunk is segmented once.

    Answers are gathered up to PACK and packed by block; ``odd`` holds what
    decodes to another text than the chunk with spaces for markers.
    """
    last: dict[str, tuple[list[int], str | None]] = {}
    blocks, places, entries, held = [], [], [], 0

    def flush() -> pa.RecordBatch:
        block, at = np.concatenate(blocks), np.concatenate(places)
        order = np.lexsort((at, block))
        heads = np.flatnonzero(np.diff(block[order], prepend=-1))
        sizes = np.array([len(e[0]) for e in entries])
        rows = ([], [], [], [])
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(order)]):
            mine = order[a:b].tolist()
            ids = np.array([i for k in mine for i in entries[k][0]], np.uint32)
            for column, value in zip(rows, (int(block[mine[0]]), [len(mine), len(ids)], packed(at[mine], sizes[mine], ids), [{"at": int(at[k]), "text": entries[k][1]} for k in mine if entries[k][1] is not None])):
                column.append(value)
        kinds = (pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string())])))
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(rows, kinds)], names=["block", "n", "packed", "odd"])

    for batch in batches:
        own = batch.column(2).to_pylist()
        fresh = [c for c in dict.fromkeys(own) if c not in last]
        ids = segmenter(model).ids(fresh) if fresh else []
        texts = segmenter(model).decoded(ids) if fresh else []
        known = last | {c: (x, None if text == c.replace(MARK, " ") else text) for c, x, text in zip(fresh, ids, texts)}
        last = {c: known[c] for c in own[-1:]} or last
        blocks.append(np.asarray(batch.column(0)))
        places.append(np.asarray(batch.column(1)))
        entries += map(known.__getitem__, own)
        held += len(own)
        if held >= PACK:
            yield flush()
            blocks, places, entries, held = [], [], [], 0
    if held:
        yield flush()


def segmented(chunks: DataFrame, model: str) -> DataFrame:
    return meeting(chunks).mapInArrow(lambda batches: segment_batches(batches, model), ANSWERS)


class Entries:
    """The answers for a block, by position: ids, their number and the decoded text of each chunk."""

    def __init__(self, folder: str, block: int, model: str):
        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        self.model, self.ids, self.decoded = model, [], []
        self.count = np.zeros(0, np.int64)
        self.starts, self.flat, self.odd = np.full(1, 0), np.zeros(0, np.uint32), {}
        found = system.get_file_info(fs.FileSelector(f"{root}/block={block}", allow_not_found=True))
        at, size, flat = [], [], []
        for f in found:
            if not f.path.endswith(".parquet"):
                continue
            for row in pq.read_table(f.path, filesystem=system, partitioning=None).to_pylist():
                for part, values in zip((at, size, flat), unpacked(row["packed"], *row["n"])):
                    part.append(values)
                self.odd |= {x["at"]: x["text"] for x in row["odd"]}
        if at:
            at, size, flat = map(np.concatenate, (at, size, flat))
            order = np.argsort(at, kind="stable")
            if (at[order] == np.arange(len(at))).all():
                begin = np.cumsum(size) - size
                # The flat ids, dealt again in the order of their positions.
                self.starts = np.concatenate([[0], np.cumsum(size[order])]).astype(np.int64)
                self.flat = flat[np.repeat(begin[order] - self.starts[:-1], size[order]) + np.arange(len(flat))]

    def learn(self, known: Positions) -> None:
        """Entries of the chunks met since."""
        library, start = segmenter(self.model), len(self.ids)
        fresh = list(islice(known, start, None))
        have = max(0, min(len(fresh), len(self.starts) - 1 - start))
        flat, at = self.flat[self.starts[start] : self.starts[start + have]].tolist() if have else [], (self.starts[start : start + have + 1] - self.starts[start]).tolist() if have else [0]
        names, counts = library.names, []
        for k, chunk in enumerate(fresh):
            ids = flat[at[k] : at[k + 1]] if k < have else None
            if ids is None or not library.spells(ids, chunk):
                (ids,) = library.ids([chunk])
                self.decoded += library.decoded([ids])
            else:
                self.decoded.append(self.odd.get(start + k) or chunk.replace(MARK, " "))
            self.ids.append(",".join([names[i] for i in ids]))
            counts.append(len(ids))
        self.count = np.concatenate([self.count, np.array(counts, np.int64)])


def digests(places: np.ndarray, ids: list[str], decoded: list[str]) -> tuple[str, str]:
    """Digests of a text's ids, joined by commas, and of its decoded text, of which the marker put before it is no part."""
    one, other = hashlib.sha256(), hashlib.sha256()
    for k in range(0, len(places), PART):
        part = places[k : k + PART].tolist()
        one.update(("," * (k > 0) + ",".join(map(ids.__getitem__, part))).encode())
        other.update("".join(map(decoded.__getitem__, part))[k == 0 :].encode())
    return one.hexdigest(), other.hexdigest()


def encode_decode(df: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """``keep``, n_tokens, ids_sha256 and decoded_sha256 of every row; with_ids: also the ids and the decoded text.

    A null text counts as empty and has no ids. Repeated rows stay, an empty
    table gives an empty result, and other columns of the table are not read. A
    very long text is read and put together in parts.
    """
    arrow_batches(df.sparkSession)
    inner = [f"__keep{i}" for i in range(len(keep))]
    k = len(inner)
    source = df.select(*[F.col(c).alias(n) for c, n in zip(keep, inner)], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    folder = materialise(segmented(asked(source, k), model).repartition("block"), "chunks", "block")._lexiloom_path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, entries = Blocks(), None
        for batch in batches:
            entries = entries or Entries(folder, blocks.block, model)
            places = [blocks.known.of(t) for t in batch.column(k).to_pylist()]
            entries.learn(blocks.known)
            made = [digests(p, entries.ids, entries.decoded) for p in places]
            columns = [*batch.columns[:k], pa.array([int(entries.count[p].sum()) for p in places], pa.int64()), pa.array([a for a, _ in made], pa.string()), pa.array([b for _, b in made], pa.string())]
            names = [*inner, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array([[int(x) for at in p.tolist() for x in entries.ids[at].split(",")] for p in places], pa.list_(pa.int32())))
                columns.append(pa.array(["".join(map(entries.decoded.__getitem__, p.tolist()))[1:] for p in places], pa.string()))
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            if blocks.full():
                blocks.next()
                entries = None

    schema = [f"`{n}` {source.schema[n].dataType.simpleString()}" for n in inner] + ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"]
    out = source.mapInArrow(run, ", ".join(schema + ["ids array<int>", "decoded string"] * with_ids))
    return out.withColumnsRenamed(dict(zip(inner, keep)))
