"""Packing: concatenate all documents' tokens and cut the stream into fixed windows.

Pass one tokenises every document once and writes its ids with its offset inside the partition. The partitions' token
totals, one number each, give the global offsets by prefix sum. Pass two cuts at multiples of the window; a document that
crosses a boundary gives one record on either side. No row is shuffled.
"""

from __future__ import annotations

import os
import zlib
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from larder.llm.bpe import MARKS, read_file
from larder.llm.common import Generations, give_back, materialise, own_worker, parts_of, prefix_sums, prepare

WINDOW = 2048
END_ID = 1
#: Bytes that each of the two generations of the chunk cache in one Python worker may hold.
CACHE_BYTES = 24 << 20
BYTE_MARKS = MARKS.encode()

TOKEN_SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids binary"
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ChunkEncoder:
    """A tokenizers file whose pre-tokenizer drops white space: chunks between ASCII white space encode on their own.

    Chunks are numbered in Arrow, each distinct one is encoded once while it stays in the cache, and a text's ids are the
    joined ids of its chunks. Words of plain letters go through the file's automaton many at a time, all else through the
    library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.automaton, self.special, _ = read_file(path)
        self.dtype = self.automaton.kind
        self.cache = Generations(CACHE_BYTES)

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, packed as ``dtype``."""
        texts = texts.fill_null("")
        odd = pa.array(np.zeros(len(texts), bool))
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        plain = pc.ascii_split_whitespace(pc.ascii_lower(texts.filter(pc.invert(odd))))
        odd = odd.to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        if len(plain):
            coded = plain.flatten().cast(pa.binary()).dictionary_encode()
            begin, index = plain.offsets.to_numpy().tolist(), coded.indices.to_numpy().tolist()
            look = self._ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist()).__getitem__
            for i, a, b in zip(np.flatnonzero(~odd).tolist(), begin, begin[1:]):
                out[i] = b"".join(map(look, index[a:b]))
        for i in np.flatnonzero(odd).tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, self.dtype).tobytes()
        return out

    def _ids_of(self, chunks: list[bytes]) -> list[bytes]:
        have = self.cache
        have.make_room()
        words: set[bytes] = set()
        other: set[bytes] = set()
        joined: list[tuple[bytes, bytes, bytes]] = []
        for c in have.missing(set(chunks)):
            word = c.rstrip(BYTE_MARKS)
            if not is_word(word):
                other.add(c)
            elif len(word) == len(c):
                words.add(c)
            else:  # letters and then marks are two words of the pre-tokenizer
                joined.append((c, word, c[len(word) :]))
        words |= have.missing({w for _, w, _ in joined})
        other |= have.missing({m for _, _, m in joined})
        other.discard(b"")
        have.add([b""], [b""])
        todo = list(words)
        have.add(todo, self.automaton.paths([w if w.isascii() else w.decode().lower().encode() for w in todo], ended=True))
        for part in batched(other, 10_000):
            got = self.tokenizer.encode([c.decode() for c in part], is_pretokenized=True, add_special_tokens=False)
            packed, at = np.array(got.ids, dtype=self.dtype).tobytes(), (np.searchsorted(np.array(got.word_ids, dtype=np.int64), np.arange(len(part) + 1)) * self.dtype.itemsize).tolist()
            have.add(part, [packed[a:b] for a, b in zip(at, at[1:])])
        look = have.__getitem__
        have.add([c for c, _, _ in joined], [look(w) + look(m) for _, w, m in joined])
        return list(map(look, chunks))


def is_word(chunk: bytes) -> bool:
    """Whether a chunk is letters of Latin-1 alone, which the pre-tokenizer never splits."""
    return chunk.isalpha() or (not chunk.isascii() and max(text := chunk.decode()) <= "\xff" and text.isalpha())


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Let go of this worker's caches. A function of the module, so that tasks reach the worker's own and carry none."""
    _ENCODERS.clear()


def _tokenise(path: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        own_worker("packing", forget)
        enc, part, at = encoder(path), TaskContext.get().partitionId(), 0
        tail = np.array([end_id], dtype=enc.dtype).tobytes()
        for whole in batches:
            for batch in parts_of(whole):
                ids = [x + tail for x in enc.encode_all(batch.column("text").cast(pa.string()))]
                n = np.array([len(x) // enc.dtype.itemsize for x in ids], dtype=np.int64)
                start = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.full(len(ids), part, np.int32)), pa.array(start), pa.array(n), pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
        give_back()

    return run


def _cut(window: int):
    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, begin, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "begin", "n_tokens", "ids"))):
                wide = np.frombuffer(ids, dtype=f"<u{len(ids) // n}").astype("<u4")
                at = begin
                while at < begin + n:
                    sequence, offset = divmod(at, window)
                    length = min(begin + n - at, window - offset)
                    start = at - begin
                    for column, value in zip(out, (doc, start, length, zlib.crc32(wide[start : start + length].tobytes()), n, sequence, offset)):
                        column.append(value)
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[x.split()[0] for x in PIECE_SCHEMA.split(", ")])

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id lies in exactly one piece; only the last sequence can be short, so at most ``window - 1`` ids are padding.
    A null or empty text is the end id alone. Repeated rows are packed each; an empty table gives an empty result. Only
    doc_id and text are read.
    """
    prepare(docs.sparkSession)
    tokens = materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_tokenise(tokenizer_path, end_id), TOKEN_SCHEMA), "pack-tokens")
    totals = [(r["part"], r["n"]) for r in tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()]
    offsets = docs.sparkSession.createDataFrame(list(prefix_sums(totals).items()) or [(0, 0)], "part int, base long")
    placed = tokens.join(F.broadcast(offsets), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("begin"), "n_tokens", "ids")
    return placed.mapInArrow(_cut(window), PIECE_SCHEMA)
