"""Merge-type piece tokenising, exact, by backtracking over longest matches.

A text's spaces become marks, and it is cut at places that no piece can go over, as between words. In a chunk an
Aho-Corasick automaton finds the pieces that begin at each letter. From the left the longest piece is taken that its left
neighbour allows: two neighbours are compatible if merging their joined letters from the start gives the two again. Where
none is left, the place is marked in a bitfield as failed, the last piece is taken back and its next shorter one tried. A
sequence whose neighbours are all compatible is the one that merging gives, and no place fails twice, so that the work
follows the text. Letters that no piece knows become pieces of their bytes. Decoding emits pieces and bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larder.llm.common import Generations, give_back, own_worker, parts_of, prepare

MARK = "▁"
#: Bytes of each of the two generations of a worker's cache of chunks; pairs of neighbours and pieces kept as judged.
CACHE_BYTES, JUDGED = 48 << 20, 1 << 17
#: Letters of a chunk whose pieces are looked up at once.
WINDOW = 1 << 14
#: A letter that no piece knows, as (length, id).
LETTER = (1, -1)
#: Kinds of pieces in a model file (fixed values).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@dataclass(frozen=True)
class Vocabulary:
    """(piece, score, kind) by id, and whether a text gets a mark before it."""

    pieces: tuple[tuple[str, float, int], ...]
    prefix: bool


def merged(text: str, score: dict[str, float]) -> list[str]:
    """The letters of a short string merged: always the pair of the best score, of equal ones the leftmost."""
    parts = list(text)
    while True:
        best, at = None, -1
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if best is None:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def read_model(path: str) -> Vocabulary:
    """A model file of merge type whose letters are taken as they are and fall back to bytes; any other raises ValueError."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    spec, kinds = m.normalizer_spec, {p.type for p in m.pieces}
    plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.escape_whitespaces and not m.trainer_spec.treat_whitespace_as_suffix
    if m.trainer_spec.model_type != m.trainer_spec.BPE or not plain or not m.trainer_spec.byte_fallback or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError(f"{path}: not a merge-type model with byte fallback and letters as they are")
    return Vocabulary(tuple((p.piece, p.score, p.type) for p in m.pieces), spec.add_dummy_prefix)


def chunk_pattern(pieces: list[str]) -> re.Pattern:
    """What cuts a text into chunks that no piece goes over: marks, then letters that stand beside one another in some
    piece, or beside others that do. Where a piece has a mark after a letter, a text is one chunk."""
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        return re.compile("(?s).+")
    group: dict[str, set[str]] = {}
    for p in {p.lstrip(MARK) for p in pieces}:
        for a, b in zip(p, p[1:]):
            one, other = sorted((group.setdefault(a, {a}), group.setdefault(b, {b})), key=len)
            if one is not other:
                other |= one
                group.update(dict.fromkeys(one, other))
    classes = {id(g): "".join(map(re.escape, sorted(g))) for g in group.values()}
    return re.compile(f"(?s){MARK}*(?:{''.join(f'[{c}]+|' for c in classes.values())}[^{MARK}])|{MARK}+")


class Chunks(Generations):
    """A cache that is asked for the chunks of one text at a time: these are looked up, while a set's difference, which suits
    many keys, would walk the whole cache."""

    def missing(self, keys: set) -> set:
        new = {k for k in keys if k not in self}
        back = [k for k in new if k in self.old]
        if back:
            self.add(back, [self.old[k] for k in back])
            new.difference_update(back)
        return new


class Pieces:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.text = vocabulary, [p for p, _, _ in vocabulary.pieces]
        self.score = {p: s for p, s, kind in vocabulary.pieces if kind == NORMAL}
        byte_ids = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(vocabulary.pieces) if kind == BYTE}
        self.byte_ids = [byte_ids[b] for b in range(256)]
        shown = {NORMAL: lambda p: p.replace(MARK, " ").encode(), BYTE: lambda p: bytes([int(p[1:-1], 16)]), UNKNOWN: lambda p: " ⁇ ".encode(), CONTROL: lambda p: b""}
        self.shown = {str(i): shown[kind](p) for i, (p, _, kind) in enumerate(vocabulary.pieces)}
        self.longest = max(map(len, self.score), default=1)
        self.automaton = ahocorasick.Automaton()
        for i, (p, _, kind) in enumerate(vocabulary.pieces):
            if kind == NORMAL and merged(p, self.score) == [p]:  # others are never what merging gives
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.chunks = chunk_pattern(list(self.score))
        self.words, self.judged, self.judged_before = Chunks(CACHE_BYTES), {}, {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether two pieces stay as they are when their joined letters are merged from the start."""
        key = left << 32 | right
        known = self.judged.get(key)
        if known is None:
            known = self.judged_before.get(key)
            if known is None:
                known = merged(self.text[left] + self.text[right], self.score) == [self.text[left], self.text[right]]
            if len(self.judged) >= JUDGED:
                self.judged, self.judged_before = {}, self.judged
            self.judged[key] = known
        return known

    def _beginning(self, text: str, first: int = 0) -> list[list[tuple[int, int]]]:
        """(length, id) of the pieces that begin at each place of a window, shortest first; a letter that is no piece is -1."""
        part = text if len(text) <= WINDOW else text[first : first + WINDOW + self.longest]
        found: list[list[tuple[int, int]]] = [[] for _ in part]
        for end, piece in self.automaton.iter(part):
            found[end - piece[0] + 1].append(piece)
        for own in found:
            if not own or own[0][0] > 1:
                own.insert(0, LETTER)
        return found

    def split(self, text: str) -> list[int]:
        """The ids of a chunk's pieces as merging gives them, -1 for a letter that no piece knows."""
        windows: dict[int, list[list[tuple[int, int]]]] = {}
        taken: list[tuple[int, int]] = []
        at, last, shorter = 0, -1, None
        failed = bytearray(len(text) // 8 + 1)
        while at < len(text):
            w = at // WINDOW
            if w not in windows:
                if len(windows) > 1:
                    windows.clear()
                windows[w] = self._beginning(text, w * WINDOW)
            choice = windows[w][at % WINDOW]
            for k in range((len(choice) if shorter is None else shorter) - 1, -1, -1):
                n, piece = choice[k]
                end = at + n
                if not failed[end >> 3] >> (end & 7) & 1 and (last < 0 or piece < 0 or self.compatible(last, piece)):
                    taken.append((k, last))
                    at, last, shorter = end, piece, None
                    break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                shorter, before = taken.pop()  # there is always one: the pieces that merging gives are allowed
                at -= 1 if last < 0 else len(self.text[last])
                last = before
        ids = [before for _, before in taken[1:]] + [last]
        return ids if text else []

    def chunk_ids(self, chunk: str) -> str:
        out, at = [], 0
        for piece in self.split(chunk):
            out += self.byte_of(chunk[at]) if piece < 0 else [piece]
            at += 1 if piece < 0 else len(self.text[piece])
        return ",".join(map(str, out))

    def byte_of(self, letter: str) -> list[int]:
        return [self.byte_ids[b] for b in letter.encode()]

    def encode(self, text: str) -> str:
        """The ids of a whole text in decimal digits, joined by commas."""
        if not text:
            return ""
        chunks = self.chunks.findall((MARK if self.vocabulary.prefix else "") + text.replace(" ", MARK))
        self.words.make_room()
        new = list(self.words.missing(set(chunks)))
        self.words.add(new, [self.chunk_ids(c) for c in new])
        return ",".join(map(self.words.__getitem__, chunks))

    def decode(self, ids: str) -> str:
        """The text of ids as ``encode`` writes them; bytes that are no UTF-8 become replacement characters."""
        if not ids:
            return ""
        text = b"".join(map(self.shown.__getitem__, ids.split(","))).decode("utf-8", "replace")
        return text[1:] if self.vocabulary.prefix and text.startswith(" ") else text


_MODELS: dict[Vocabulary, Pieces] = {}


def forget() -> None:
    _MODELS.clear()


def _round_trip(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("piece", forget)
        pieces = _MODELS.get(vocabulary.value) or _MODELS.setdefault(vocabulary.value, Pieces(vocabulary.value))
        for whole in batches:
            for batch in parts_of(whole):
                n, ids_hash, text_hash = [], [], []
                for text in batch.column("text").cast(pa.string()):
                    ids = pieces.encode(text.as_py() or "")
                    n.append(ids.count(",") + 1 if ids else 0)
                    ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_hash.append(hashlib.sha256(pieces.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    return run


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 of its whole text.

    A null text counts as empty and has no tokens. Repeated rows are encoded each; an empty table gives an empty result. Only
    doc_id and text are read. The model file is read by the driver; tasks get its pieces, some MB at most, by a broadcast.
    """
    spark = docs.sparkSession
    prepare(spark)
    vocabulary = spark.sparkContext.broadcast(read_model(model_path))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_round_trip(vocabulary), SCHEMA)
