"""Byte-level BPE as a deterministic automaton over token arcs.

States are named by the last arc taken. The automaton starts with one arc per symbol, all allowed everywhere. Merge rules
are added in order, each as a gadget: the new token's state takes over the arcs of the rule's right token, arcs into it
are those of the left token, and the right token's arc is removed from the left token's state. So a string has exactly
one accepting path, its BPE encoding, and so has each of its beginnings.

The gadgets are compiled into flat arrays: for every token its rule and the two tokens whose arcs it took over, one hash
table of removed arcs, and the labels as a transition table of symbols. A string is read symbol by symbol, many strings
at once: of the labels that end at a symbol exactly one has an arc from the state in which its label began. Nothing is
searched or taken back. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from larder.llm.common import Generations, give_back, own_worker, parts_of, prepare

#: Bytes that each of the two generations of a worker's cache of words may hold.
CACHE_BYTES = 24 << 20
#: Arcs whose presence a worker keeps resolved, each in a place of its own by hash.
RESOLVED = 1 << 19
#: Symbols of the longest word that is read together with others, and symbols of all words read at once.
TOGETHER, SYMBOLS = 48, 1 << 18
#: Unicode White_Space, as ranges of code points (fixed values).
SPACES = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
SPACE = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in SPACES)
#: The pre-split pattern of the vocabulary's published tokenizer (fixed value).
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
TWO_SPACES = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in SPACES) + "]{2}"  # as Arrow writes it
#: Marks that form a word of their own after letters; not the apostrophe, which may begin a contraction.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Below it, what Python calls a letter is one in every Unicode version.
LATIN_END = "\u0250"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Added to a symbol that ends a word, in vocabularies that mark words' ends.
WORD_END = 256


def byte_letters() -> dict[str, int]:
    """The printable letter of every byte in byte-level vocabularies: printable Latin-1 stands for itself, others follow 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Lookup:
    """Non-negative integer keys with int32 values in open-addressed arrays, built and read many at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at, left = self._first(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]  # of several keys for one place the last stays
            mine = self.keys[at[left]] == keys[left]
            self.values[at[left[mine]]] = values[left[mine]]
            left = left[~mine]
            at[left] = (at[left] + 1) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for keys that are not there."""
        at = self._first(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


class BpeAutomaton:
    """Tokens are strings of symbols (code points below 65,536); ``vocab`` has their ids, ``merges`` the rules in order, and
    ``ids`` the number of all ids, where there are others."""

    def __init__(self, merges: list[tuple[str, str]], vocab: dict[str, int], ids: int = 0):
        n = max(ids, max(vocab.values(), default=0) + 1)
        self.kind = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self._born, self._left, self._right = [0] * n, [0] * n, [0] * n
        self._removed: dict[tuple[int, int], int] = {}
        self._last = 0
        taken = dict(vocab)
        for number, (u, v) in enumerate(merges, 1):
            if u in taken and v in taken and self._arc(vocab[u], vocab[v]):
                self._add_gadget(number, vocab[u], vocab[v], vocab[u + v])
            else:  # no path takes these two arcs in a row, so no path gets the new one
                taken.pop(u + v, None)
        nodes: dict[str, int] = {"": 0}  # every beginning of a label
        for label in taken:
            for size in range(1, len(label) + 1):
                nodes.setdefault(label[:size], len(nodes))
        self._steps = {nodes[p[:-1]] << 16 | ord(p[-1]): i for p, i in nodes.items() if p}
        self._token = [taken.get(p, -1) for p in nodes]
        self.steps = Lookup(np.fromiter(self._steps.keys(), np.int64, len(self._steps)), np.fromiter(self._steps.values(), np.int32, len(self._steps)))
        self.token = np.array(self._token, np.int32)
        self.born, self.left, self.right = (np.array(x, np.int32) for x in (self._born, self._left, self._right))
        gone = np.array([(u << 32 | v, r) for (u, v), r in self._removed.items()], np.int64).reshape(-1, 2)
        self.removed = Lookup(gone[:, 0], gone[:, 1].astype(np.int32))
        self._known, self._kept = np.full(RESOLVED, -1, np.int64), np.zeros(RESOLVED, bool)

    def _add_gadget(self, number: int, u: int, v: int, w: int) -> None:
        self._born[w], self._left[w], self._right[w] = number, u, v
        self._removed[u, v] = self._last = number

    def _arc(self, state: int, token: int) -> bool:
        """Whether the state keeps the arc, by going back through the gadgets that made state and token."""
        born, before = self._born, self._last + 1
        while True:
            if self._removed.get((state, token), before) < before:
                return False
            s, t = born[state], born[token]
            if not s and not t:
                return True
            if s >= t:  # the state was copied before its rule removed an arc
                before = s
                if s == t:
                    token = self._left[token]
                state = self._right[state]
            else:  # arcs into the token were copied after it
                before = t + 1
                token = self._left[token]

    def _arcs(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``_arc`` for many pairs at once."""
        out = np.ones(len(state), bool)
        at, before = np.arange(len(state)), np.full(len(state), self._last + 1, np.int32)
        while len(at):
            gone = self.removed.get(state.astype(np.int64) << 32 | token)
            lost = (gone >= 0) & (gone < before)
            out[at[lost]] = False
            s, t = self.born[state], self.born[token]
            go = ~lost & ((s > 0) | (t > 0))
            at, state, token, s, t = at[go], state[go], token[go], s[go], t[go]
            back = s >= t
            before = np.where(back, s, t + 1)
            state, token = np.where(back, self.right[state], state), np.where(s <= t, self.left[token], token)
        return out

    def _allowed(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``_arcs``, by way of the arcs that are kept resolved."""
        key = state.astype(np.int64) << 32 | token
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - RESOLVED.bit_length() + 1)).astype(np.int64)
        out = self._kept[at]
        new = np.flatnonzero(self._known[at] != key)
        if len(new):
            out[new] = self._arcs(state[new], token[new])
            self._kept[at[new]] = out[new]
            self._known[at[new]] = key[new]
            # Two arcs of one place may have come at once: the place is valid only if both were written by the same one.
            mixed = new[self._known[at[new]] != key[new]]
            self._known[at[mixed]] = -1
        return out

    def _read(self, symbols: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """The accepting paths of words given as columns of symbols, longest word first."""
        longest, n = symbols.shape
        last, came = np.full((longest + 1, n), -1, np.int32), np.zeros((longest + 1, n), np.int32)
        word = begun = node = np.zeros(0, np.int32)
        for i in range(1, longest + 1):
            m = int(np.searchsorted(-size, -i, side="right"))  # words that have an i-th symbol
            if len(word) and m < n:
                on = word < m
                word, begun, node = word[on], begun[on], node[on]
            word, begun, node = (np.concatenate(p) for p in ((word, np.arange(m, dtype=np.int32)), (begun, np.full(m, i - 1, np.int32)), (node, np.zeros(m, np.int32))))
            node = self.steps.get(node.astype(np.int64) << 16 | symbols[i - 1][word])
            on = node >= 0
            word, begun, node = word[on], begun[on], node[on]
            token = self.token[node]
            ends = np.flatnonzero(token >= 0)
            w, b, t = word[ends], begun[ends], token[ends]
            state = last[b, w]
            ok = b == 0
            inner = np.flatnonzero(state >= 0)
            ok[inner] = self._allowed(state[inner], t[inner])
            last[i, w[ok]], came[i, w[ok]] = t[ok], b[ok]
        on, at = np.arange(n), size.astype(np.int64)
        count, rounds = np.zeros(n, np.int64), []
        while len(on):
            t = last[at, on]
            if (t < 0).any():
                raise ValueError("a symbol is missing from the vocabulary")
            rounds.append((on, t))
            count[on] += 1
            at = came[at, on]
            on, at = on[at > 0], at[at > 0]
        end = np.cumsum(count)
        flat = np.empty(int(end[-1]) if n else 0, self.kind)
        for r, (w, t) in enumerate(rounds):
            flat[end[w] - 1 - r] = t
        return [flat, end]

    def _read_long(self, symbols: np.ndarray) -> bytes:
        """The same for one long word."""
        last, came = [-1], [0]
        begun: list[tuple[int, int]] = []
        for i, symbol in enumerate(symbols.tolist(), 1):
            begun.append((i - 1, 0))
            on, state = [], -1
            for b, node in begun:
                to = self._steps.get(node << 16 | symbol)
                if to is None:
                    continue
                on.append((b, to))
                t = self._token[to]
                if t >= 0 and state < 0 and (b == 0 or last[b] >= 0 and self._arc(last[b], t)):
                    state, source = t, b
            if state < 0:
                raise ValueError("a symbol is missing from the vocabulary")
            last.append(state)
            came.append(source)
            begun = on
        out, at = [], len(symbols)
        while at:
            out.append(last[at])
            at = came[at]
        return np.array(out[::-1], self.kind).tobytes()

    def paths(self, words: list[bytes], ended: bool = False) -> list[bytes]:
        """Each word's tokens, packed as ``kind``; ``ended`` adds ``WORD_END`` to the last symbol of every word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        out: list[bytes] = [b""] * len(words)

        def symbols_of(picked: np.ndarray) -> np.ndarray:
            flat = np.frombuffer(b"".join([words[i] for i in picked]), np.uint8).astype(np.int64)
            if ended:
                flat[np.cumsum(size[picked]) - 1] += WORD_END
            return flat

        k, width = int((size > TOGETHER).sum()), self.kind.itemsize
        for i in order[:k].tolist():
            out[i] = self._read_long(symbols_of(np.array([i])))
        order = order[: int((size > 0).sum())]  # an empty word has no tokens
        while k < len(order):
            picked = order[k : k + max(1, SYMBOLS // int(size[order[k]]))]
            k += len(picked)
            sizes = size[picked]
            grid = np.zeros((int(sizes[0]), len(picked)), np.int64)
            grid.T[np.arange(sizes[0]) < sizes[:, None]] = symbols_of(picked)
            flat, end = self._read(grid, sizes)
            packed, at = flat.tobytes(), (end * width).tolist()
            for i, a, b in zip(picked.tolist(), [0, *at], at):
                out[i] = packed[a:b]
        return out


def read_file(path: str) -> tuple[BpeAutomaton, dict[str, int], list[bytes]]:
    """The automaton of a byte-level tokenizers file, its added tokens' ids, and every id's label as bytes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, suffix = byte_letters(), spec["model"].get("end_of_word_suffix") or ""
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}

    def raw(token: str) -> str:
        if suffix and token.endswith(suffix):
            body = [letters[c] for c in token[: -len(suffix)]]
            return "".join(map(chr, body[:-1])) + chr(body[-1] + WORD_END)
        return "".join(chr(letters[c]) for c in token)

    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    labels = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for label, i in vocab.items():
        labels[i] = bytes(ord(c) % WORD_END for c in label)
    for text, i in special.items():
        labels[i] = text.encode()
    return BpeAutomaton([(raw(a), raw(b)) for a, b in pairs], vocab, len(labels)), special, labels


class Bpe:
    """Encoding and decoding as the file's published tokenizer does: special tokens, pre-split, automaton."""

    def __init__(self, path: str):
        self.automaton, self.special, self.labels = read_file(path)
        self.kind = self.automaton.kind
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = Generations(CACHE_BYTES)

    def _ids_of(self, strings: list[str]) -> list[bytes]:
        """The ids of strings that begin and end where words do; each distinct one is read once while it stays cached."""
        have = self.words
        have.make_room()
        new = have.missing(set(strings))
        words: set[str] = set()
        split: list[tuple[str, list[str]]] = []
        for s in new:
            word = s.rstrip(MARKS)
            letters = word[1:] if word[:1] == " " else word
            if letters.isalpha() and (letters.isascii() or max(letters) < LATIN_END):  # letters, and then marks, are one word each
                if len(word) == len(s):
                    words.add(s)
                else:
                    split.append((s, [word, s[len(word) :]]))
            elif len(parts := SPLIT.findall(s)) == 1:
                words.add(s)
            else:
                split.append((s, parts))
        words |= have.missing({p for _, parts in split for p in parts})
        todo = list(words)
        have.add(todo, self.automaton.paths([w.encode() for w in todo]))
        look = have.__getitem__
        have.add([s for s, _ in split], [b"".join(map(look, p)) for _, p in split])
        return list(map(look, strings))

    def _odd(self, text: str) -> bytes:
        """The ids of a text in which special tokens or two spaces in a row occur."""
        parts = self.special_split.split(text) if self.special_split else [text]
        return b"".join(np.array([self.special[p]], self.kind).tobytes() if p in self.special else b"".join(self._ids_of(SPLIT.findall(p))) for p in parts)

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, packed as ``kind``."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, TWO_SPACES)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        plain = texts.filter(pc.invert(odd))
        odd = odd.to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        if len(plain):  # With no two spaces in a row, a single space always begins a word: what lies between spaces splits on its own.
            lists = pc.split_pattern(plain, " ")
            coded = lists.flatten().dictionary_encode()
            begin, index = lists.offsets.to_numpy().tolist(), coded.indices.to_numpy().tolist()
            chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            heads = [chunks[index[i]] for i in begin[:-1]]  # no space stands before these
            ids = self._ids_of([" " + c for c in chunks] + heads)
            look = ids.__getitem__
            for i, head, a, b in zip(np.flatnonzero(~odd).tolist(), ids[len(chunks) :], begin, begin[1:]):
                out[i] = head + b"".join(map(look, index[a + 1 : b]))
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._odd(texts[i].as_py())
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_all(pa.array([text], pa.string()))[0], self.kind)

    def decode(self, ids) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


_MODELS: dict[str, Bpe] = {}


def model(path: str) -> Bpe:
    """One per Python worker and file."""
    if path not in _MODELS:
        _MODELS[path] = Bpe(path)
    return _MODELS[path]


def forget() -> None:
    """Let go of this worker's caches. A function of the module, so that tasks reach the worker's own and carry none."""
    _MODELS.clear()


def _round_trip(path: str):
    def run(batches):
        own_worker("bpe", forget)
        bpe = model(path)
        for whole in batches:
            for batch in parts_of(whole):
                n, ids_hash, text_hash = [], [], []
                for packed in bpe.encode_all(batch.column("text").cast(pa.string())):
                    ids = np.frombuffer(packed, bpe.kind)
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    text_hash.append(hashlib.sha256(bpe.decode(ids.tolist()).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    return run


def bpe_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 of its whole text.

    A null text counts as empty and has no tokens. Strings of special tokens inside a text become their ids. Repeated
    rows are encoded each; an empty table gives an empty result. Only doc_id and text are read.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_round_trip(tokenizer_path), SCHEMA)
