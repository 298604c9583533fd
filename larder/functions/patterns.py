"""Which of many words a text holds, found in one pass over the text however many the words are.

An Aho-Corasick automaton in flat arrays, which all texts of an Arrow batch walk at once, one code point at a time.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F

from larder.runtime import ship

#: Words beyond which the automaton takes the place of one expression for each word.
MOST_EXPRESSIONS = 64

#: Texts are walked in slices of about this many code points.
SLICE = 1 << 18

_BITS = 21  # a code point


class Automaton:
    """``links``: state and code point in one number, sorted; ``to``: where each leads; ``fail``: the state of the longest
    proper ending; ``word``: the longest word that ends in a state, -1 for none; ``inside``: words that a word holds beside
    itself."""

    def __init__(self, words: Iterable[str]):
        self.words = list(dict.fromkeys(words))
        children: list[dict[str, int]] = [{}]
        word = [-1]
        for i, w in enumerate(self.words):
            at = 0
            for c in w:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    word.append(-1)
                at = children[at][c]
            if w:
                word[at] = i
        fail, queue = [0] * len(children), deque([0])
        while queue:
            at = queue.popleft()
            for c, child in children[at].items():
                back = fail[at]
                while back and c not in children[back]:
                    back = fail[back]
                fail[child] = children[back].get(c, 0) if at else 0
                if word[child] < 0:
                    word[child] = word[fail[child]]
                queue.append(child)
        links = sorted((at << _BITS | ord(c), child) for at, some in enumerate(children) for c, child in some.items())
        self.links = np.array([a for a, _ in links] or [-1], dtype=np.int64)
        self.to = np.array([b for _, b in links] or [0], dtype=np.int64)
        self.fail, self.word = np.array(fail, dtype=np.int64), np.array(word, dtype=np.int64)
        self.inside: list[set[int]] = [set() for _ in self.words]
        rows, held = self._walk(self.words)
        for r, h in zip(rows.tolist(), held.tolist()):
            self.inside[r].add(h)
        # A word's shorter endings show only behind the longest one: without its first code point it shows them itself.
        rows, held = self._walk([w[1:] for w in self.words])
        for r, h in zip(rows.tolist(), held.tolist()):
            self.inside[r].add(h)
        for i in sorted(range(len(self.words)), key=lambda i: len(self.words[i])):
            self.inside[i].discard(i)
            self.inside[i] = self.inside[i].union(*(self.inside[j] for j in self.inside[i]))

    def _step(self, state: np.ndarray, points: np.ndarray) -> np.ndarray:
        out, left = np.zeros_like(state), np.arange(len(state))
        while len(left):
            key = state[left] << _BITS | points[left]
            at = np.minimum(np.searchsorted(self.links, key), len(self.links) - 1)
            hit = self.links[at] == key
            out[left[hit]] = self.to[at[hit]]
            left = left[~hit & (state[left] > 0)]
            state = state.copy()
            state[left] = self.fail[state[left]]
        return out

    def _walk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, word) of the longest word that ends at each place, each pair once."""
        pairs = [np.zeros((0, 2), np.int64)]
        size = np.array([len(t) for t in texts], dtype=np.int64)
        start = np.cumsum(size) - size
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        order = np.argsort(-size, kind="stable")
        state = np.zeros(len(texts), np.int64)
        alive = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), side="left")  # texts longer than each place
        for place, n in enumerate(alive.tolist()):
            state = self._step(state[:n], points[start[order[:n]] + place])
            found = self.word[state]
            some = np.flatnonzero(found >= 0)
            if len(some):
                pairs.append(np.stack([order[some], found[some]], 1))
            if len(pairs) > 4096:
                pairs = [np.unique(np.concatenate(pairs), axis=0)]
        both = np.unique(np.concatenate(pairs), axis=0)
        return both[:, 0], both[:, 1]

    def held(self, texts: list[str], outer: bool) -> list[list[int]]:
        """For each text the numbers of the words it holds; with ``outer`` less those inside another word that it holds.
        The empty word is held by every text, inside any other."""
        out: list[list[int]] = []
        empty = {self.words.index("")} if "" in self.words else set()
        cut, weight = [0], 0
        for i, t in enumerate(texts):
            weight += len(t)
            if weight >= SLICE:
                cut.append(i + 1)
                weight = 0
        for a, b in zip(cut, [*cut[1:], len(texts)]):
            tops: list[set[int]] = [set() for _ in range(b - a)]
            for r, h in zip(*(x.tolist() for x in self._walk(texts[a:b]))):
                tops[r].add(h)
            for top in tops:
                under = set().union(*(self.inside[h] for h in top))
                mine = (top - under) if outer else (top | under | empty)
                out.append(sorted(mine or empty))
        return out


def _values(text: Column, words: list[str], outer: bool, labels: list[list[str]]) -> Column:
    ship(SparkSession.active())
    automaton = Automaton(words)
    named = dict.fromkeys(automaton.words)
    for w, some in zip(words, labels):
        named[w] = [*(named[w] or []), *some]
    values = list(named.values())

    @F.pandas_udf("array<string>")
    def find(texts: pd.Series) -> pd.Series:
        distinct = texts.dropna().unique().tolist()
        found = {t: [v for i in hits for v in values[i]] for t, hits in zip(distinct, automaton.held(distinct, outer))}
        return pd.Series([None if t is None else found[t] for t in texts], dtype=object)

    return find(text)


def words_in(text: Column, words: list[str]) -> Column:
    """The words that the text holds, in the order given, each once; null for a null text. Case counts."""
    words = list(dict.fromkeys(words))
    if len(words) <= MOST_EXPRESSIONS:
        held = F.filter(F.array(*[F.lit(w) for w in words]).cast("array<string>"), lambda w: F.contains(text, w))
        return F.when(text.isNotNull(), held)
    return _values(text, words, False, [[w] for w in words])


def outer_labels(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """The labels of the words that the text holds, less the words inside another one that it holds too. Case counts."""
    if len(pairs) > MOST_EXPRESSIONS:
        return _values(text, [w for w, _ in pairs], True, [[label] for _, label in pairs])
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in pairs])
    hits = F.filter(table, lambda e: F.contains(text, e["k"]))
    free = F.filter(hits, lambda h: ~F.exists(hits, lambda o: (o["k"] != h["k"]) & F.contains(o["k"], h["k"])))
    return F.transform(free, lambda h: h["t"])
