import hashlib
import random

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from larder.llm.bpe import TOGETHER, Bpe, BpeAutomaton, bpe_digests
from larder.llm.queries import BPE_TOKENIZER, tokenizer_path
from tests.llm.helpers import DOCS, awkward, documents

PATH = tokenizer_path(BPE_TOKENIZER)


def check(docs):
    library = Tokenizer.from_file(PATH)
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, bpe_digests(docs, PATH).collect()), key=str) == sorted(want, key=str)


def test_documents(spark):
    check(documents(spark))


def test_awkward_and_empty(spark):
    check(awkward(spark))
    assert bpe_digests(spark.createDataFrame([], DOCS), PATH).collect() == []


def test_random_strings_against_the_library():
    library, mine, rng = Tokenizer.from_file(PATH), Bpe(PATH), random.Random(5)
    pieces = ["a", "b", "e", "th", " ", "  ", "\n", "\t", "'s", "'ll", "1", "23", "é", "中", "😀", "\xa0", "\x1c", "\x85", "<|endoftext|>", "ß", "ſ", "\u0301", "\u2003", "_", "==", "THE", " the", "aaaa"]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 24)))
        ids = mine.encode(text).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert mine.decode(ids) == text


def test_many_texts_at_once_with_a_small_cache():
    library, mine, rng = Tokenizer.from_file(PATH), Bpe(PATH), random.Random(6)
    mine.words.most = 2000
    letters = "aeinorst é,.'-12 \n"
    for _ in range(30):
        texts = ["".join(rng.choices(letters, k=rng.randint(0, 200))) for _ in range(20)] + [None, "x" * 500, "日本語" * 40]
        got = [np.frombuffer(g, mine.kind).tolist() for g in mine.encode_all(pa.array(texts))]
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def plain_bpe(word, merges):
    rank = {m: i for i, m in enumerate(merges)}
    parts = list(word)
    while True:
        best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
        if best is None:
            return parts
        pair = merges[best[0]]
        out, i = [], 0
        while i < len(parts):
            if tuple(parts[i : i + 2]) == pair:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


def test_random_merge_tables_against_plain_merging():
    rng = random.Random(11)
    for _ in range(150):
        tokens = list("abc")
        merges = []
        for _ in range(rng.randint(1, 14)):
            pair = (rng.choice(tokens), rng.choice(tokens))
            if pair[0] + pair[1] not in tokens:
                merges.append(pair)
                tokens.append(pair[0] + pair[1])
        bpe = BpeAutomaton(merges, {t: i for i, t in enumerate(tokens)})
        words = ["".join(rng.choices("abc", k=rng.randint(1, 18))) for _ in range(40)] + ["".join(rng.choices("abc", k=TOGETHER + 20))]
        got = [[tokens[i] for i in np.frombuffer(p, bpe.kind)] for p in bpe.paths([w.encode() for w in words])]
        assert got == [plain_bpe(w, merges) for w in words], merges
