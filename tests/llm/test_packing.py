import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from larder.llm.packing import ChunkEncoder, pack
from larder.llm.queries import PACK_TOKENIZER, tokenizer_path
from tests.llm.helpers import DOCS, awkward, documents

PATH = tokenizer_path(PACK_TOKENIZER)


def check(docs, window):
    tokenizer = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1])
    pieces = pack(docs, PATH, window).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    total = sum(len(x) for v in want.values() for x in v)
    assert sorted(by_sequence) == list(range(-(-total // window)))
    for s, spans in by_sequence.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at == (window if s < total // window else total % window)
    assert set(by_doc) == set(want)
    for i, texts in want.items():
        crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
        left = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in by_doc[i])
        possible = {(p[0], p[1], crc(x[p[0] : p[0] + p[1]]), len(x)) for p in left for x in texts if p[0] + p[1] <= len(x)}
        assert set(left) <= possible
        assert sum(p[1] for p in left) == sum(map(len, texts))


def test_documents(spark):
    check(documents(spark).repartition(5), 2048)


def test_awkward_rows_and_small_windows(spark):
    for window in (7, 2048):
        check(awkward(spark).repartition(3), window)
    assert pack(spark.createDataFrame([], DOCS), PATH).collect() == []


def test_chunks_encode_as_the_library_does():
    tokenizer, mine, rng = Tokenizer.from_file(PATH), ChunkEncoder(PATH), random.Random(5)
    texts = ["", None, "It's  <|endoftext|>x<|startoftext|>", "ÀÉ\x85a\xa0b\x1cc\u2003d e\u0301", "12 3,4;;  ((", "İstanbul ſtraße ΑΣ", "日本語 テキスト", "x" * 3000]
    pieces = ["a", "th", " ", "  ", "\n", "'s", "1", "é", "É", "中", "😀", "\xa0", "\x1c", "<|", "ß", "ſ", "\u0301", "_", "==", "THE", "ª", "µ", "Å", ". ", ", "]
    texts += ["".join(rng.choices(pieces, k=rng.randint(0, 24))) for _ in range(3000)]
    for at in range(0, len(texts), 500):
        mine.cache.most = 20_000 if at else 200
        part = texts[at : at + 500]
        got = [np.frombuffer(g, mine.dtype).tolist() for g in mine.encode_all(pa.array(part))]
        assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]
