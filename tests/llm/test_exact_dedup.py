import hashlib
from collections import defaultdict

import numpy as np
import pytest

from larder.llm.exact_dedup import ENTRY, exact_dedup, key_of, merge
from tests.llm.helpers import DOCS, awkward, documents


def brute(rows, largest):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        left = True
        for i in ids:
            kept = left and i == keep
            left = left and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("parts", [1, 7])
def test_awkward_rows(spark, keep, parts):
    docs = awkward(spark).repartition(parts)
    got = sorted(map(tuple, exact_dedup(docs, keep).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], keep == "largest")


def test_runs_of_few_rows_meet_in_several_rounds(spark):
    docs = documents(spark).unionByName(documents(spark).selectExpr("doc_id + 100000 doc_id", "text", "lang", "source", "n_chars")).repartition(70)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], True)
    for rows in (1, 100_000):  # one run for each batch, or for each partition
        assert sorted(map(tuple, exact_dedup(docs, run_rows=rows).collect()), key=str) == want


def test_a_merge_keeps_order_sums_and_the_best_row():
    def run(number, rows):
        rows = sorted((key_of(t), i, n) for t, i, n in rows)
        entries = np.zeros(len(rows), ENTRY)
        for e, (_, i, n) in zip(entries, rows):
            e["keep"], e["named"], e["run"], e["n"] = i or 0, i is not None, number, n
        return b"".join(k for k, _, _ in rows), entries.tobytes()

    runs = [run(0, [(b"a", 5, 2), (b"b", None, 1), (b"c", 1, 1)]), run(1, [(b"a", 9, 1), (b"b", -4, 1)]), run(2, [(b"a", 9, 1), (b"d", None, 3)])]
    for largest, a in ((True, (9, 1, 4)), (False, (5, 0, 4))):
        keys, entries = merge(runs, largest)
        got = {bytes(k): (int(e["keep"]) if e["named"] else None, int(e["run"]), int(e["n"])) for k, e in zip(keys, entries)}
        assert [bytes(k) for k in keys] == sorted(got)
        assert got == {key_of(b"a"): a, key_of(b"b"): (-4, 1, 2), key_of(b"c"): (1, 0, 1), key_of(b"d"): (None, 2, 3)}


def test_empty_and_bad_parameter(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup(empty).collect() == []
    with pytest.raises(ValueError):
        exact_dedup(empty, keep="first")
