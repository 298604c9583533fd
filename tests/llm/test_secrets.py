import hashlib
import logging
import os
import random
import re
import string
import sys

import pytest

from larder.llm.secrets import ENCODINGS, FALSE_DISCOVERY_RATE, KEY_LEVEL, UUID, discoveries, find_secrets, infer_encoding, join_spans, mask, mask_secrets, ordinary_p, randomness_p, scan_secrets
from tests.llm.helpers import DOCS, awkward, documents

GROUP2 = set(string.ascii_letters + string.digits + "+/_.=-")


def runs_of(text, letters, least, start=""):
    out, i = [], 0
    while i < len(text):
        j = i + len(start)
        if text.startswith(start, i) and (start or text[i] in letters):
            while j < len(text) and text[j] in letters:
                j += 1
            if j > i + len(start):
                if j - i >= least:
                    out.append((i, j))
                i = j
                continue
        i += 1
    return out


def brute_base(text):
    """The base patterns by hand, character by character."""
    found = [(s, e, "hex") for s, e in runs_of(text, set("0123456789abcdef"), 24)]
    found += [(s, e, "access") for s, e in runs_of(text, set(string.ascii_uppercase + string.digits), 20, "AKIA")]
    i, words = 0, ("password", "passwd", "secret", "token", "api_key", "apikey")
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    while i < len(text):
        j = next((i + len(w) for w in words if low.startswith(w, i)), None)
        if j is not None:
            j += text[j : j + 1] in ('"', "'") and text[j : j + 1] != ""
            while text[j : j + 1] == " ":
                j += 1
            if text[j : j + 1] and text[j] in ":=":
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                j += text[j : j + 1] != "" and text[j] in "\"'"
                k = j
                while k < len(text) and text[k] in GROUP2:
                    k += 1
                if k > j:
                    if k - j >= 6:
                        found.append((i, k, "assign"))
                    i = k
                    continue
        i += 1
    return sorted(found, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


CASES = ["", "token=abcdef", "token=abcde", 'API_KEY"  :  "x.y=z-/+_1', "secret=token:abcdefghij", "passſword=123456789", "to\u212aen=abcdefgh", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "AKIAAKIA" + "Z" * 20,
         "f" * 23, "f" * 24, "xf" * 3 + "0" * 40 + "g", "é😀 password= '" + "a1" * 12 + "'", "password='", "token==abcdef", "secret \n=abcdefg", "AKIA" + "0" * 30 + "abcdef0123456789abcdef0123456789"]


@pytest.mark.parametrize("text", CASES)
def test_base_spans(text):
    assert [s for s in find_secrets(text) if s[2] != "random"] == brute_base(text)


def test_random_soup_against_the_hand_written_scan():
    rng = random.Random(9)
    pieces = ["password", "PassWd", "secret", "token", "apikey", "Api_Key", '"', "'", " ", ":", "=", "AKIA", "abc", "0123456789", "deadbeef" * 2, "ABCDEFGH", ".", "é", "\n", "x"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 14)))
        assert [s for s in find_secrets(text) if s[2] != "random"] == brute_base(text), text


def test_documents_and_digests(spark):
    rows = {r.doc_id: r.text for r in documents(spark).collect()}
    for r in scan_secrets(documents(spark)).collect():
        base = brute_base(rows[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in base) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(join_spans(base).encode()).hexdigest()
        assert set(filter(None, join_spans(base).split(","))) <= set(r.spans.split(","))


@pytest.mark.parametrize("length", [20, 24, 32, 48])
def test_random_keys_are_found(length):
    rng = random.Random(length)
    for alphabet in ENCODINGS.values():
        keys = ["".join(rng.choices(alphabet, k=length)) for _ in range(150)]
        keys = [k for k in keys if infer_encoding(k)]
        assert sum(bool(find_secrets(f"see {k} there")) for k in keys) >= 0.9 * len(keys)


def test_ordinary_strings_are_discovered_at_the_stated_rate_at_most():
    """Words of another source than the reference's syllables: the names of the standard library."""
    rng = random.Random(3)
    words = sorted({w for n in sys.stdlib_module_names for w in re.findall("[a-z]{3,}", n.lower())} | {w.lower() for m in (os, string, logging, pytest) for n in dir(m) for w in re.findall("[A-Z]?[a-z]{2,}", n)})
    join = {"camel": "", "title": "", "snake": "_", "kebab": "-", "path": "/", "UPPER": "_"}
    for low, high in ((20, 25), (26, 35), (36, 60)):
        found = tested = 0
        for _ in range(600):
            style, length, out = rng.choice(list(join)), rng.randint(low, high), ""
            while len(out) < length:
                w = rng.choice(words)
                w = w.upper() if style == "UPPER" else w.title() if style == "title" or style == "camel" and out else w
                out += (join[style] if out else "") + w + (str(rng.randint(0, 9999)) if rng.random() < 0.2 else "")
            out = out[: length - 2] + str(rng.randint(10, 99))
            if infer_encoding(out):
                tested += 1
                found += bool(find_secrets(out))
        assert tested > 400 and found <= (FALSE_DISCOVERY_RATE + 0.02) * tested  # two standard errors
    for text in ("ThisIsAVeryLongIdentifierName42", "usr/local/lib/python3/site/packages", "release-candidate-build-2024-02-29", "550e8400-e29b-41d4-a716-446655440000",
                 "z" * 20 + "1" * 20, "supercalifragilisticexpialidocious1", "abcdefghijklmnopqrstuvwxyz0123456789", "x" * 50 + "7", "Donaudampfschifffahrtsgesellschaft", "0y1" * 30):
        assert find_secrets(text) == [], text


def test_random_spans_against_a_plain_rule():
    rng, found = random.Random(12), 0
    pieces = ["getUserAccountByName2", "max-retry-count-of-3-times", "secret=abc123", "deadbeef" * 4, " ", "plain words", "AKIA" + "Z7" * 9, "é", "550e8400-e29b-41d4-a716-446655440000"]
    for _ in range(400):
        parts = rng.choices(pieces, k=rng.randint(0, 5)) + ["".join(rng.choices(rng.choice(list(ENCODINGS.values())), k=rng.randint(18, 44))) for _ in range(rng.randint(0, 3))]
        rng.shuffle(parts)
        text = rng.choice(["", " "]).join(parts)
        base, runs, i = brute_base(text), [], 0
        while i < len(text):
            j = i
            while j < len(text) and (text[j] in GROUP2 - {".", "="}):
                j += 1
            k = j
            while j - i >= 20 and k < len(text) and k < j + 2 and text[k] == "=":
                k += 1
            if j - i >= 20:
                runs.append((i, k))
            i = max(k, i + 1)
        tested = []
        for s, e in runs:
            body = text[s:e].rstrip("=")
            kind = infer_encoding(body)
            if kind and len(body) >= 20 and not UUID.fullmatch(body) and not any(x <= s and e <= y for x, y, _ in base):
                tested.append((s, e, ordinary_p(body, kind) if randomness_p(body, ENCODINGS[kind]) >= KEY_LEVEL else 1.0))
        mean = sum(e - s for s, e, _ in tested) / max(1, len(tested))
        weighted = sorted(p * mean / (e - s) for s, e, p in tested)
        passed = [q for r, q in enumerate(weighted, 1) if q <= FALSE_DISCOVERY_RATE * r / len(weighted)]
        want = [(s, e) for s, e, p in tested if passed and p * mean / (e - s) <= max(passed)]
        assert [(s, e) for s, e, k in find_secrets(text) if k == "random"] == want, text
        found += len(want)
    assert found > 200


def test_what_goes_on_beside_a_base_span_is_tested():
    run = "Qz7Rk2XwVb9" + "9c4e1a7b03d85f62e1b49a7c" + "Jd8KqTzXv4W"
    assert [(s, e) for s, e, k in find_secrets(run) if k == "random"] == [(0, len(run))] and mask(f"a {run} b") == "a [SECRET] b"


def test_battery_is_uniform_under_its_null():
    rng = random.Random(8)
    p = [randomness_p("".join(rng.choices(string.hexdigits[:16], k=64)), string.hexdigits[:16]) for _ in range(600)]
    assert 0.01 < sum(x < 0.05 for x in p) / len(p) < 0.08


def test_false_discovery_control_weighs_length():
    assert discoveries([0.001, 0.2, 0.9], [30, 30, 30]) == [True, False, False]
    assert discoveries([0.02, 0.9], [100, 10]) == [True, False] and discoveries([0.02, 0.9], [10, 100]) == [False, False]
    assert discoveries([], []) == []
    assert infer_encoding("abc") is None and infer_encoding("123") is None and infer_encoding("12ab") == "hex"


def test_mask(spark):
    assert mask(None) is None and mask("plain") == "plain"
    assert mask('a token = "97ffa88d7c5f5655e365004e29bd123cdabd722a" b') == 'a [SECRET]" b'
    rows = awkward(spark)
    got = mask_secrets(rows)
    assert got.columns == rows.columns and sorted(map(str, got.select("doc_id", "text").collect())) == sorted(map(str, rows.select("doc_id", "text").collect()))


def test_awkward_and_empty(spark):
    assert {r.spans for r in scan_secrets(awkward(spark)).collect()} == {""}
    assert scan_secrets(spark.createDataFrame([], DOCS)).collect() == []
