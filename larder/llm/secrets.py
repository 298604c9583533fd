"""Secret scans: fixed patterns, then a battery of randomness tests on other credential-like strings.

A candidate is a maximal run of encoding letters; its encoding is inferred. The battery measures uniformity over the
alphabet (chi-squared), runs and lag-one serial correlation, in two forms. The first tests the string as a random key; what
fails it at ``KEY_LEVEL`` is none. The second asks what sets keys apart from ordinary identifiers: the share of letters that
are common in words, changes between kinds of characters, and the succession of vowels. Its three scores are compared with
those of ordinary strings of the same encoding and length, written by rule, which gives a p-value of "this is an ordinary
string". A document's candidates are then decided together by the Benjamini-Hochberg rule, each with a share of the error
in proportion to its length; what it discovers are secrets, so that the rate bounds the ordinary strings among them.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larder.llm.common import own_worker, parts_of, prepare

KINDS = ("assign", "access", "hex", "random")
# The base patterns and least lengths (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
HINTS = ("passw", "secret", "token", "api")
#: Every hex or access match of its least length lies inside such a run.
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets in the order they are tried.
ENCODINGS = {
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "base32": UPPER + "234567",
    "upper36": DIGITS + UPPER,
    "lower36": DIGITS + LOWER,
    "base62": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
LEAST_RANDOM = 20
#: Largest expected share of ordinary strings among a document's discoveries.
FALSE_DISCOVERY_RATE = 0.05
#: Share of random keys that the first form of the battery loses.
KEY_LEVEL = 1e-4
#: Identifiers by shape, which are random but no secrets.
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
COMMON, VOWELS = frozenset("etaoinsrlETAOINSRL"), frozenset("aeiouyAEIOUY")
#: Lengths for which ordinary strings are written; a longer string is compared with those of the next shorter one.
LENGTHS = (20, 22, 24, 26, 28, 32, 36, 40, 48, 64, 96, 128)
ORDINARY = 1500


def infer_encoding(text: str) -> str | None:
    """The first encoding whose alphabet holds the text; None without a digit and a letter, as in words and numbers."""
    have = set(text.rstrip("="))
    if not have & set(DIGITS) or not have - set(DIGITS) - set("+/-_"):
        return None
    return next((n for n, a in ENCODINGS.items() if have <= set(a)), None)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness_p(text: str, alphabet: str) -> float:
    """The p-value of the battery under a uniform independent source over the alphabet."""
    place = {c: i for i, c in enumerate(alphabet)}
    x = [place[c] for c in text]
    n, k = len(x), len(alphabet)
    if n < 3:
        return 1.0
    counts = [0] * k
    for v in x:
        counts[v] += 1
    chi2 = k / n * sum(c * c for c in counts) - n
    mean, sd = k - 1, math.sqrt(2 * (k - 1) * (n - 1) / n)  # exact moments, also where few symbols are expected
    df = 2 * mean * mean / (sd * sd)  # chi-squared with these moments, by the cube-root normal form
    scaled = max(chi2, 0.0) * df / mean
    p_uniform = 0.5 * math.erfc(((scaled / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df)) / math.sqrt(2))
    high = [2 * v >= k for v in x]
    a = sum(high)
    b = n - a
    if a and b:
        runs = 1 + sum(p != q for p, q in zip(high, high[1:]))
        expect = 1 + 2 * a * b / n
        var = (expect - 1) * (expect - 2) / (n - 1)
        p_runs = _two_sided((runs - expect) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    m = sum(x) / n
    spread = sum((v - m) ** 2 for v in x)
    p_serial = _two_sided((sum((p - m) * (q - m) for p, q in zip(x, x[1:])) / spread + 1 / n) * math.sqrt(n)) if spread else 0.0
    return min(1.0, 3 * min(p_uniform, p_runs, p_serial))


def _kind(c: str) -> int:
    return 0 if c in DIGITS else 1 if "A" <= c <= "Z" else 2 if "a" <= c <= "z" else 3


@lru_cache(maxsize=None)
def _expected(encoding: str) -> tuple[float, float, float]:
    """Of a random key: share of common letters, of neighbours of two kinds, and of neighbours of which one is a vowel."""
    alphabet = ENCODINGS[encoding]
    k = len(alphabet)
    vowel = sum(c in VOWELS for c in alphabet) / k
    kinds = [sum(_kind(c) == x for c in alphabet) / k for x in range(4)]
    return sum(c in COMMON for c in alphabet) / k, 1 - sum(x * x for x in kinds), 2 * vowel * (1 - vowel)


def scores(text: str, encoding: str) -> tuple[float, float, float]:
    """Normal scores, as of a random key, of common letters, runs of one kind, and the succession of vowels."""
    common, change, turn = _expected(encoding)
    n = len(text)
    kinds, vowels = [_kind(c) for c in text], [c in VOWELS for c in text]

    def z(count: int, trials: int, share: float) -> float:
        return (count - trials * share) / math.sqrt(trials * share * (1 - share))

    return z(sum(c in COMMON for c in text), n, common), z(sum(a != b for a, b in zip(kinds, kinds[1:])), n - 1, change), z(sum(a != b for a, b in zip(vowels, vowels[1:])), n - 1, turn)


def ordinary(encoding: str, length: int, rng: random.Random) -> str:
    """A string that people write in an encoding's letters: words of one to three syllables and abbreviations without
    vowels, joined in one style, with numbers between or after them, cut to ``length``."""
    letters = set(ENCODINGS[encoding].lower())
    onsets = [x for x in ("b", "c", "d", "f", "g", "h", "l", "m", "n", "p", "r", "s", "t", "v", "w", "st", "tr", "pr", "ch", "sh", "cl", "") if set(x) <= letters]
    middles = [x for x in ("a", "e", "i", "o", "u", "ea", "io", "e", "a") if set(x) <= letters]
    codas = [x for x in ("n", "r", "s", "t", "l", "d", "m", "ng", "ck", "nt", "", "", "") if set(x) <= letters]
    mixed = encoding in ("base62", "base64", "base64url")
    style = rng.choice(("camel", "camel", "title", "lower", "upper") if mixed else ("upper",) if encoding in ("HEX", "base32", "upper36") else ("lower",))
    join = rng.choice(("/", "/", "+")) if encoding == "base64" else rng.choice("-_") if encoding == "base64url" else ""
    digits = [c for c in ENCODINGS[encoding] if c in DIGITS]
    consonants = sorted(letters & set(LOWER) - VOWELS) or sorted(letters & set(LOWER))
    share, short = rng.choice((0.0, 0.15, 0.3)), rng.choice((0.0, 0.1, 0.25))
    out = ""
    while len(out) < length:
        word = "".join(rng.choices(consonants, k=rng.randint(2, 4))) if rng.random() < short else "".join(rng.choice(onsets) + rng.choice(middles) + rng.choice(codas) for _ in range(rng.randint(1, 3)))
        word = word.upper() if style == "upper" else word.title() if style == "title" or style == "camel" and out else word
        if rng.random() < share:
            word += "".join(rng.choices(digits, k=rng.choice((1, 1, 2, 4))))
        out += (join if out else "") + word
    out = out[:length]
    if not set(out) & set(DIGITS):
        k = rng.choice((1, 1, 2, 4))
        out = out[: length - k] + "".join(rng.choices(digits, k=k))
    return out


@lru_cache(maxsize=None)
def _reference(encoding: str, length: int) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Of ordinary strings: the scores' mean, inverse covariance and its log-determinant, and the sorted evidence."""
    rng = random.Random(f"{encoding}{length}")
    z = np.array([scores(ordinary(encoding, length, rng), encoding) for _ in range(ORDINARY)])
    mean, cov = z.mean(axis=0), np.cov(z.T) + 0.05 * np.eye(3)
    inverse, logdet = np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])
    evidence = 0.5 * (np.einsum("ij,jk,ik->i", z - mean, inverse, z - mean) + logdet) - 0.5 * (z * z).sum(axis=1)
    return mean, inverse, logdet, np.sort(evidence)


def ordinary_p(text: str, encoding: str) -> float:
    """The p-value of "an ordinary string": how often such a string's scores speak as much for a random key as these.

    Evidence is the log-likelihood ratio of the three scores. Beyond the ordinary strings written, where none is as much
    like a key, the tail goes on as an exponential through their upper tenth.
    """
    at = max((n for n in LENGTHS if n <= len(text)), default=LENGTHS[0])
    mean, inverse, logdet, evidence = _reference(encoding, at)
    z = np.array(scores(text, encoding)) * math.sqrt(at / len(text))  # as much evidence as of the shorter string
    off = z - mean
    mine = 0.5 * (float(off @ inverse @ off) + logdet) - 0.5 * float(z @ z)
    above = int(len(evidence) - np.searchsorted(evidence, mine))
    tenth = len(evidence) // 10
    if above >= 10:
        return (above + 1) / (len(evidence) + 1)
    start = evidence[-tenth]
    scale = max(1e-9, float((evidence[-tenth:] - start).mean()))
    return max(1e-12, 0.1 * math.exp(-max(0.0, mine - start) / scale))


def discoveries(p_values: list[float], lengths: list[int], rate: float = FALSE_DISCOVERY_RATE) -> list[bool]:
    """Benjamini-Hochberg with weights in proportion to length (mean one): which candidates are found not to be ordinary."""
    total = sum(lengths) or 1
    q = sorted((p * total / (len(lengths) * n), i) for i, (p, n) in enumerate(zip(p_values, lengths)))
    cut = max((r for r, (v, _) in enumerate(q, 1) if v <= rate * r / len(q)), default=0)
    out = [False] * len(q)
    for _, i in q[:cut]:
        out[i] = True
    return out


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) in code points, end exclusive, by start and then kind."""
    spans: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        spans += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    runs = [(m.start(), m[0]) for m in RUN.finditer(text)]
    for at, run in runs:
        spans += [(at + m.start(), at + m.end(), "access") for m in ACCESS.finditer(run) if m.end() - m.start() >= LEAST_ACCESS]
        spans += [(at + m.start(), at + m.end(), "hex") for m in HEX.finditer(run) if m.end() - m.start() >= LEAST_HEX]
    base = list(spans)
    tested: list[tuple[int, int, float]] = []
    for at, run in runs:
        body, end = run.rstrip("="), at + len(run)
        encoding = infer_encoding(run) if len(body) >= LEAST_RANDOM and not UUID.fullmatch(body) else None
        if encoding and not any(s <= at and end <= e for s, e, _ in base):
            p = ordinary_p(body, encoding) if randomness_p(body, ENCODINGS[encoding]) >= KEY_LEVEL else 1.0
            tested.append((at, end, p))
    for (at, end, _), found in zip(tested, discoveries([p for *_, p in tested], [e - s for s, e, _ in tested])):
        if found:
            spans.append((at, end, "random"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def join_spans(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _scan(batches):
    own_worker("secrets")
    for batch in (part for whole in batches for part in parts_of(whole)):
        found = [find_secrets(t or "") for t in batch.column("text").to_pylist()]
        base = [[s for s in f if s[2] != "random"] for f in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id")]
            + [pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in KINDS[:3]]
            + [pa.array([hashlib.sha256(join_spans(b).encode()).hexdigest() for b in base]), pa.array([join_spans(f) for f in found], pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A null text counts as empty and has no spans. Repeated rows are scanned each; an empty table gives an empty result.
    Only doc_id and text are read.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(text: str | None, with_: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones joined, replaced; a null text stays null."""
    if not text or not (spans := find_secrets(text)):
        return text
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], with_]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns and rows, secrets in ``text`` masked and ``n_chars``, where there is one, counted anew."""
    prepare(docs.sparkSession)
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches):
        own_worker("secrets")
        for batch in (part for whole in batches for part in parts_of(whole, at)):
            texts = pa.array([mask(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
