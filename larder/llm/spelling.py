"""Spelling variants: pairs of words one edit apart, by merging the light subtrees of a trie with one letter skipped or
replaced.

Two words one edit apart part at one node of the trie of all words, where each takes another child or ends; the rest of one
is that of the other after one letter is skipped or replaced there. So at every node the light children, all but the one
with most words, are merged into the others: a word below a light child is hung up again without its letter there, with the
heavy child's letter in its place, with that letter put before it, and with any letter there. Where it meets a word at the
same end the two are a pair, and each pair is met once. A word has at most log2(words) light edges, so what is hung up stays
within that many times the words, however they are spread.

The trie is never in one place: a node is a 64-bit hash of its beginning, its children's sizes are counted by a shuffle, and
ends meet in equi-joins of whole words, so that two beginnings of one hash cost work and no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from larder.llm.common import discard, materialise, parts_of, prepare

#: What a word is made of, and its least length in letters; the least number of times it occurs.
LETTERS, LEAST_LETTERS, LEAST_COUNT = r"A-Za-z\x{C0}-\x{FF}", 7, 2
#: A word's form occurs at least so many times as often.
MORE_OFTEN = 10
#: Bytes of words whose beginnings are hashed at once, and rows of a batch that is returned.
SLICE_BYTES, BATCH_ROWS = 128 << 10, 1 << 18
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
EDGES = "id long, depth int, node long, letter int"
#: The letter of a word's end.
END = -1


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(docs: DataFrame, least: int = LEAST_LETTERS) -> DataFrame:
    """(doc_id, run): every maximal run of at least ``least`` letters of the whole texts, A to Z lower-cased."""
    found = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}"), 0)
    return docs.select("doc_id", F.explode(found).alias("run")).select("doc_id", lower_ascii(F.col("run")).alias("run"))


def counted(words: DataFrame, least: int = LEAST_LETTERS, times: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return words.filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= times)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every word the edge that it takes at each of its beginnings, and its end."""
    with np.errstate(over="ignore"):
        for whole in batches:
            for batch in parts_of(whole, "word", SLICE_BYTES):
                words = batch.column("word").to_pylist()
                size = np.array([len(w) + 1 for w in words])
                start = np.cumsum(size) - size
                letter = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), "<u4").astype(np.uint64)
                depth = np.arange(len(letter)) - np.repeat(start, size)
                power = np.cumprod(np.full(int(size.max()), BASE, np.uint64))
                term = (letter + np.uint64(1)) * MIX
                term = (term ^ (term >> np.uint64(31))) * power[depth]
                total = np.cumsum(term) - term  # of the letters before
                node = (total - np.repeat(total[start], size)) ^ (depth.astype(np.uint64) * MIX)
                node = (node ^ (node >> np.uint64(30))) * MIX
                letters = letter.astype(np.int32)
                letters[start + size - 1] = END
                ids = np.repeat(batch.column("id").to_numpy(), size)
                out = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(depth.astype(np.int32)), pa.array(node.view(np.int64)), pa.array(letters)], names=["id", "depth", "node", "letter"])
                yield from (out.slice(at, BATCH_ROWS) for at in range(0, len(ids), BATCH_ROWS))


def light_edges(words: DataFrame) -> DataFrame:
    """(id, depth, heavy, lights) of every word (id, word) at each node where it does not go with most of the words: the
    heavy child's letter, and how many light children the node has, the end not counted."""
    edges = words.select("id", "word").mapInArrow(_edges, EDGES)
    kids = edges.groupBy("node", "letter").agg(F.count("*").alias("n"))
    real = F.col("letter") != END
    heavy = F.max_by("letter", F.when(real, F.struct("n", "letter"))).alias("heavy")
    nodes = kids.groupBy("node").agg(heavy, F.count("*").alias("kids"), F.count(F.when(real, 1)).alias("real")).filter("kids > 1 and real > 0")
    nodes = materialise(nodes.select("node", "heavy", (F.col("real") - 1).alias("lights")), "trie-nodes")
    light = edges.join(nodes, "node").filter("letter <> heavy").select("id", "depth", "letter", "heavy", "lights")
    out = materialise(light, "light-edges")
    discard(nodes)
    return out


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best) of the words (id, word, n) that others are one edit from: how many, and (-n, word) of the most
    frequent one, of equal ones the first by code points."""
    light = light_edges(words)
    w, d = F.col("word"), F.col("depth")
    heavy = F.char(F.col("heavy"))
    # char() keeps eight bits only; letters beyond are written through UTF-16.
    wide = F.decode(F.unhex(F.lpad(F.hex(F.col("heavy").cast("long")), 8, "0")), "UTF-32")
    at = light.withColumn("letter", F.col("letter") != END).withColumn("heavy", F.when(F.col("heavy") < 128, heavy).otherwise(wide))
    hung = at.join(words, "id").withColumns({"before": F.substr(w, F.lit(1), d), "after": F.substr(w, d + 2), "rest": F.substr(w, d + 1)})
    own = F.substr("word", d + 1, F.lit(1))
    # Of a run of one letter only the last is skipped: at the others the two words still go the same way.
    skipped = F.when(F.col("letter") & (own != F.substr("word", d + 2, F.lit(1))), F.concat("before", "after"))
    replaced = F.when(F.col("letter"), F.concat("before", "heavy", "after"))
    put = F.concat("before", "heavy", "rest")
    hung = hung.withColumns({"ends": F.filter(F.array(skipped, replaced, put), lambda e: e.isNotNull()), "open": F.when(F.col("letter") & (F.col("lights") > 1), F.struct("before", "after"))})
    hung = materialise(hung.select("word", "n", "ends", "open"), "hung-words")
    discard(light)
    other = words.select(F.col("word").alias("end"), F.col("n").alias("end_n"))
    met = hung.select("word", "n", F.explode("ends").alias("end")).join(other, "end")
    one = lambda of, near, n: F.struct(F.col(of).alias("word"), F.lit(1).cast("long").alias("count"), F.struct((-F.col(n)).alias("less"), F.col(near).alias("word")).alias("best"))
    pairs = met.select(F.explode(F.array(one("word", "end", "end_n"), one("end", "word", "n"))).alias("p")).select("p.*")
    # Words that are equal but for one light letter: as many as the node has light children, at most one for each letter.
    groups = hung.filter("open is not null").groupBy("open").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col("word").alias("word")))).alias("all")).filter(F.size("all") > 1)
    each = groups.select(F.size("all").alias("size"), F.slice("all", 1, 2).alias("top"), F.explode("all").alias("m"))
    best = F.when(F.get("top", F.lit(0))["word"] == F.col("m.word"), F.get("top", F.lit(1))).otherwise(F.get("top", F.lit(0)))
    found = pairs.unionByName(each.select("m.word", (F.col("size") - 1).cast("long").alias("count"), best.alias("best")))
    return found.groupBy("word").agg(F.sum("count").alias("n_near"), F.min("best").alias("best"))


def with_roots(formed: DataFrame) -> DataFrame:
    """(word, root): forms of forms followed to the last, twice as far in each round. A form is several times as frequent as
    its word, so that no chain has more than some twenty steps."""
    links = materialise(formed.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = materialise(step, "spelling-roots")
        discard(links)
        links = step.select("word", "root")
        links._scratch = step._scratch
        if step.filter("moved").isEmpty():
            return links


def variants(words: DataFrame, more_often: int = MORE_OFTEN) -> DataFrame:
    """Each word (word, n) with ``form``, its near word of largest n if that is at least ``more_often`` times its own;
    ``root``, the last of the forms' forms, else the word; ``n_near`` and ``form_n``.

    Near words differ by exactly one inserted, deleted or replaced code point. Words are distinct and not null; an empty
    table gives an empty result. Other columns are not read.
    """
    prepare(words.sparkSession)
    words = materialise(words.select("word", F.col("n").cast("long").alias("n"), F.monotonically_increasing_id().alias("id")), "spelling-words")
    near = near_words(words)
    often = -F.col("best.less") >= more_often * F.col("n")
    formed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("best.word")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"))
    formed = materialise(formed, "spelling-forms")
    roots = with_roots(formed)
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
