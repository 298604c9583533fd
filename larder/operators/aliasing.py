"""The multiple-choice fallback: names grouped, known decisions reused, the rest asked in batches through a client."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from larder.enums import METHOD_CONFIDENCE
from larder.functions.answers import answer_lines, parse_choice, prompt, prompt_item
from larder.functions.text import food_label
from larder.operators.upsert import upsert
from larder.runtime import in_order, materialise, ship, with_rank

BATCH_CLOUD, BATCH_LOCAL = 20, 5
#: Batches that may fail one after another before a task stops asking; calls of one batch after the first; seconds before
#: the first of them, doubled for each other one; calls a minute of a client with a quota.
MAX_FAILURES, RETRIES, RETRY_SECONDS, CALLS_A_MINUTE = 3, 3, 2.0, 5
#: Names that one task numbers into batches; batches that are asked before their decisions are logged.
DEAL_NAMES, ROUND = 10_000, 256
DECIDED = "normalized_name string, decision string, food_code string, raw_answer string, model string"


class Busy(Exception):
    """Raised by a client whose call may succeed later; ``wait`` is the time in seconds that the server asks for, if any."""

    def __init__(self, message: str = "", wait: float | None = None):
        super().__init__(message)
        self.wait = wait


class Refused(Exception):
    """Raised by a client with which no call can succeed, as with a wrong key or model; it ends the run."""


class LlmClient(Protocol):
    """Answers a prompt with one line per item. ``persists`` tells whether its decisions may be stored. Raises ``Busy`` or
    ``Refused``; any other error fails one batch."""

    name: str
    persists: bool

    def ask(self, prompt: str, items: int) -> str: ...


class FakeClient:
    """Chooses the first candidate of every item whose number is odd, and none for the others; nothing is stored. Items
    whose number ``skip`` divides get no line."""

    name, persists = "fake", False

    def __init__(self, skip: int = 0):
        self.skip = skip

    def ask(self, prompt: str, items: int) -> str:
        return "\n".join(f"{i}: {1 if i % 2 else '없음'}" for i in range(1, items + 1) if not self.skip or i % self.skip)


def name_groups(unmatched: DataFrame) -> DataFrame:
    """(normalized_name, menu_name, restaurant_name, menus, first_id): each name once, with its first menu's texts and the
    number of its menus. Decisions go back to the menus by a join on the name, so no list of ids is gathered."""
    first = F.min_by(F.struct("menu_name", "restaurant_name"), "menu_id")
    by = unmatched.groupBy("normalized_name").agg(first.alias("f"), F.count("*").alias("menus"), F.min("menu_id").alias("first_id"))
    return by.select("normalized_name", "f.menu_name", "f.restaurant_name", "menus", "first_id")


def matches_of(unmatched: DataFrame, decided: DataFrame) -> DataFrame:
    """(menu_id, food_code, matched_by, confidence) of every menu whose name was decided for a food."""
    d = decided.filter("food_code is not null").select("normalized_name", "food_code")
    return unmatched.join(d, "normalized_name").select("menu_id", "food_code", F.lit("LLM").alias("matched_by"), F.lit(METHOD_CONFIDENCE["LLM"]).cast("decimal(4,3)").alias("confidence"))


def with_alias(groups: DataFrame, alias: DataFrame) -> DataFrame:
    """Groups with ``known`` and the stored ``food_code``; a known null code is a decision for none."""
    a = alias.select("normalized_name", "food_code", F.lit(True).alias("known"))
    return groups.join(a, "normalized_name", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def to_ask(groups: DataFrame, top: DataFrame, limit: int | None = None) -> DataFrame:
    """Unknown names with candidate labels and codes, numbered by name; names without candidates are left out before the
    limit is applied."""
    label = food_label(F.col("food_name"), F.col("origin"), F.col("major_category"))
    listed = top.groupBy(F.col("name").alias("normalized_name")).agg(F.array_sort(F.collect_list(F.struct("nth", label.alias("label"), F.col("food_code").alias("code")))).alias("c"))
    rows = groups.filter(~F.col("known")).drop("food_code", "known").join(listed, "normalized_name")
    rows = rows.select("*", F.transform("c", lambda c: c["label"]).alias("labels"), F.transform("c", lambda c: c["code"]).alias("codes")).drop("c")
    return rows if limit is None else rows.orderBy("normalized_name").limit(limit)


def batch_of(order: Column, size: int) -> Column:
    """Batch number, from 0, of rows numbered from 1."""
    return F.floor((order - 1) / size).cast("long")


def prompts(asked: DataFrame, size: int = BATCH_CLOUD) -> DataFrame:
    """(batch, prompt, n, items): names in chunks of at most ``size``, in their order. More than ``DEAL_NAMES`` names are
    dealt to groups by hash first, so that no task numbers them all; the cluster's size plays no part."""
    asked = materialise(asked, "llm-asked")
    groups = max(1, -(-asked.count() // DEAL_NAMES))
    dealt = asked.withColumn("deal", F.pmod(F.xxhash64("normalized_name"), F.lit(groups)))
    nth = F.row_number().over(Window.partitionBy("deal").orderBy("normalized_name"))
    numbered = dealt.withColumn("nth", nth).withColumns({"chunk": batch_of(F.col("nth"), size), "index": ((F.col("nth") - 1) % size + 1).cast("int")})
    item = prompt_item(F.col("index"), F.col("menu_name"), F.col("restaurant_name"), F.col("labels"))
    row = F.struct("index", item.alias("text"), "normalized_name", "codes")
    by = numbered.groupBy("deal", "chunk").agg(F.array_sort(F.collect_list(row)).alias("items"))
    n = F.size("items")
    return by.select(F.format_string("%d-%d", "deal", "chunk").alias("batch"), prompt(n, F.transform("items", lambda i: i["text"])).alias("prompt"), n.alias("n"), "items")


class Caller:
    """Calls of one client from one task: spaced to a number a minute, and repeated while the client is busy."""

    def __init__(self, client: LlmClient, a_minute: int = 0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.client, self.gap, self.sleep, self.clock = client, 60.0 / a_minute if a_minute > 0 else 0.0, sleep, clock
        self.next = None

    def __call__(self, text: str, n: int) -> str:
        for retry in range(RETRIES + 1):
            now = self.clock()
            if self.next is not None and now < self.next:
                self.sleep(self.next - now)
                now = self.next
            self.next = now + self.gap
            try:
                return self.client.ask(text, n)
            except Busy as e:
                if retry == RETRIES:
                    raise
                self.sleep(RETRY_SECONDS * 2**retry if e.wait is None else e.wait)
        raise AssertionError


def _answers(batches: DataFrame, client: LlmClient, a_minute: int) -> DataFrame:
    """(batch, raw, refused) of written batches: the client's answer, null where it failed or was not asked, and why it refused.
    After a refusal, or three failures in a row, a task asks no more. With a number of calls a minute one task asks all, as the
    quota is one for all."""
    ship(batches.sparkSession)

    def run(frames):
        failures, caller = 0, Caller(client, a_minute)
        for df in frames:
            raw, refused = [], []
            for text, n in zip(df["prompt"], df["n"]):
                answer = why = None
                if failures < MAX_FAILURES:
                    try:
                        answer, failures = caller(text, int(n)), 0
                    except Refused as e:
                        why, failures = str(e) or "refused", MAX_FAILURES
                    except Exception:  # noqa: BLE001  a failed batch is asked again in the next run
                        failures += 1
                raw.append(answer)
                refused.append(why)
            yield pd.DataFrame({"batch": df["batch"], "raw": raw, "refused": refused})

    wanted = batches.select("batch", "prompt", "n")
    return materialise((wanted.coalesce(1) if a_minute else wanted).mapInPandas(run, "batch string, raw string, refused string"), "llm-answers")


def _refusal(answers: DataFrame) -> Refused | None:
    first = answers.filter("refused is not null").select("refused").first()
    return Refused(first[0]) if first else None


def ask(batches: DataFrame, client: LlmClient, a_minute: int = 0) -> DataFrame:
    """Batches with the client's ``raw`` answer, null where it failed. Prompts and answers are written, so that no later read
    calls the client again. A refusal raises ``Refused``."""
    batches = materialise(batches, "llm-batches")
    answers = _answers(batches, client, a_minute)
    if refusal := _refusal(answers):
        raise refusal
    return batches.join(answers.select("batch", "raw"), "batch")


class DecisionLog:
    """Decisions in the order in which they were paid for: every round of batches appends one folder, which appears at once.
    What a run has logged no later run asks for, however the run ended; of a name in two rounds the first decision counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def rounds(self) -> list[int]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at(self.path))] if self._fs.exists(self._at(self.path)) else []
        return sorted(int(n.removeprefix("round=")) for n in names if n.startswith("round="))

    def append(self, decided: DataFrame, model: str) -> int:
        """The decisions of one round, failures left out; returns its number. A draft that was never finished is not read."""
        number, draft = max(self.rounds(), default=0) + 1, f"{self.path}/draft-{uuid.uuid4().hex}"
        decided.filter("decision <> 'failed'").select("normalized_name", "decision", "food_code", "raw_answer", F.lit(model[:60]).alias("model")).write.parquet(draft)
        if self.rounds()[-1:] == [number] or not self._fs.rename(self._at(draft), self._at(f"{self.path}/round={number}")):
            raise RuntimeError(f"{self.path}: round {number} was written by another run")
        return number

    def read(self, after: int = 0) -> DataFrame:
        """(normalized_name, decision, food_code, raw_answer, model) of the rounds after one, each name once."""
        paths = [f"{self.path}/round={n}" for n in self.rounds() if n > after]
        if not paths:
            return self.spark.createDataFrame([], DECIDED)
        rows = self.spark.read.schema(DECIDED).option("basePath", self.path).parquet(*paths).withColumn("round", F.regexp_extract(F.input_file_name(), r"/round=(\d+)/", 1).cast("int"))
        fields = [c.split()[0] for c in DECIDED.split(", ")][1:]
        return rows.groupBy("normalized_name").agg(F.min_by(F.struct(*fields), "round").alias("d")).select("normalized_name", "d.*")

    def known(self, alias: DataFrame) -> DataFrame:
        """(normalized_name, food_code) of stored decisions and, before them, those of the log."""
        logged = self.read().select("normalized_name", "food_code")
        return logged.unionByName(alias.select("normalized_name", "food_code").join(logged, "normalized_name", "left_anti"))


def ask_logged(batches: DataFrame, client: LlmClient, log: DecisionLog, a_minute: int = 0, round_size: int = ROUND) -> DataFrame:
    """Asks the batches in rounds of ``round_size`` and logs each round's decisions before the next begins; returns what
    ``decisions`` does for the batches that were asked. A refusal raises ``Refused`` after its round was logged; after a round
    in which every batch failed no more is asked. If the driver is lost, all rounds but the one under way are kept."""
    placed = in_order(batches, ["batch"], "llm-batches")
    ranked, n = with_rank(placed)
    ranked, done = materialise(ranked, "llm-rounds"), []
    for first in range(0, n, round_size):
        some = ranked.filter(F.col("rank").between(first, first + round_size - 1)).drop("rank")
        answers = _answers(some, client, a_minute)
        decided = materialise(decisions(some.join(answers.select("batch", "raw"), "batch")), "llm-decided")
        log.append(decided, client.name)
        done.append(decided)
        if refusal := _refusal(answers):
            raise refusal
        if answers.filter("raw is not null").isEmpty():
            break
    none = batches.sparkSession.createDataFrame([], "normalized_name string, decision string, food_code string, raw_answer string")
    return reduce(DataFrame.unionByName, done, none)


def decisions(answered: DataFrame) -> DataFrame:
    """(normalized_name, decision, food_code, raw_answer): matched, abstained, or failed where no answer can be read; of
    several lines for one item the first that can be read counts."""
    items = answered.select("batch", "raw", F.explode("items").alias("i")).select("batch", "i.index", "i.normalized_name", "i.codes")
    lines = answered.select("batch", F.posexplode(answer_lines(F.col("raw"))).alias("pos", "l")).select("batch", "pos", "l.index", "l.answer")
    sizes = items.select("batch", "index", F.size("codes").alias("n"))
    read = lines.join(sizes, ["batch", "index"]).select("batch", "index", "pos", parse_choice(F.col("answer"), F.col("n")).alias("p")).filter("p.ok")
    first = read.groupBy("batch", "index").agg(F.min_by("p", "pos").alias("p"))
    joined = items.join(first, ["batch", "index"], "left")
    code = F.get("codes", F.col("p.choice") - 1)
    decision = F.when(F.col("p").isNull(), "failed").when(F.col("p.choice").isNull(), "abstained").otherwise("matched")
    raw_answer = F.when(F.col("p").isNotNull(), F.coalesce(F.col("p.choice").cast("string"), F.lit("없음")))
    return joined.select("normalized_name", decision.alias("decision"), code.alias("food_code"), raw_answer.alias("raw_answer"))


def alias_rows(decided: DataFrame) -> DataFrame:
    """Rows of the alias table from decisions with their ``model``, failures left out; confidence is null for none, the
    model's name cut at 60."""
    sure = F.when(F.col("food_code").isNotNull(), F.lit(METHOD_CONFIDENCE["LLM"])).cast("decimal(3,2)")
    return decided.filter("decision <> 'failed'").select("normalized_name", "food_code", F.lit("LLM").alias("matched_by"), sure.alias("confidence"), F.left("model", F.lit(60)).alias("model"), "raw_answer")


def store(alias: DataFrame, decided: DataFrame, model: str) -> DataFrame:
    """The alias table with the decisions of one model."""
    new = alias_rows(decided.withColumn("model", F.lit(model)))
    return upsert(alias, new, ["normalized_name"], ["food_code", "matched_by", "confidence", "model", "raw_answer"])


def report(groups: DataFrame, decided: DataFrame) -> DataFrame:
    """One row of counts of names and menus by outcome; names that were never asked count as waiting."""
    joined = groups.join(decided.select("normalized_name", "decision", F.col("food_code").alias("new_code")), "normalized_name", "left")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    known, d, menus = F.col("known"), F.coalesce("decision", F.lit("")), F.col("menus")
    matched = (known & F.col("food_code").isNotNull()) | (d == "matched")
    return joined.agg(
        F.count("*").alias("names"), n(known).alias("cached"), n(d != "").alias("asked"), n(matched).alias("matched_names"), F.coalesce(F.sum(F.when(matched, menus)), F.lit(0)).cast("long").alias("matched_menus"),
        n((known & F.col("food_code").isNull()) | (d == "abstained")).alias("abstained_names"), n(d == "failed").alias("failed_names"), n(~known & (d == "")).alias("waiting_names"),
    )
