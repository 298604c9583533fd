"""Per-member analytics: history, trends, calorie and macro targets, deficiency cards, reports."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from larder.enums import CARBOHYDRATE_SHARE, CARDS, DISEASE_ISSUES, DISEASE_PRIORITY, FALLBACK_ISSUES, FAT_SHARE, PROTEIN_SHARE, TREND_ROWS, TREND_ROWS_EXPANDED
from larder.functions.numeric import macro_grams, per_meal, per_meal_int, target_calories
from larder.functions.rules import fallback_summary, issue_label, stale
from larder.runtime import materialise, ship


def keep_latest(inbody: DataFrame) -> DataFrame:
    """The row with the highest id of each member and day."""
    rest = [c for c in inbody.columns if c not in ("member_id", "measured_at")]
    return inbody.groupBy("member_id", "measured_at").agg(F.max_by(F.struct(*rest), "id").alias("r")).select("member_id", "measured_at", "r.*").select(*inbody.columns)


def latest(inbody: DataFrame) -> DataFrame:
    """The last row of each member by day, then id."""
    rest = [c for c in inbody.columns if c != "member_id"]
    return inbody.groupBy("member_id").agg(F.max_by(F.struct(*rest), F.struct("measured_at", "id")).alias("r")).select("member_id", "r.*").select(*inbody.columns)


def history(inbody: DataFrame, today: Column) -> DataFrame:
    """All rows, newest first within a member, with whether they are stale today."""
    newest = Window.partitionBy("member_id").orderBy(F.desc("measured_at"), F.desc("id"))
    return inbody.withColumns({"nth": F.row_number().over(newest), "stale": stale(F.col("measured_at"), today)})


def recent(inbody: DataFrame, expanded: bool = False) -> DataFrame:
    """The last days of each member, one row a day, newest first as ``nth``."""
    newest = Window.partitionBy("member_id").orderBy(F.desc("measured_at"))
    ranked = keep_latest(inbody).withColumn("nth", F.row_number().over(newest))
    return ranked.filter(F.col("nth") <= (TREND_ROWS_EXPANDED if expanded else TREND_ROWS))


def trend(inbody: DataFrame, expanded: bool = False) -> DataFrame:
    """What ``recent`` gives, oldest first: ``place`` counts up with the day."""
    n = F.count("*").over(Window.partitionBy("member_id"))
    return recent(inbody, expanded).select("member_id", "measured_at", "inbody_score", (n - F.col("nth") + 1).cast("int").alias("place"))


def targets(rows: DataFrame) -> DataFrame:
    """Daily calories and grams from bmr, exercise_count, exercise_intensity and goal."""
    kcal = rows.withColumn("calories", target_calories(F.col("bmr"), F.col("exercise_count"), F.col("exercise_intensity"), F.col("goal")))
    shares = {"carbohydrate": CARBOHYDRATE_SHARE, "protein": PROTEIN_SHARE, "fat": FAT_SHARE}
    return kcal.withColumns({n: macro_grams(F.col("calories"), s) for n, s in shares.items()})


def member_targets(members: DataFrame, inbody: DataFrame) -> DataFrame:
    """Targets of the members that have a measurement, from the latest one."""
    last = latest(inbody).select(F.col("member_id").alias("id"), F.col("id").alias("source_inbody_id"), "bmr")
    return targets(members.join(last, "id").withColumn("bmr", F.col("bmr").cast("double"))).select("id", "source_inbody_id", "calories", "carbohydrate", "protein", "fat")


def per_meal_targets(daily: DataFrame) -> DataFrame:
    third = {c: per_meal(F.col(c)) for c in ("carbohydrate", "protein", "fat")}
    return daily.withColumns({"calories": per_meal_int(F.col("calories")), **third})


def outdated(daily: DataFrame, inbody: DataFrame) -> DataFrame:
    """Targets with whether a later measurement than theirs exists; false for members without any."""
    last = latest(inbody).select(F.col("member_id").alias("id"), F.col("id").alias("last_id"))
    return daily.join(last, "id", "left").withColumn("outdated", F.coalesce(F.col("last_id") != F.col("source_inbody_id"), F.lit(False))).drop("last_id")


def deficiency_cards(members: DataFrame) -> DataFrame:
    """(member_id, priority, issue, related) from (member_id, diseases): protein first, then the diseases' first issues and
    their second ones, by the diseases' weight; one card per issue with all its diseases; fallbacks fill up to two, and
    three cards stay."""
    spark = members.sparkSession
    rows = [(d, issue, rank, DISEASE_PRIORITY.index(d)) for d, issues in DISEASE_ISSUES.items() for rank, issue in enumerate(issues)]
    known = spark.createDataFrame(rows, "disease string, issue string, rank int, weight int")  # eight fixed rows
    asked = members.select("member_id", F.explode("diseases").alias("disease")).join(F.broadcast(known), "disease")
    place = F.struct("rank", "weight")
    merged = asked.groupBy("member_id", "issue").agg(F.min(place).alias("at"), F.array_sort(F.collect_set(F.struct(place.alias("at"), "disease"))).alias("from"))
    own = merged.select("member_id", "issue", F.col("at.rank").alias("rank"), F.col("at.weight").alias("weight"), F.transform("from", lambda d: d["disease"]).alias("related"))
    none = F.array().cast("array<string>")
    fallback = members.select("member_id", F.posexplode(F.array(*map(F.lit, FALLBACK_ISSUES))).alias("weight", "issue")).withColumns({"rank": F.lit(2), "related": none})
    rest = fallback.join(own.select("member_id", "issue"), ["member_id", "issue"], "left_anti").select(*own.columns)
    order = Window.partitionBy("member_id").orderBy("rank", "weight")
    others = own.unionByName(rest).withColumn("priority", F.row_number().over(order) + 1).filter(F.col("priority") <= CARDS)
    first = members.select("member_id", F.lit(1).alias("priority"), F.lit("PROTEIN").alias("issue"), none.alias("related"))
    return first.unionByName(others.select("member_id", "priority", "issue", "related"))


class AiClient(Protocol):
    """Writes the text of a member's cards from the score and (issue, related diseases) of each: a summary and a
    description for every card. Targets and other computed values are not given to it."""

    def generate(self, score: int, cards: list[tuple[str, list[str]]]) -> tuple[str, list[str]]: ...


class FakeWriter:
    """Writes the score and the issues; fails for scores that five divides."""

    def generate(self, score: int, cards: list[tuple[str, list[str]]]) -> tuple[str, list[str]]:
        if score % 5 == 0:
            raise RuntimeError("no text")
        return f"{score}: {', '.join(issue for issue, _ in cards)}", [f"{issue} ({'/'.join(related)})" for issue, related in cards]


def summaries(cards: DataFrame) -> DataFrame:
    """(member_id, summary, descriptions): the template text that needs no model."""
    by = cards.groupBy("member_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("priority", "issue"))), lambda c: issue_label(c["issue"])).alias("labels"))
    return by.select("member_id", fallback_summary(F.col("labels")).alias("summary"), F.transform("labels", lambda x: F.concat(x, F.lit(" 관리를 권장합니다."))).alias("descriptions"))


def written_summaries(cards: DataFrame, scores: DataFrame, client: AiClient) -> DataFrame:
    """(member_id, summary, descriptions, by): a client's text for every member of ``cards`` with a score, and the template
    where it fails, gives an empty summary, or not one description for each card; ``by`` is ``model`` or ``template``."""
    ship(cards.sparkSession)
    listed = cards.groupBy("member_id").agg(F.array_sort(F.collect_list(F.struct("priority", "issue", "related"))).alias("cards"))

    def run(frames):
        for df in frames:
            rows = []
            for member, score, own in zip(df["member_id"], df["inbody_score"], df["cards"]):
                try:
                    summary, texts = client.generate(int(score), [(c["issue"], list(c["related"])) for c in own])
                    good = bool(summary and summary.strip()) and len(texts) == len(own)
                except Exception:  # noqa: BLE001  the template stands in
                    good = False
                rows.append((member, summary, list(texts)) if good else (member, None, None))
            yield pd.DataFrame(rows, columns=["member_id", "s", "d"])

    asked = listed.join(scores.select("member_id", "inbody_score"), "member_id").mapInPandas(run, "member_id long, s string, d array<string>")
    both = summaries(cards).join(materialise(asked, "ai-texts"), "member_id", "left")  # written: no later read calls again
    return both.select("member_id", F.coalesce("s", "summary").alias("summary"), F.coalesce("d", "descriptions").alias("descriptions"), F.when(F.col("s").isNotNull(), "model").otherwise("template").alias("by"))


def report(members: DataFrame, inbody: DataFrame) -> DataFrame:
    """One row per member with a measurement: score, target, cards and summary."""
    cards = deficiency_cards(members.select(F.col("id").alias("member_id"), "diseases"))
    last = latest(inbody).select("member_id", "inbody_score", "measured_at")
    daily = member_targets(members, inbody).withColumnRenamed("id", "member_id")
    by = cards.groupBy("member_id").agg(F.array_sort(F.collect_list(F.struct("priority", "issue", "related"))).alias("cards"))
    return last.join(daily, "member_id").join(by, "member_id").join(summaries(cards), "member_id")
