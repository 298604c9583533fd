"""Prompts for a multiple-choice model and its answers as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from larder.enums import ABSTAIN_WORDS, EXCLUDE_ANSWERS
from larder.functions.text import FOOD_CODE

PROMPT_HEADER = (
    "식당 메뉴 {count}건을 음식 영양표의 후보와 짝짓는다. 메뉴마다 따로 판단한다.\n\n"
    "기준:\n"
    "1. 후보의 영양 수치를 그 메뉴의 수치로 손님에게 보여도 될 때만 번호를 고른다.\n"
    "2. 주재료가 다르거나 조리 방식이 달라지면 같은 음식이 아니다.\n"
    "3. 메뉴 이름에 꾸밈말만 더 붙었다면 같은 음식으로 볼 수 있다.\n"
    "4. 후보 뒤 대괄호는 [기원 · 분류]다. 같은 음식이 여럿이면 외식(분석함량), 외식(재료량 기반 산출함량), 가정식 차례로 고른다.\n"
    "5. 고기 부위나 재료 하나의 이름뿐인 메뉴는 요리가 아니므로 없음이다.\n"
    "6. 맞는 후보가 아예 없는 일이 많다. 확실하지 않으면 없음이라고 답한다.\n\n"
    "메뉴마다 한 줄씩 <메뉴번호>: <후보번호 또는 없음> 만 쓰고 다른 말은 쓰지 않는다. (보기: 1: 2)"
)


def prompt_item(index: Column, name: Column, restaurant: Column, candidates: Column) -> Column:
    """One numbered menu with its numbered candidate labels."""
    lines = F.array_join(F.transform(candidates, lambda c, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), c)), "\n")
    return F.concat(
        F.lit("[메뉴 "), index.cast("string"), F.lit("]\n메뉴명: "), name, F.lit("\n식당: "), F.coalesce(F.nullif(restaurant, F.lit("")), F.lit("(알 수 없음)")), F.lit("\n후보:\n"), lines, F.lit("\n")
    )


def prompt(count: Column, items: Column) -> Column:
    return F.concat(F.replace(F.lit(PROMPT_HEADER), F.lit("{count}"), count.cast("string")), F.lit("\n\n"), F.array_join(items, "\n"))


def parse_choice(answer: Column, count: Column) -> Column:
    """struct<ok, choice>: a number from 1 to count, or null for none of them; not ok where neither can be read."""
    a = F.trim(F.coalesce(answer, F.lit("")))
    abstains = reduce(lambda x, y: x | y, [F.contains(F.lower(a), F.lit(w)) for w in ABSTAIN_WORDS])
    number = F.nullif(F.regexp_extract(a, r"\d+", 0), F.lit("")).try_cast("int")
    none, inside = abstains | (number == 0), number.between(F.lit(1), count)
    ok = (a != "") & F.coalesce(none | inside, F.lit(False))
    return F.struct(ok.alias("ok"), F.when(ok & ~abstains & inside, number).alias("choice"))


def answer_lines(raw: Column) -> Column:
    """array<struct<index, answer>> of the numbered lines outside thinking blocks; null if such a block is not closed."""
    body = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?is)<think>.*?</think>", "")
    line = r"(?U)^\s*(\d+)\s*[:.)\-]\s*(.+?)\s*$"
    found = F.filter(F.split(body, r"\r?\n"), lambda t: t.rlike(line))
    parsed = F.transform(found, lambda t: F.struct(F.regexp_extract(t, line, 1).try_cast("int").alias("index"), F.regexp_extract(t, line, 2).alias("answer")))
    return F.when(~F.contains(F.lower(body), F.lit("<think>")), parsed)


def answer_class(answer: Column, count: int) -> Column:
    """What a labeller's answer says: unlabeled, excluded, no_match, rank, recall_miss or invalid."""
    a = F.trim(F.coalesce(answer, F.lit("")))
    number = F.when(a.rlike(r"^[+-]?\d+$"), a.try_cast("int"))
    return (
        F.when(a == "", "unlabeled").when(a.isin(*EXCLUDE_ANSWERS), "excluded").when(number == 0, "no_match").when(number.between(1, count), "rank")
        .when(number.isNull() & a.rlike(FOOD_CODE), "recall_miss").otherwise("invalid")
    )


def json_text(text: Column, key: str) -> Column:
    """The string value of a key somewhere in a text, by pattern, unescaped."""
    found = F.regexp_extract(text, rf'"{key}"\s*:\s*"((?:[^"\\]|\\.)*)"', 1)
    return F.when(text.rlike(rf'"{key}"\s*:\s*"((?:[^"\\]|\\.)*)"'), unescape(found))


def json_texts(text: Column, key: str) -> Column:
    """The strings of a key's array somewhere in a text; empty without it."""
    inside = F.regexp_extract(text, rf'(?s)"{key}"\s*:\s*\[(.*?)\]', 1)
    return F.transform(F.regexp_extract_all(inside, F.lit(r'"((?:[^"\\]|\\.)*)"'), 1), unescape)


def unescape(text: Column) -> Column:
    for a, b in (("\\n", "\n"), ('\\"', '"'), ("\\\\", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def model_text(response: Column) -> Column:
    """The first part's text of the first candidate in a model's JSON response."""
    return F.get_json_object(response, "$.candidates[0].content.parts[0].text")


def model_texts(response: Column) -> Column:
    """All parts' texts of the first candidate, joined."""
    parts = F.from_json(F.get_json_object(response, "$.candidates[0].content.parts"), "array<struct<text: string>>")
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
