"""Queries on matching, its reports, and the multiple-choice fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from larder.enums import METHOD_CONFIDENCE
from larder.functions.answers import parse_choice
from larder.functions.text import food_label, is_branch
from larder.operators import aliasing, evaluation, matching, upsert
from larder.plans.catalog import query
from larder.plans.functions_catalog import CLASS_SQL, _GRAMS, _RANK
from larder.plans.views import BRANDS, Views
from larder.runtime import in_order, with_rank

GENERAL = matching.GENERAL


def names(v: Views) -> DataFrame:
    return v.menu.select(F.lit(GENERAL).alias("pool"), F.col("normalized_name").alias("name")).distinct()


def general(v: Views) -> DataFrame:
    return matching.candidates(v.official_food.withColumn("pool", F.lit(GENERAL)))


def listed(v: Views) -> DataFrame:
    return matching.shortlist(names(v), general(v))


def cand_sql(foods: str = "official_food") -> str:
    head, last = "split_part(normalized_name, '_', 1)", "split_part(normalized_name, '_', 2)"
    two = f"FROM {foods} WHERE contains(normalized_name, '_')"
    base = f"food_code, CASE serving_basis WHEN '100g' THEN 0 ELSE 1 END AS basis, {_RANK} AS origin_rank"
    return f"""SELECT {base}, normalized_name AS key, 0 AS ordinal, true AS allow FROM {foods}
        UNION ALL SELECT {base}, concat({last}, {head}), 1, true {two} UNION ALL SELECT {base}, {last}, 2, contains({last}, {head}) {two}"""


#: One row per food and key kept in the order among equals, so that names are compared with distinct texts.
_LIST_SQL = f"""
    WITH cand AS ({cand_sql()}), name AS (SELECT DISTINCT normalized_name AS name FROM menu),
    keys AS (SELECT key, {_GRAMS.format('key')} AS kg FROM (SELECT DISTINCT key FROM cand)), ng AS (SELECT name, {_GRAMS.format('name')} AS ng FROM name),
    near AS (SELECT name, key, len(list_intersect(ng, kg)) AS i, len(ng) AS a, len(kg) AS b FROM ng, keys),
    scored AS (SELECT name, cand.*, i / (a + b - i) AS jaccard FROM near JOIN cand USING (key) WHERE i > 0),
    listed AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY jaccard DESC, basis, origin_rank, food_code, ordinal) AS place FROM scored QUALIFY place <= 50)
"""


@query("jn_exact", f"""
    WITH cand AS ({cand_sql()}) SELECT name, arg_min(food_code, struct_pack(b := basis, o := origin_rank, c := food_code)) AS food_code
    FROM (SELECT DISTINCT normalized_name AS name FROM menu) JOIN cand ON key = name GROUP BY name
""")
def jn_exact(v: Views) -> DataFrame:
    return matching.exact(names(v), general(v)).select("name", "food_code")


@query("jn_ngram_block", _LIST_SQL + "SELECT name, food_code, CAST(ordinal AS INT) AS ordinal, round(jaccard, 6) AS jaccard FROM listed")
def jn_ngram_block(v: Views) -> DataFrame:
    return listed(v).select("name", "food_code", "ordinal", F.round("jaccard", 6).alias("jaccard"))


@query("win_top50", _LIST_SQL + "SELECT name, CAST(place AS INT) AS place, food_code, key FROM listed")
def win_top50(v: Views) -> DataFrame:
    return listed(v).select("name", "place", "food_code", "key")


@query("win_topn_food", _LIST_SQL + "SELECT name, food_code, CAST(row_number() OVER (PARTITION BY name ORDER BY min(place)) AS INT) AS nth FROM listed GROUP BY name, food_code QUALIFY nth <= 10")
def win_topn_food(v: Views) -> DataFrame:
    return matching.top_candidates(listed(v), 10).select("name", "food_code", "nth")


_STRUCT_SQL = """, ok AS (SELECT * FROM listed WHERE allow AND ((length(key) >= 2 AND contains(name, key) AND length(key) / length(name) >= 0.5)
        OR (len(list_filter(string_split(key, ' '), lambda t : NOT list_contains(string_split(name, ' '), t))) = 0 AND len(list_distinct(string_split(key, ' '))) < len(list_distinct(string_split(name, ' '))))))"""


#: Ratcliff/Obershelp similarity of the pairs (a, b): the longest common stretch, the first in a and then in b, and the
#: same again on either side of it, until none is left.
_RATIO_SQL = """
    seg AS (SELECT a AS pa, b AS pb, a, b, 0::BIGINT AS found FROM pairs
        UNION ALL SELECT pa, pb, unnest([substr(a, 1, m.i - 1), substr(a, m.i + m.l)]), unnest([substr(b, 1, m.j - 1), substr(b, m.j + m.l)]), unnest([m.l, 0])
        FROM (SELECT *, struct_pack(l := x.l, i := -x.i, j := instr(b, substr(a, -x.i, x.l))) AS m FROM (SELECT *, list_max(flatten(list_transform(range(1, length(a) + 1),
            lambda i : list_transform(list_filter(range(1, length(a) - i + 2), lambda l : contains(b, substr(a, i, l))), lambda l : struct_pack(l := l, i := -i))))) AS x
          FROM seg WHERE a <> '' AND b <> '') WHERE x IS NOT NULL)),
    ratio AS (SELECT pa, pb, 2.0e0 * sum(found) / (length(pa) + length(pb)) AS ratio FROM seg GROUP BY pa, pb)"""

#: Names (pool, name) and foods (pool, food_code) of one pool, without brands.
_ONE_POOL = "WITH RECURSIVE name AS (SELECT DISTINCT '' AS pool, normalized_name AS name FROM menu), pfood AS (SELECT '' AS pool, food_code FROM official_food)"


def cascade_sql() -> str:
    """Further common tables on ``name`` and ``pfood``, up to hit (pool, name, food_code, method)."""
    return f""", pcand AS (SELECT pool, c.* FROM ({cand_sql()}) c JOIN pfood USING (food_code)),
    pkeys AS (SELECT pool, key, {_GRAMS.format('key')} AS kg FROM (SELECT DISTINCT pool, key FROM pcand)), png AS (SELECT pool, name, {_GRAMS.format('name')} AS ng FROM name),
    pnear AS (SELECT png.pool, name, key, len(list_intersect(ng, kg)) AS i, len(ng) AS a, len(kg) AS b FROM png JOIN pkeys USING (pool)),
    pscored AS (SELECT pool, name, key, food_code, basis, origin_rank, ordinal, allow, i / (a + b - i) AS jaccard FROM pnear JOIN pcand USING (pool, key) WHERE i > 0),
    listed AS (SELECT *, row_number() OVER (PARTITION BY pool, name ORDER BY jaccard DESC, basis, origin_rank, food_code, ordinal) AS place FROM pscored QUALIFY place <= 50)
    {_STRUCT_SQL},
    pairs AS (SELECT DISTINCT replace(name, ' ', '') AS a, replace(key, ' ', '') AS b FROM listed
        WHERE 2 * least(length(replace(name, ' ', '')), length(replace(key, ' ', ''))) >= 0.9e0 * (length(replace(name, ' ', '')) + length(replace(key, ' ', '')))),
    {_RATIO_SQL},
    e AS (SELECT pool, name, arg_min(food_code, struct_pack(b := basis, o := origin_rank, c := food_code)) AS food_code FROM name JOIN pcand USING (pool) WHERE key = name GROUP BY pool, name),
    d AS (SELECT pool, name, arg_min(food_code, struct_pack(r := -ratio, p := place)) AS food_code, max(ratio) AS ratio FROM listed JOIN ratio ON pa = replace(name, ' ', '') AND pb = replace(key, ' ', '')
        WHERE ratio >= 0.9e0 GROUP BY pool, name),
    s AS (SELECT pool, name, food_code FROM ok QUALIFY row_number() OVER (PARTITION BY pool, name ORDER BY length(key), basis, origin_rank, food_code, ordinal) = 1),
    n AS (SELECT pool, name, food_code FROM listed WHERE pool = '' AND jaccard >= 0.65 AND allow QUALIFY row_number() OVER (PARTITION BY pool, name ORDER BY place) = 1),
    hit AS (SELECT pool, name, coalesce(e.food_code, d.food_code, s.food_code, n.food_code) AS food_code, concat(CASE WHEN pool <> '' THEN 'BRAND_' ELSE '' END,
            CASE WHEN e.food_code IS NOT NULL THEN 'EXACT' WHEN d.food_code IS NOT NULL THEN 'EDIT' WHEN s.food_code IS NOT NULL THEN 'STRUCT' ELSE 'NGRAM' END) AS method
        FROM name LEFT JOIN e USING (pool, name) LEFT JOIN d USING (pool, name) LEFT JOIN s USING (pool, name) LEFT JOIN n USING (pool, name)
        WHERE coalesce(e.food_code, d.food_code, s.food_code, n.food_code) IS NOT NULL)"""


@query("jn_struct", _LIST_SQL + _STRUCT_SQL + """
    SELECT name, food_code, key FROM ok QUALIFY row_number() OVER (PARTITION BY name ORDER BY length(key), basis, origin_rank, food_code, ordinal) = 1
""")
def jn_struct(v: Views) -> DataFrame:
    ok = listed(v).filter(matching.is_structural())
    return ok.groupBy("name").agg(F.min(F.struct(F.length("key"), "basis", "ordinal", "food_code", "key")).alias("b")).select("name", "b.food_code", "b.key")


@query("jn_ngram_accept", _LIST_SQL + "SELECT name, food_code FROM listed WHERE jaccard >= 0.65 AND allow QUALIFY row_number() OVER (PARTITION BY name ORDER BY place) = 1")
def jn_ngram_accept(v: Views) -> DataFrame:
    ok = listed(v).filter((F.col("jaccard") >= 0.65) & F.col("allow_contain"))
    return ok.groupBy("name").agg(F.min_by("food_code", "place").alias("food_code"))


@query("jn_edit", _ONE_POOL + cascade_sql() + "SELECT name, food_code, ratio FROM d")
def jn_edit(v: Views) -> DataFrame:
    close = matching.with_ratio(listed(v)).filter("ratio >= 0.9")
    return close.groupBy("name").agg(F.min_by(F.struct("food_code", "ratio"), F.struct(-F.col("ratio"), F.col("place"))).alias("b")).select("name", "b.food_code", "b.ratio")


@query("fn_seq_ratio", f"""
    WITH RECURSIVE pairs AS (SELECT DISTINCT food_name AS a, representative_name AS b FROM official_food), {_RATIO_SQL}
    SELECT food_code, round(ratio, 6) AS ratio FROM official_food JOIN ratio ON pa = food_name AND pb = representative_name
""")
def fn_seq_ratio(v: Views) -> DataFrame:
    rows = v.official_food.select("food_code", "food_name", "representative_name")
    return rows.select("food_code", F.round(matching.seq_ratio(F.col("food_name"), F.col("representative_name")), 6).alias("ratio"))


@query("fn_cascade", _ONE_POOL + cascade_sql() + "SELECT name, food_code, method FROM hit")
def fn_cascade(v: Views) -> DataFrame:
    return matching.cascade(names(v), general(v)).select("name", "food_code", "method")


@query("fn_cascade_native", _LIST_SQL + _STRUCT_SQL + """,
    e AS (SELECT name, arg_min(food_code, struct_pack(b := basis, o := origin_rank, c := food_code)) AS food_code FROM name JOIN cand ON key = name GROUP BY name),
    s AS (SELECT name, food_code FROM ok QUALIFY row_number() OVER (PARTITION BY name ORDER BY length(key), basis, origin_rank, food_code, ordinal) = 1),
    n AS (SELECT name, food_code FROM listed WHERE jaccard >= 0.65 AND allow QUALIFY row_number() OVER (PARTITION BY name ORDER BY place) = 1)
    SELECT name, coalesce(e.food_code, s.food_code, n.food_code) AS food_code, CASE WHEN e.food_code IS NOT NULL THEN 'EXACT' WHEN s.food_code IS NOT NULL THEN 'STRUCT' ELSE 'NGRAM' END AS method
    FROM name LEFT JOIN e USING (name) LEFT JOIN s USING (name) LEFT JOIN n USING (name) WHERE coalesce(e.food_code, s.food_code, n.food_code) IS NOT NULL
""")
def fn_cascade_native(v: Views) -> DataFrame:
    return matching.cascade(names(v), general(v), edit_least=None).select("name", "food_code", "method")


_BRAND_LIST = ", ".join(f"'{b}'" for b in BRANDS)
_BRAND = f"(SELECT b FROM (SELECT unnest([{_BRAND_LIST}]) AS b) WHERE contains(lower(name), b) ORDER BY length(b) DESC LIMIT 1)"


@query("jn_brand", f"SELECT id, {_BRAND} AS brand FROM restaurant")
def jn_brand(v: Views) -> DataFrame:
    return v.restaurant.select("id", matching.brand_of(F.col("name"), BRANDS).alias("brand"))


@query("jn_brand_pool", f"""
    WITH b AS (SELECT unnest([{_BRAND_LIST}]) AS pool), hit AS (SELECT pool, food_code FROM official_food JOIN b ON contains(lower(company_name), pool))
    SELECT pool, food_code FROM hit UNION ALL SELECT '', food_code FROM official_food WHERE food_code NOT IN (SELECT food_code FROM hit)
""")
def jn_brand_pool(v: Views) -> DataFrame:
    return matching.pools(v.official_food, BRANDS).select("pool", "food_code")


def menus_to_match(v: Views) -> DataFrame:
    r = v.restaurant.select(F.col("id").alias("restaurant_id"), F.col("name").alias("restaurant_name"), "cuisine")
    return v.menu.select(F.col("id").alias("menu_id"), "restaurant_id", F.col("name").alias("menu_name"), "normalized_name").join(r, "restaurant_id")


def matched(v: Views) -> DataFrame:
    """All menus with the label of their scope and, where they are in it, their match."""
    scope = matching.scope_label(F.col("restaurant_name"), F.col("cuisine"), BRANDS, franchise=False, branch=True, cafe=True)
    return matching.match_menus(menus_to_match(v).withColumn("scope", scope), v.official_food, BRANDS)


def scope_sql(franchise: bool) -> str:
    first = f"WHEN len(list_filter([{_BRAND_LIST}], lambda b : contains(lower(r.name), b))) > 0 THEN 'excluded_franchise'" if franchise else ""
    return f"CASE {first} WHEN r.name LIKE '%점' THEN 'excluded_branch' WHEN cuisine = 'CAFE_DESSERT' THEN 'excluded_cafe' ELSE 'kept' END"


#: Common tables up to matched: every menu with its scope, pool and match.
_MATCHED = f"""
    WITH RECURSIVE brand AS (SELECT unnest([{_BRAND_LIST}]) AS pool), owned AS (SELECT pool, food_code FROM official_food JOIN brand ON contains(lower(company_name), pool)),
    pfood AS (SELECT pool, food_code FROM owned UNION ALL SELECT '', food_code FROM official_food WHERE food_code NOT IN (SELECT food_code FROM owned)),
    place AS (SELECT id, name, cuisine, coalesce({_BRAND}, '') AS pool FROM restaurant),
    placed AS (SELECT m.id AS menu_id, m.name AS menu_name, normalized_name, r.name AS restaurant_name, pool, {scope_sql(False)} AS scope FROM menu m JOIN place r ON r.id = restaurant_id),
    name AS (SELECT DISTINCT pool, normalized_name AS name FROM placed WHERE normalized_name <> '')
    {cascade_sql()},
    matched AS (SELECT placed.*, food_code, method AS matched_by, CASE method {" ".join(f"WHEN '{m}' THEN {c}e0" for m, c in METHOD_CONFIDENCE.items())} END AS confidence
        FROM placed LEFT JOIN hit ON hit.pool = placed.pool AND hit.name = normalized_name)"""


@query("jn_brand_route", _MATCHED + "SELECT menu_id, pool, food_code, matched_by, confidence FROM matched")
def jn_brand_route(v: Views) -> DataFrame:
    return matched(v).select("menu_id", "pool", "food_code", "matched_by", F.col("confidence").cast("double").alias("confidence"))


@query("flt_scope", f"SELECT {scope_sql(True)} AS scope, count(*) AS menus FROM menu m JOIN restaurant r ON r.id = restaurant_id GROUP BY 1")
def flt_scope(v: Views) -> DataFrame:
    scope = matching.scope_label(F.col("restaurant_name"), F.col("cuisine"), BRANDS, franchise=True, branch=True, cafe=True)
    return menus_to_match(v).groupBy(scope.alias("scope")).agg(F.count("*").alias("menus"))


@query("agg_match_report", _MATCHED + """, c AS (SELECT count(*) FILTER (scope = 'excluded_franchise') AS excluded_franchise, count(*) FILTER (scope = 'excluded_branch') AS excluded_branch,
        count(*) FILTER (scope = 'excluded_cafe') AS excluded_cafe, count(*) FILTER (scope = 'kept') AS total_menus, count(*) FILTER (scope = 'kept' AND matched_by IS NOT NULL) AS matched,
        count(*) FILTER (scope = 'kept' AND pool <> '') AS brand_menus, count(*) FILTER (scope = 'kept' AND pool <> '' AND matched_by IS NOT NULL) AS brand_matched FROM matched)
    SELECT 'totals' AS part, *, total_menus - matched AS unmatched, round(coalesce(matched / nullif(total_menus, 0), 0) * 100, 1) AS rate, round(coalesce((matched - brand_matched) / nullif(total_menus - brand_menus, 0), 0) * 100, 1) AS general_rate,
        round(coalesce(brand_matched / nullif(brand_menus, 0), 0) * 100, 1) AS brand_rate, (SELECT count(DISTINCT restaurant_name) FROM matched WHERE scope = 'excluded_branch') AS excluded_branch_restaurants,
        (SELECT count(*) FROM pcand WHERE pool = '') AS total_candidates, (SELECT count(DISTINCT food_code) FROM owned) AS excluded_rows FROM c
    UNION ALL BY NAME SELECT 'method' AS part, matched_by AS item, count(*) AS menus, confidence FROM matched WHERE scope = 'kept' AND matched_by IS NOT NULL GROUP BY matched_by, confidence
    UNION ALL BY NAME SELECT CASE WHEN pool <> '' THEN 'brand_unmatched' ELSE 'unmatched' END AS part, normalized_name AS item, count(*) AS menus FROM matched WHERE scope = 'kept' AND matched_by IS NULL GROUP BY 1, 2
    UNION ALL BY NAME SELECT 'excluded_branch' AS part, restaurant_name AS item, count(*) AS menus FROM matched WHERE scope = 'excluded_branch' GROUP BY 2
""")
def agg_match_report(v: Views) -> DataFrame:
    return evaluation.match_report(matched(v), v.official_food, BRANDS)


@query("agg_match_methods", _MATCHED + "SELECT matched_by, count(*) AS menus FROM matched WHERE scope = 'kept' AND matched_by IS NOT NULL GROUP BY 1")
def agg_match_methods(v: Views) -> DataFrame:
    return evaluation.by_method(matched(v))


@query("agg_distinct_branch", "SELECT DISTINCT name AS restaurant_name FROM restaurant WHERE name LIKE '%점'")
def agg_distinct_branch(v: Views) -> DataFrame:
    return evaluation.branch_names(v.restaurant.select(F.col("name").alias("restaurant_name"))).filter(is_branch(F.col("restaurant_name")))


_GROUPS = _MATCHED + """, u AS (SELECT menu_id, menu_name, normalized_name, restaurant_name FROM matched WHERE scope = 'kept' AND pool = '' AND matched_by IS NULL AND normalized_name <> ''),
    g AS (SELECT normalized_name, arg_min(menu_name, menu_id) AS menu_name, arg_min(restaurant_name, menu_id) AS restaurant_name, count(*) AS menus, min(menu_id) AS first_id FROM u GROUP BY 1)"""


def unmatched(v: Views) -> DataFrame:
    """Menus of the general pool that no stage matches."""
    rows = lambda: matched(v).filter((F.col("scope") == "kept") & (F.col("pool") == GENERAL) & F.col("matched_by").isNull() & (F.col("normalized_name") != ""))
    return v.once("unmatched", lambda: rows().select("menu_id", "menu_name", "normalized_name", "restaurant_name"))


@query("agg_name_groups", _GROUPS + "SELECT * FROM g")
def agg_name_groups(v: Views) -> DataFrame:
    return aliasing.name_groups(unmatched(v))


def alias(v: Views) -> DataFrame:
    """Stored decisions for the names of two colours, half of them for none."""
    rows = unmatched(v).select("normalized_name").distinct().filter(F.contains("normalized_name", F.lit("red")) | F.contains("normalized_name", F.lit("blue")))
    code = F.when(F.contains("normalized_name", F.lit("red")), F.concat(F.lit("code "), "normalized_name"))
    none = F.lit(None).cast("string")
    return rows.select("normalized_name", code.alias("food_code"), F.lit("LLM").alias("matched_by"), F.lit(None).cast("decimal(3,2)").alias("confidence"), none.alias("model"), none.alias("raw_answer"))


_KNOWN = "(contains(normalized_name, 'red') OR contains(normalized_name, 'blue'))"


@query("jn_alias_cache", _GROUPS + f"SELECT normalized_name, {_KNOWN} AS known, CASE WHEN contains(normalized_name, 'red') THEN concat('code ', normalized_name) END AS food_code FROM g")
def jn_alias_cache(v: Views) -> DataFrame:
    return aliasing.with_alias(aliasing.name_groups(unmatched(v)), alias(v)).select("normalized_name", "known", "food_code")


def top_of(v: Views, wanted: DataFrame) -> DataFrame:
    """The candidates to show for names: of the general pool, which has no company's foods."""
    pool = matching.pools(v.official_food, BRANDS).filter(F.col("pool") == GENERAL)
    return matching.top_candidates(matching.shortlist(wanted.select(F.lit(GENERAL).alias("pool"), F.col("normalized_name").alias("name")).distinct(), matching.candidates(pool)), 10)


def groups_and_top(v: Views) -> tuple[DataFrame, DataFrame]:
    groups = aliasing.with_alias(aliasing.name_groups(unmatched(v)), alias(v))
    return groups, top_of(v, groups.filter("not known"))


#: The first food listed for every unmatched name, and the names to ask, numbered within their batches.
_ASKED = _GROUPS + f""", t AS (SELECT name AS normalized_name, arg_min(food_code, place) AS code FROM listed WHERE pool = '' GROUP BY name),
    asked AS (SELECT normalized_name, code, (row_number() OVER (ORDER BY normalized_name) - 1) % 20 + 1 AS i FROM g JOIN t USING (normalized_name) WHERE NOT {_KNOWN})"""


@query("lim_llm", _ASKED + "SELECT normalized_name FROM asked ORDER BY normalized_name LIMIT 15")
def lim_llm(v: Views) -> DataFrame:
    groups, top = groups_and_top(v)
    return aliasing.to_ask(groups, top, limit=15).select("normalized_name")


@query("win_batch_no", "WITH o AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM restaurant) SELECT id, (n - 1) // 20 AS batch FROM o")
def win_batch_no(v: Views) -> DataFrame:
    ranked, _ = with_rank(in_order(v.restaurant.select("id"), ["id"], "batches"))
    return ranked.select("id", aliasing.batch_of(F.col("rank") + 1, aliasing.BATCH_CLOUD).alias("batch"))


@query("snk_apply_decisions", _GROUPS + f"SELECT menu_id, concat('code ', normalized_name) AS food_code, 'LLM' AS matched_by, {METHOD_CONFIDENCE['LLM']}e0 AS confidence FROM u WHERE contains(normalized_name, 'red')")
def snk_apply_decisions(v: Views) -> DataFrame:
    return aliasing.matches_of(unmatched(v), alias(v)).select("menu_id", "food_code", "matched_by", F.col("confidence").cast("double").alias("confidence"))


def decided(v: Views, skip: int = 0) -> tuple[DataFrame, DataFrame]:
    """The groups, and a fake client's decisions on those that are not known."""
    groups, top = groups_and_top(v)
    return groups, aliasing.decisions(aliasing.ask(aliasing.prompts(aliasing.to_ask(groups, top)), aliasing.FakeClient(skip)))


@query("llm_client", _ASKED + """, b AS (SELECT (row_number() OVER (ORDER BY normalized_name) - 1) // 20 AS chunk FROM asked)
    SELECT concat('0-', CAST(chunk AS STRING)) AS batch, CAST(count(*) AS INT) AS n, array_to_string(list_transform(range(1, count(*) + 1), lambda i : concat(CAST(i AS STRING), ': ', CASE WHEN i % 2 = 1 THEN '1' ELSE '없음' END)), '\n') AS raw FROM b GROUP BY chunk
""")
def llm_client(v: Views) -> DataFrame:
    groups, top = groups_and_top(v)
    return aliasing.ask(aliasing.prompts(aliasing.to_ask(groups, top)), aliasing.FakeClient()).select("batch", "n", "raw")


@query("llm_decisions", _ASKED + """
    SELECT normalized_name, CASE WHEN i % 2 = 1 THEN 'matched' ELSE 'abstained' END AS decision, CASE WHEN i % 2 = 1 THEN code END AS food_code, CASE WHEN i % 2 = 1 THEN '1' ELSE '없음' END AS raw_answer FROM asked
""")
def llm_decisions(v: Views) -> DataFrame:
    return decided(v)[1].select("normalized_name", "decision", "food_code", "raw_answer")


@query("snk_upsert_alias", _GROUPS + f""", old AS (SELECT normalized_name, CASE WHEN contains(normalized_name, 'red') THEN concat('code ', normalized_name) END AS food_code FROM g WHERE {_KNOWN}),
    new AS (SELECT normalized_name, CASE WHEN contains(normalized_name, 'hot') OR contains(normalized_name, 'big red') THEN 'new' END AS food_code FROM g WHERE contains(normalized_name, 'hot') OR contains(normalized_name, 'red'))
    SELECT coalesce(n.normalized_name, o.normalized_name) AS normalized_name, CASE WHEN n.normalized_name IS NULL THEN o.food_code ELSE n.food_code END AS food_code,
           CASE WHEN n.food_code IS NOT NULL THEN {METHOD_CONFIDENCE['LLM']}e0 END AS confidence
    FROM old o FULL JOIN new n ON n.normalized_name = o.normalized_name
""")
def snk_upsert_alias(v: Views) -> DataFrame:
    rows = unmatched(v).select("normalized_name").distinct()
    has = lambda w: F.contains("normalized_name", F.lit(w))
    code = F.when(has("hot") | has("big red"), "new")
    decided = rows.filter(has("hot") | has("red")).select("normalized_name", F.when(code.isNull(), "abstained").otherwise("matched").alias("decision"), code.alias("food_code"), F.lit("1").alias("raw_answer"))
    extra = rows.filter(has("cold")).select("normalized_name", F.lit("failed").alias("decision"), F.lit("x").alias("food_code"), F.lit(None).cast("string").alias("raw_answer"))
    return aliasing.store(alias(v), decided.unionByName(extra), "m" * 80).select("normalized_name", "food_code", F.col("confidence").cast("double").alias("confidence"))


@query("agg_llm_report", _ASKED + f""", r AS (SELECT g.*, i, {_KNOWN} AS known, CASE WHEN i % 5 = 0 THEN 'failed' WHEN i % 2 = 1 THEN 'matched' WHEN i IS NOT NULL THEN 'abstained' ELSE '' END AS d FROM g LEFT JOIN asked USING (normalized_name)),
    h AS (SELECT *, known AND contains(normalized_name, 'red') OR d = 'matched' AS good FROM r)
    SELECT count(*) AS names, count(*) FILTER (known) AS cached, count(*) FILTER (d <> '') AS asked, count(*) FILTER (good) AS matched_names, CAST(coalesce(sum(menus) FILTER (good), 0) AS BIGINT) AS matched_menus,
        count(*) FILTER (known AND NOT contains(normalized_name, 'red') OR d = 'abstained') AS abstained_names, count(*) FILTER (d = 'failed') AS failed_names, count(*) FILTER (NOT known AND d = '') AS waiting_names FROM h
""")
def agg_llm_report(v: Views) -> DataFrame:
    return aliasing.report(*decided(v, skip=5))


@query("agg_label_score", f"""
    WITH c AS (SELECT {CLASS_SQL} AS k, try_cast(trim(answer) AS INT) AS a FROM label_row), n AS (SELECT count(*) AS total_rows, count(*) FILTER (k = 'unlabeled') AS unlabeled, count(*) FILTER (k = 'invalid') AS invalid,
        count(*) FILTER (k = 'excluded') AS excluded, count(*) FILTER (k = 'recall_miss') AS recall_miss, count(*) FILTER (k = 'no_match') AS no_match, count(*) FILTER (k = 'rank' AND a = 1) AS rank1,
        count(*) FILTER (k = 'rank' AND a <= 3) AS rank_le3, count(*) FILTER (k = 'rank') AS rank_le_n FROM c)
    SELECT *, total_rows - unlabeled - invalid - excluded AS labeled, rank_le_n + recall_miss AS exists_in_table, round(rank_le_n * 100.0e0 / (rank_le_n + recall_miss), 1) AS recall_at_n FROM n
""")
def agg_label_score(v: Views) -> DataFrame:
    return evaluation.label_score(v.label_row)


_CHOICES = "SELECT row_no, raw_choice IS NOT NULL AND NOT coalesce(try_cast(raw_choice AS INT) > 2, false) AS ok, CASE WHEN try_cast(raw_choice AS INT) BETWEEN 1 AND 2 THEN CAST(raw_choice AS INT) END AS choice FROM label_row"


def choices(v: Views) -> DataFrame:
    return v.label_row.select("row_no", parse_choice(F.col("raw_choice"), F.lit(2)).alias("p")).select("row_no", "p.ok", "p.choice")


@query("jn_gold", f"WITH c AS ({_CHOICES}) SELECT row_no, trim(answer) AS answer, choice FROM label_row JOIN c USING (row_no) WHERE ok")
def jn_gold(v: Views) -> DataFrame:
    return v.label_row.select("row_no", F.trim("answer").alias("answer")).join(choices(v).filter("ok"), "row_no").select("row_no", "answer", "choice")


@query("agg_llm_confusion", f"""
    WITH c AS ({_CHOICES}), g AS (SELECT {CLASS_SQL} AS k, try_cast(trim(answer) AS INT) AS a, ok, choice FROM label_row JOIN c USING (row_no)),
    n AS (SELECT count(*) AS total_rows, count(*) FILTER (k = 'unlabeled') AS unlabeled, count(*) FILTER (k IN ('excluded', 'invalid')) AS excluded, count(*) FILTER (k IN ('rank', 'no_match', 'recall_miss') AND NOT ok) AS failed,
        count(*) FILTER (k = 'rank' AND ok) AS inside_total, count(*) FILTER (k = 'rank' AND ok AND a = choice) AS inside_correct, count(*) FILTER (k = 'rank' AND ok AND a <> choice) AS inside_wrong,
        count(*) FILTER (k = 'rank' AND ok AND choice IS NULL) AS inside_missed, count(*) FILTER (k = 'no_match' AND ok) AS none_total, count(*) FILTER (k = 'no_match' AND ok AND choice IS NULL) AS none_abstained,
        count(*) FILTER (k = 'no_match' AND ok AND choice IS NOT NULL) AS none_picked, count(*) FILTER (k = 'recall_miss' AND ok) AS outside_total,
        count(*) FILTER (k = 'recall_miss' AND ok AND choice IS NULL) AS outside_abstained, count(*) FILTER (k = 'recall_miss' AND ok AND choice IS NOT NULL) AS outside_picked FROM g)
    SELECT *, none_picked + outside_picked + inside_wrong AS false_positives FROM n
""")
def agg_llm_confusion(v: Views) -> DataFrame:
    return evaluation.confusion(v.label_row, choices(v))


@query("srt_examples", "SELECT matched_by, id AS menu_id FROM menu WHERE matched_by IS NOT NULL QUALIFY row_number() OVER (PARTITION BY matched_by ORDER BY id) <= 5")
def srt_examples(v: Views) -> DataFrame:
    return evaluation.examples(v.menu.select(F.col("id").alias("menu_id"), "matched_by"), 5).select("matched_by", "menu_id")


@query("smp_seeded", "SELECT id FROM menu ORDER BY md5(concat('42-', CAST(id AS STRING))), id LIMIT 50")
def smp_seeded(v: Views) -> DataFrame:
    return evaluation.sample_rows(v.menu, "id", 50).select("id")


_SHEET = _ASKED + """, sheet AS (SELECT * FROM u ORDER BY md5(concat('42-', CAST(menu_id AS STRING))), menu_id LIMIT 50)
    SELECT CAST(row_number() OVER (ORDER BY menu_id) AS INT) AS row_no, menu_id, normalized_name, code AS code_1,
        CASE WHEN contains(normalized_name, 'red') THEN CASE WHEN code IS NULL THEN '' ELSE '1' END WHEN contains(normalized_name, 'blue') THEN 'D999-1-1' WHEN contains(normalized_name, 'hot') THEN '제외'
             WHEN normalized_name LIKE 'big %' THEN '0' ELSE '' END AS answer
    FROM sheet LEFT JOIN t USING (normalized_name)
"""


@query("snk_csv_label", _SHEET)
def snk_csv_label(v: Views) -> DataFrame:
    """The sheet written over an earlier one, in which the first food stood at place two and another order held."""
    rows = unmatched(v)
    shown = v.once("shown", lambda: top_of(v, rows).withColumn("label", food_label(F.col("food_name"), F.col("origin"), F.col("major_category"))))
    has = lambda w: F.contains("normalized_name", F.lit(w))
    answer = F.when(has("red"), "2").when(has("blue"), "1").when(has("hot"), " x ").when(F.col("normalized_name").startswith("big "), "0").otherwise("7")
    first = shown.filter("nth = 1").select(F.col("name").alias("normalized_name"), F.col("food_code").alias("code_2"))
    old = rows.groupBy("normalized_name").agg(F.min("menu_id").alias("row_no")).join(first, "normalized_name", "left").withColumns({"answer": answer, "code_1": F.lit("D999-1-1"), **{f"code_{i}": F.lit("") for i in range(3, 11)}})
    path = v.scratch("labels")
    upsert.write_csv(evaluation.label_sheet(rows, shown, old).select("row_no", "menu_id", "normalized_name", "answer", "candidate_1", "code_1"), path)
    back = v.spark.read.schema("row_no int, menu_id long, normalized_name string, answer string, candidate_1 string, code_1 string").csv(path, header=True, escape='"')
    return back.select("row_no", "menu_id", "normalized_name", F.coalesce("answer", F.lit("")).alias("answer"), "code_1")
