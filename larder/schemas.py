"""Declared schemas of sources and tables; nothing is inferred."""

from __future__ import annotations

MENU = "struct<name: string, price: int>"
CRAWLED = f"name string, address string, raw_category string, source_url string, latitude double, longitude double, menus array<{MENU}>"
RESTAURANT = (
    "id long, name string, address string, cuisine string, source_url string, latitude double, longitude double, distance_to_main_gate int, distance_to_back_gate int, "
    "crawled_at timestamp, created_at timestamp, updated_at timestamp"
)
NUTRITION = "calories int, carbohydrate decimal(8,2), protein decimal(8,2), fat decimal(8,2), sodium decimal(8,2), source string, confidence decimal(4,3)"
MENUS = f"id long, restaurant_id long, name string, normalized_name string, price int, {NUTRITION}, official_food_code string, matched_by string"
FOOD = (
    "food_code string, food_name string, normalized_name string, origin string, major_category string, calories int, carbohydrate decimal(8,2), protein decimal(8,2), "
    "fat decimal(8,2), sodium decimal(8,2), serving_weight_raw string, company_name string, serving_basis string, representative_code string, representative_name string"
)
#: The food table's source as text, column by column.
FOOD_SOURCE = (
    "food_code string, food_name string, origin string, major_category string, serving_basis string, calories string, carbohydrate string, protein string, fat string, "
    "sodium string, serving_weight_raw string, company_name string, representative_code string, representative_name string"
)
ALIAS = "normalized_name string, food_code string, matched_by string, confidence decimal(3,2), model string, raw_answer string"
SYNONYM = "term string, food_type string"
MENU_FOOD_TYPE = "menu_id long, food_type string"
INBODY = (
    "id long, member_id long, weight decimal(6,2), muscle_mass decimal(6,2), body_fat_percentage decimal(6,2), bmr int, visceral_fat_level int, inbody_score int, "
    "measured_at date, uploaded_at date, protein_target decimal(8,2)"
)
MEMBER = "id long, goal string, exercise_count string, exercise_intensity string, birth_date date"
MEMBER_DISEASE = "member_id long, disease string"
VERTEX = "struct<x: double, y: double>"
OCR_RESPONSE = f"images array<struct<fields: array<struct<inferText: string, inferConfidence: double, boundingPoly: struct<vertices: array<{VERTEX}>>>>>>"
LABELS = "row_no int, menu_name string, normalized_name string, restaurant_name string, answer string"
