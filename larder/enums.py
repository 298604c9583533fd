"""Fixed values of the domain: enumerations in their declared order, word lists and thresholds.

Order matters where a position is a rank.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------------------------------------------------
CUISINES = ("KOREAN", "CHINESE", "JAPANESE", "WESTERN", "ASIAN", "SNACK", "CAFE_DESSERT", "ETC")
CAFE = "CAFE_DESSERT"
FOOD_TYPES = ("MEAT", "NOODLE", "RICE", "SOUP", "SNACK", "SALAD", "SEAFOOD", "FRIED", "DESSERT", "PIZZA", "SANDWICH")
#: Pushes shorter keywords aside without being a tag.
BLOCKER = "-"
#: Why a menu is in a search result, best first; the position is the rank.
MATCH_REASONS = ("MENU_NAME", "RESTAURANT_NAME", "REPRESENTATIVE_FOOD", "FOOD_TYPE_TAG")
GOAL_CALORIES = {"LOSS": -500, "MAINTAIN": 0, "GAIN": 300}
EXERCISE_FACTOR = {"NONE": 1.2, "ONE_TO_TWO": 1.375, "THREE_TO_FOUR": 1.55, "FIVE_TO_SIX": 1.725}
INTENSITY_FACTOR = {"LOW": 0.95, "MEDIUM": 1.0, "HIGH": 1.05}
LEAST_CALORIES = 1200
#: (share of calories, kcal per gram)
CARBOHYDRATE_SHARE, PROTEIN_SHARE, FAT_SHARE = (0.5, 4), (0.3, 4), (0.2, 9)
DISEASES = ("GASTROESOPHAGEAL_REFLUX", "HYPERTENSION", "DIABETES", "HYPERLIPIDEMIA")
#: By weight, heaviest first.
DISEASE_PRIORITY = ("DIABETES", "HYPERTENSION", "HYPERLIPIDEMIA", "GASTROESOPHAGEAL_REFLUX")
#: First and second issue of each disease.
DISEASE_ISSUES = {
    "DIABETES": ("CARBOHYDRATE_SUGAR", "DIETARY_FIBER"),
    "HYPERTENSION": ("SODIUM", "SATURATED_FAT"),
    "HYPERLIPIDEMIA": ("FAT", "DIETARY_FIBER"),
    "GASTROESOPHAGEAL_REFLUX": ("FAT", "IRRITATING_FOOD"),
}
FALLBACK_ISSUES = ("CALORIE", "CARBOHYDRATE", "FAT")
CARDS = 3
ISSUE_LABELS = {
    "PROTEIN": "단백질",
    "CARBOHYDRATE_SUGAR": "탄수화물·당류 관리",
    "DIETARY_FIBER": "식이섬유",
    "SODIUM": "나트륨 제한",
    "SATURATED_FAT": "포화지방 관리",
    "FAT": "지방 관리",
    "IRRITATING_FOOD": "자극적인 음식 회피",
    "CALORIE": "칼로리",
    "CARBOHYDRATE": "탄수화물",
}
#: (issues that ask for it, nutrient, greatest value without warning per 100 g, message), in the order of the messages.
WARNINGS = (
    (("SODIUM",), "sodium", 600, "나트륨 함량이 높은 메뉴예요"),
    (("FAT",), "fat", 15, "지방 함량이 높은 메뉴예요"),
    (("CARBOHYDRATE_SUGAR", "CARBOHYDRATE"), "carbohydrate", 40, "탄수화물 함량이 높은 메뉴예요"),
    (("CALORIE",), "calories", 250, "칼로리가 높은 메뉴예요"),
)
#: Conditions per 100 g, all of which must hold.
NUTRITION_FILTERS = {
    "HIGH_PROTEIN": (("protein", ">=", 11),),
    "LOW_CARB": (("carbohydrate", "<=", 20),),
    "HIGH_CARB": (("carbohydrate", ">=", 40),),
    "LOW_SODIUM": (("sodium", "<=", 120),),
    "LOW_FAT": (("fat", "<=", 3),),
    "REFLUX_SAFE": (("fat", "<=", 5), ("sodium", "<=", 400)),
}
METHOD_CONFIDENCE = {"EXACT": 1.00, "BRAND_EXACT": 1.00, "EDIT": 0.95, "BRAND_EDIT": 0.95, "BRAND_STRUCT": 0.90, "STRUCT": 0.85, "NGRAM": 0.70, "LLM": 0.80}
#: Words that an origin must all hold to have this rank; others come last.
ORIGIN_RANKS = (("외식", "분석"), ("외식",), ("분석",))
EDIT_LEAST, NGRAM_LEAST, SHORTLIST = 0.90, 0.65, 50
CONTAIN_LEAST_LENGTH, CONTAIN_LEAST_RATIO = 2, 0.5
#: A food's representative name counts in search from this confidence on.
RELIABLE_CONFIDENCE = 0.85
KEYWORD_TOKENS = 5
GATES = {"MAIN_GATE": (37.579132, 126.923488), "BACK_GATE": (37.5807266, 126.9244188)}
EARTH_RADIUS_M = 6_371_000
WALK_METRES_A_MINUTE = 75
STALE_DAYS = 14
TREND_ROWS, TREND_ROWS_EXPANDED = 4, 12
#: Hints for a category's food type, the first that the category's name holds.
CATEGORY_HINTS = (
    ("밥", "RICE"), ("죽", "RICE"), ("면", "NOODLE"), ("만두", "SNACK"), ("국", "SOUP"), ("탕", "SOUP"), ("찌개", "SOUP"), ("전골", "SOUP"), ("튀김", "FRIED"), ("구이", "MEAT"),
    ("육류", "MEAT"), ("생채", "SALAD"), ("무침", "SALAD"), ("샐러드", "SALAD"), ("젓갈", "SEAFOOD"), ("빵", "DESSERT"), ("과자", "DESSERT"), ("빙과", "DESSERT"), ("유제품", "DESSERT"),
)
ABSTAIN_WORDS = ("없음", "없다", "해당없음", "none", "null", "n/a")
EXCLUDE_ANSWERS = ("제외", "x", "X")
PRICE_PLACEHOLDERS = ("가격문의", "가격 문의", "시가", "품절", "품절중")
#: Label texts, window of dx and dy from the label's centre, and value range of each item on a scan.
OCR_ITEMS = {
    "muscle_mass": (("골격근량",), (250, 600), (0, 50), (10, 60)),
    "body_fat_percentage": (("체지방률", "체지방를"), (500, 650), (0, 50), (5, 60)),
    "bmr": (("기초대사량",), (180, 300), (-20, 20), (500, 3000)),
    "visceral_fat_level": (("내장지방레벨",), (0, 60), (30, 80), (1, 20)),
    "inbody_score": (("인바디점수", "인바디 점수"), (80, 220), (40, 120), (0, 100)),
}
OCR_WEIGHT_LABEL, OCR_WEIGHT_LABEL_Y, OCR_WEIGHT_DX, OCR_WEIGHT_DY = "체중", (800, 1200), (250, 600), (0, 50)
# ----------------------------------------------------------------------------------------------------------------------
