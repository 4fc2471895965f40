"""Word lists, codes and label tables the results depend on."""

UNDEFINED = "undefined"

# Subject id -> subject label.
SUBJECTS = {
    1: "english",
    2: "mathematics",
    3: "programming",
    4: "russian",
    5: "socials",
    6: "history",
    7: "physics",
    8: "biology",
    9: "chemistry",
    10: "informatics",
    11: "nature",
    12: "computer_literacy",
    13: "ecology",
    14: "summer_program",
}

# School levels that keep their name; all others are undefined.
SCHOOL_LEVELS = ("grade_1_4", "middle_school", "high_school")

# Fixed values: (subject label, school level) -> product.
PRODUCTS = {
    ("english", "grade_1_4"): "english_primary_school",
    ("english", "middle_school"): "english_middle_school",
    ("english", "high_school"): "english_exam",
    ("mathematics", "grade_1_4"): "math_primary_school",
    ("mathematics", "middle_school"): "math_middle_school",
    ("mathematics", "high_school"): "math_exam",
    ("programming", "grade_1_4"): "programming_primary_school",
    ("programming", "middle_school"): "programming_middle_school",
    ("russian", "grade_1_4"): "russian_primary_school",
    ("russian", "middle_school"): "russian_middle_school",
    ("russian", "high_school"): "russian_exam",
    ("socials", "middle_school"): "socials_middle_school",
    ("socials", "high_school"): "socials_exam",
    ("history", "middle_school"): "history_middle_school",
    ("history", "high_school"): "history_exam",
    ("physics", "middle_school"): "physics_middle_school",
    ("physics", "high_school"): "physics_exam",
    ("biology", "middle_school"): "biology_middle_school",
    ("biology", "high_school"): "biology_exam",
    ("chemistry", "middle_school"): "chemistry_middle_school",
    ("chemistry", "high_school"): "chemistry_exam",
    ("informatics", "high_school"): "informatics_exam",
    ("nature", "grade_1_4"): "nature",
    ("computer_literacy", "grade_1_4"): "computer_literacy",
    ("summer_program", "grade_1_4"): "summer_program",
    ("ecology", "grade_1_4"): "ecology",
}

# Products known by name only, not by subject id.
PRODUCTS_WITHOUT_ID = {("summer_program", "grade_1_4"), ("ecology", "grade_1_4")}

PRODUCTS_BY_ID = {
    (code, level): PRODUCTS[label, level]
    for code, label in SUBJECTS.items()
    for level in SCHOOL_LEVELS
    if (label, level) in PRODUCTS and (label, level) not in PRODUCTS_WITHOUT_ID
}

# Payment text keyword -> subject id, first hit wins.
PAYMENT_KEYWORDS = (("англ", 1), ("матем", 2))
PAYMENT_KEYWORDS_PAID = (("англ", 1), ("математ", 2))
PAID_TEXT_WORDS = ("математ", "английск")
TRIAL_TEXT_PREFIX = "Пробное занятие"

# Page text -> page label, first hit wins.
PAGE_LABELS = (
    ("tilda", "tilda_tests"),
    ("gatsby", "gatsby_tests"),
    ("http://localhost:", "localhost_tests"),
    ("slot-select", "slot_select"),
    ("trial-lesson-sign-up", "trial-lesson-sign-up"),
)

# Names of test records, in lower case.
TEST_LEAD_NAMES = ("test", "тест")
TEST_STUDENT_NAMES = ("test", "тест", "донна", "методист")

# Fixed values: (page test, page texts, launch time, launch day counts itself).
# "{site}" stands for the host of the landing site.
LAUNCHES = (
    ("contains", ("english2", "programming2"), "2022-06-01 00:00:00", True),
    ("endswith", ("{site}/",), "2022-06-13 17:00:00", False),
    ("endswith", ("{site}/tutors/", "{site}/math-school/"), "2022-06-15 10:25:00", False),
    ("contains", ("{site}/middle-school/",), "2022-06-29 16:00:00", False),
    ("endswith", ("{site}/primary-school/",), "2022-07-22 10:00:00", False),
    ("endswith", ("{site}/english/", "{site}/programming/"), "2022-07-20 00:00:00", False),
    ("endswith", ("{site}/russian/",), "2022-08-01 00:00:00", False),
    ("endswith", ("{site}/it-base/",), "2022-08-11 00:00:00", False),
)
FUNNEL_TAG = "funnel"

# Enrolment types and lead types.
BY_USER = "by_user"
BY_OPERATOR = "by_operator"
LEAD_TYPES = (
    "by_user: new",
    "by_user: current",
    "by_operator: funnel_page_new_lead",
    "by_operator: not_funnel_page_new_lead",
    "by_operator: rescheduled_lead",
    "by_operator: other",
)

# School level -> name shown in reports.
SCHOOL_TYPES = {"grade_1_4": "primary", "middle_school": "middle", "high_school": "high"}

# Traffic categories shown in reports; all others are undefined.
TRAFFIC_TYPES = ("internal", "external", "organic", "floctory", "telemarketing")

# Attribution columns, without their _request / _lead ending.
TAGS = (
    "utm_medium",
    "utm_source",
    "utm_campaign",
    "utm_term",
    "utm_content",
    "traffic_source",
    "external_source_type",
)
