"""Labelling queries: a whole table is labelled, then counted per label."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import views as V
from queries.registry import query
from stagewise.functions import columns as C
from stagewise.functions import vocab
from stagewise.operators import labelling as L
from stagewise.operators import rules as R
from stagewise.operators.stages import exclude_test_records

def n():
    return F.count(F.lit(1)).alias("n")



@query("json_explode", """
SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1
""")
def json_explode(spark, d):
    items = L.explode_json(V.table(spark, d, "events"), "props", "struct<k:int>", ["event_id"])
    return items.groupBy(F.col("item.k").alias("k")).agg(n())


@query("keyword_class", """
SELECT CASE WHEN contains(p_name, 'small') THEN 1 WHEN contains(p_name, 'red') THEN 2
            WHEN contains(p_name, 'gear') THEN 3 END AS code, count(*) AS n
FROM part GROUP BY 1
""")
def keyword_class(spark, d):
    words = [("small", 1), ("red", 2), ("gear", 3)]
    return L.with_keyword_class(V.table(spark, d, "part"), "p_name", words).groupBy("code").agg(n())


@query("code_map", f"""
WITH {V.VIEWS_SQL}, labelled AS (
  SELECT {V.SUBJECT_SQL.format('lead_k % 17')} AS label FROM lead_v)
SELECT label, CASE label {' '.join(f"WHEN '{s}' THEN {c}" for c, s in vocab.SUBJECTS.items())} ELSE 0 END AS code_back,
       count(*) AS n
FROM labelled GROUP BY 1, 2
""")
def code_map(spark, d):
    """Code to label and back, both with their defaults."""
    leads = V.lead(spark, d).withColumn("code17", F.expr("lead_k % 17"))
    labelled = L.with_code_label(leads, "code17", vocab.SUBJECTS, vocab.UNDEFINED)
    back = {label: c for c, label in vocab.SUBJECTS.items()}
    return L.with_code_label(labelled, "label", back, 0, out="code_back").groupBy("label", "code_back").agg(n())


@query("code_map_table", """
SELECT coalesce(r_name, 'undefined') AS label, count(*) AS n
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1
""")
def code_map_table(spark, d):
    """The same lookup against a table instead of a fixed vocabulary."""
    nation = V.table(spark, d, "nation").join(
        V.table(spark, d, "region"), F.expr("n_regionkey = r_regionkey")).select("n_nationkey", "r_name")
    suppliers = V.table(spark, d, "supplier")
    return L.with_code_label(suppliers, "s_nationkey", nation, vocab.UNDEFINED).groupBy("label").agg(n())


@query("pair_map", """
SELECT CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'returned'
            WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'open' ELSE 'undefined' END AS label, count(*) AS n
FROM lineitem GROUP BY 1
""")
def pair_map(spark, d):
    pairs = {("A", "F"): "returned", ("N", "O"): "open"}
    items = V.table(spark, d, "lineitem")
    return L.with_pair_label(items, "l_returnflag", "l_linestatus", pairs).groupBy("label").agg(n())


_PRODUCT_CASE = " ".join(f"WHEN '{s}/{g}' THEN '{p}'" for (s, g), p in vocab.PRODUCTS.items())


@query("product_map", f"""
WITH {V.SOURCES_SQL}
SELECT CASE subject || '/' || grade_kind {_PRODUCT_CASE} ELSE 'undefined' END AS label, count(*) AS n
FROM s_landing_leads GROUP BY 1
""")
def product_map(spark, d):
    leads = V.sources(spark, d).landing_leads
    return L.with_pair_label(leads, "subject", "grade_kind", vocab.PRODUCTS).groupBy("label").agg(n())


@query("school_level", f"""
WITH {V.SOURCES_SQL}
SELECT CASE WHEN grade_kind IN ('grade_1_4', 'middle_school', 'high_school') THEN grade_kind ELSE 'undefined' END
         AS label, count(*) AS n
FROM s_lessons GROUP BY 1
""")
def school_level(spark, d):
    return V.sources(spark, d).lessons.groupBy(C.school_level(F.col("grade_kind")).alias("label")).agg(n())


_PATH = "CASE WHEN contains(url, '?') THEN substring(url, 1, position('?' IN url) - 1) ELSE url END"


@query("canonical_page", f"""
WITH p AS (SELECT url, {_PATH} AS path FROM pages)
SELECT CASE WHEN contains(path, 'spam-farm') THEN 'spam' WHEN contains(path, 'blog.') THEN 'blog'
            WHEN right(path, 1) = '/' THEN path ELSE path || '/' END AS page, count(*) AS n
FROM p GROUP BY 1
""")
def canonical_page(spark, d):
    labels = [("spam-farm", "spam"), ("blog.", "blog")]
    return L.with_canonical_page(V.table(spark, d, "pages"), "url", labels).groupBy("page").agg(n())


@query("canonical_page_literal", f"""
WITH p AS (SELECT url, {_PATH} AS path FROM pages)
SELECT CASE WHEN right(path, 1) = '/' AND NOT contains(url, '?') THEN path ELSE path || '/' END AS page, count(*) AS n
FROM p GROUP BY 1
""")
def canonical_page_literal(spark, d):
    """A slash before a query string is kept and doubled."""
    return L.with_canonical_page(V.table(spark, d, "pages"), "url", strict=False).groupBy("page").agg(n())


@query("rule_flag", f"""
WITH p AS (SELECT page_id, {_PATH} AS path, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * (page_id * 2220 % 2592000) AS seen_at FROM pages),
lp AS (SELECT seen_at, CASE WHEN right(path, 1) = '/' THEN path ELSE path || '/' END AS page,
              CASE WHEN page_id % 9 = 0 THEN 'a funnel b' END AS tag FROM p)
SELECT CASE WHEN contains(page, 'blog.') AND CAST(seen_at AS DATE) >= DATE '2024-01-05' THEN 1
            WHEN (right(page, 6) = '/853/' OR contains(page, '/en/')) AND seen_at > TIMESTAMP '2024-01-20 12:00:00' THEN 1
            WHEN contains(tag, 'funnel') THEN 1 ELSE 0 END AS rule_flag, count(*) AS n
FROM lp GROUP BY 1
""")
def rule_flag(spark, d):
    """All pages, seen at times spread over a month, by rules of page and launch time or a tag word."""
    pages = L.with_canonical_page(V.table(spark, d, "pages"), "url")
    seen = pages.withColumns(
        {
            "seen_at": F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, page_id * 2220 % 2592000)"),
            "tag": F.expr("CASE WHEN page_id % 9 = 0 THEN 'a funnel b' END"),
        }
    )
    rules = [
        L.PageRule("contains", ("blog.",), "2024-01-05 00:00:00", by_day=True),
        L.PageRule("contains", ("/en/",), "2024-01-20 12:00:00"),
        L.PageRule("endswith", ("/853/",), "2024-01-20 12:00:00"),
    ]
    return L.with_rule_flag(seen, "page", "seen_at", "tag", rules).groupBy("rule_flag").agg(n())


@query("page_rule_label", f"""
WITH p AS (SELECT page_id, {_PATH} AS path, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * (page_id * 2220 % 2592000) AS seen_at FROM pages),
lp AS (SELECT seen_at, CASE WHEN right(path, 1) = '/' THEN path ELSE path || '/' END AS page FROM p)
SELECT CASE WHEN contains(page, 'blog.') AND CAST(seen_at AS DATE) >= DATE '2024-01-05'
                 AND seen_at < TIMESTAMP '2024-01-15 00:00:00' THEN 'blog'
            WHEN (right(page, 5) = '/853/' OR contains(page, '/en/')) AND seen_at > TIMESTAMP '2024-01-20 12:00:00' THEN 'late'
            WHEN starts_with(page, 'https://blog.') THEN 'other_blog'
            WHEN contains(page, 'a') THEN 'any' ELSE 'none' END AS label, count(*) AS n
FROM lp GROUP BY 1
""")
def page_rule_label(spark, d):
    """All pages labelled by rows of a rule table: the smallest priority whose time has come and not passed."""
    pages = L.with_canonical_page(V.table(spark, d, "pages"), "url")
    seen = pages.withColumn(
        "seen_at", F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, page_id * 2220 % 2592000)")
    )
    rows = [
        (4, "contains", "a", None, None, False, "any"),
        (3, "startswith", "https://blog.", None, None, None, "other_blog"),
        (2, "contains", "/en/", "2024-01-20 12:00:00", None, False, "late"),
        (2, "endswith", "/853/", "2024-01-20 12:00:00", None, False, "late"),
        (1, "contains", "blog.", "2024-01-05 08:00:00", "2024-01-15 00:00:00", True, "blog"),
    ]
    table = spark.createDataFrame(rows, R.PAGE_RULES.replace("timestamp", "string"))
    times = {c: F.col(c).cast("timestamp") for c in ("starts", "ends")}
    return R.with_rule_label(seen, "page", "seen_at", table.withColumns(times), "none").groupBy("label").agg(n())


@query("exclude_tests", f"""
WITH {V.SOURCES_SQL}
SELECT 'leads' AS kind, count(*) AS n FROM s_landing_leads WHERE lower(name) NOT IN ('test', 'тест') OR name IS NULL
UNION ALL SELECT 'students', count(*) FROM s_students WHERE lower(first_name) NOT IN ('test', 'тест', 'донна', 'методист')
UNION ALL SELECT 'payments', count(*) FROM s_payments WHERE coalesce(testing, false) = false AND amount > 1
UNION ALL SELECT 'lessons', count(*) FROM s_lessons WHERE kind NOT IN (2, 5, 6)
""")
def exclude_tests(spark, d):
    src = V.sources(spark, d)
    kept = {
        "leads": exclude_test_records(src.landing_leads, names={"name": (vocab.TEST_LEAD_NAMES, True)}),
        "students": exclude_test_records(src.students, names={"first_name": (vocab.TEST_STUDENT_NAMES, False)}),
        "payments": exclude_test_records(src.payments, false_flags=["testing"], floors={"amount": 1}),
        "lessons": exclude_test_records(src.lessons, kinds={"kind": (2, 5, 6)}),
    }
    out = None
    for kind, rows in kept.items():
        counted = rows.agg(n()).select(F.lit(kind).alias("kind"), "n")
        out = counted if out is None else out.unionByName(counted)
    return out
