import hashlib
import math
import random
import re
from collections import Counter

import regex
from pyspark.sql import functions as F

from stagewise.llm.privacy import digest, disclosing_terms, find_personal_data, sanitised

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    v = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in v) % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    found = {k: [(m.start(), m.end()) for m in p.finditer(text or "") if ok(k, m[0])] for k, p in BASE.items()}
    joined = ",".join(f"{k}:{s}:{e}" for k, v in found.items() for s, e in v)
    return tuple(len(v) for v in found.values()) + (hashlib.sha256(joined.encode()).hexdigest(), joined)


BITS = ["a.b@c.de", "x@y", "@", "a@b.c.", "_q@z-z.w.v", "1.2.3.4", "256.1.1.1", "01.002.3.255", "1.2.3.4.5.6.7.8.9", "4111 1111 1111 1111", "4111-1111-1111-1112",
        "79927398713", "4", "-", " ", "+1 (988) 555-2485", "+49 30 1234567", "+1..2", "+", "é", "𝔘", "日本", "4337166598464399", ".", "0" * 30, "\n", "word", "+4337166598464399"]


def test_base_against_brute_force(spark):
    r = random.Random(4)
    docs = [(i, "".join(r.choice(BITS) + r.choice(["", "", " "]) for _ in range(r.randrange(25)))) for i in range(800)]
    got = digest(find_personal_data(spark.createDataFrame(docs, "doc_id long, text string"))).collect()
    want = {i: brute(t) for i, t in docs}
    assert len(got) == len(docs) and sum(sum(w[:4]) for w in want.values()) > 1000
    for row in got:
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone, row.base_sha256) == want[row.doc_id][:5], docs[row.doc_id]
        assert row.spans.startswith(want[row.doc_id][5])


def test_no_pattern_runs_away(spark):
    long = ["a" * 20_000, "1" * 20_000, "1 " * 10_000, "+1" + "(" * 20_000, "a." * 10_000 + "@", "1." * 10_000]
    got = digest(find_personal_data(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string"))).collect()
    assert len(got) == len(long)


def test_disclosing_terms(spark):
    r = random.Random(6)
    plain = lambda n: " ".join(r.choice(["the", "red", "house", "near", "sea", "tree"]) for _ in range(n))
    docs = [(i, f"{plain(30)} Zebulon writes from zeb@mail.org {plain(20)} {i}") for i in range(5)]
    docs += [(10 + i, f"{plain(30)} {i} number") for i in range(400)] + [(900, "only zebulon here"), (901, f"{plain(20)} far {plain(40)} x@y.z")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    terms = {t for r in disclosing_terms(df).collect() for t in r.terms}
    assert terms == {"zebulon", "writes", "from"}
    found = find_personal_data(df)
    rows = {r.doc_id: r.out for r in found.withColumn("out", sanitised(found)).collect()}
    assert "<TERM> <TERM> <TERM> <EMAIL> " in rows[0] and rows[900] == "only <TERM> here" and rows[10] == docs[5][1]
    spans = {r.doc_id: r.spans for r in digest(found).collect()}
    assert spans[900] == "term:5:12" and spans[10] == ""
    # the same from SQL counts by hand: P(e|t) = 5 / 6, n(e) = 5, N = 407
    assert 5 / 6 >= 0.5 and 5 / 6 * 407 / 5 >= 2**6


def test_disclosing_beside_a_hot_value(spark):
    """Near a value of many documents, a term still gives away another one."""
    docs = [(i, f"- write to help@shop.org or to Zebulon at zeb@mail.org, number {i} -") for i in range(9)]
    docs += [(9, "- write to help@shop.org or to Zebulon, number 9 -")]
    docs += [(10 + i, f"- help@shop.org number {i} -") for i in range(290)] + [(300 + i, f"- {i} number -") for i in range(700)]
    found = disclosing_terms(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    # beside the hot value it is log2(1 * 1000 / 300) = 1.7 bits, beside the other log2(0.9 * 1000 / 9) = 6.6
    assert "zebulon" in {t for r in found for t in r.terms}


def test_words_at_the_ends_of_a_context(spark):
    """Only words that the context cuts are left out, not those at an end of the text or of the context."""
    docs = [(i, f"Zebulon: zeb@mail.org {i}") for i in range(5)] + [(10 + i, f"{i} yan@mail.org Yannick") for i in range(5)]
    # 80 characters before and behind the value begin or end with a whole word, or with a part of one
    gap = "=" * 73
    docs += [(20 + i, f"{i} Quentin{gap}que@mail.org{gap}Ruprecht") for i in range(5)]
    docs += [(30 + i, f"{i} Severin{gap[:-1]} sev@mail.org {gap[:-1]}Theresa {i}") for i in range(5)]
    docs += [(40 + i, f"{i} Ulrikes{gap}=uli@mail.org={gap}Viktors {i}") for i in range(5)]
    docs += [(100 + i, f"{i} number") for i in range(2000)]
    found = disclosing_terms(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {t for r in found for t in r.terms} == {"zebulon", "yannick", "quentin", "severin", "theresa"}


def test_odd(odd, empty):
    got = digest(find_personal_data(odd)).collect()
    assert len(got) == odd.count() and all(r.spans == "" for r in got)
    assert digest(find_personal_data(empty)).collect() == []


def test_sanitise_overlaps(spark):
    df = spark.createDataFrame([(1, "+4337166598464399 é a.b@1.2.3.4 end")], "doc_id long, text string")
    found = find_personal_data(df)
    assert found.select(sanitised(found).alias("t")).first().t == "+<CARD> é <EMAIL> end"
    assert found.select(F.size("ip")).first()[0] == 1


def test_sanitise_partial_overlap(spark):
    """What only the later of two overlapping spans holds goes as well."""
    df = spark.createDataFrame([(1, "to 4111 1111 1111 1111@x.com end a.b@c.de")], "doc_id long, text string")
    found = find_personal_data(df)
    row = found.select("card", "email", sanitised(found).alias("t")).first()
    assert [(x.s, x.e) for x in row.card] == [(3, 22)] and (18, 28) in [(x.s, x.e) for x in row.email]
    assert row.t == "to <CARD> end <EMAIL>"


def counted_terms(docs, radius=80, least=3, share=0.5, bits=6.0):
    """Disclosing terms by counting over texts with emails only."""
    word, email = regex.compile(r"\p{L}{3,}"), BASE["email"]
    near, has = {}, {}
    for row, text in docs:
        for m in email.finditer(text):
            left, right = text[max(m.start() - radius - 1, 0) : m.start()], text[m.end() : m.end() + radius + 1]
            left = regex.sub(r"^\p{L}+", "", left) if m.start() > radius else left
            right = regex.sub(r"\p{L}+\Z", "", right) if len(right) > radius else right
            has.setdefault(m[0].lower(), set()).add((row, text))
            for t in set(word.findall((left + " " + right).lower())):
                near.setdefault((t, m[0].lower()), set()).add((row, text))
    n_t = Counter(t for _, text in docs for t in set(word.findall(text.lower())))
    out = set()
    for (t, e), rows in near.items():
        chance = len(rows) / n_t[t]
        if min(len({x for _, x in rows}), len({x for _, x in has[e]})) >= least and chance >= share and math.log2(chance * len(docs) / len(has[e])) >= bits:
            out.add(t)
    return out


def test_disclosing_terms_by_brute_force(spark):
    r = random.Random(8)
    names = [f"{a}{b}" for a in ("Zeb", "Yan", "Que", "Sev", "Uli") for b in ("ulon", "nick", "ntin", "erin")]
    plain = lambda n: " ".join(r.choice(["the", "red", "house", "near", "sea", "tree", "Straße", "of"]) for _ in range(n))
    docs = []
    for i in range(900):
        name = r.choice(names)
        parts = [plain(r.randrange(25))]
        if r.random() < 0.15:
            parts += [name, plain(r.randrange(15)), f"{name.lower()}@mail.org", plain(r.randrange(15)), r.choice(names)]
        if r.random() < 0.02:
            parts += [name]
        docs.append((i, " ".join([*parts, plain(r.randrange(25)), str(i % 700)])))
    want = counted_terms(docs)
    found = disclosing_terms(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {t for x in found for t in x.terms} == want and 0 < len(want) < len(names)
