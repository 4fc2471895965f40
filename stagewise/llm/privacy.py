"""Personal data by patterns, and terms that give protected values away by co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import cut, read, texts

KINDS = ["email", "ip", "card", "phone"]
#: Patterns (fixed values, as the kinds are defined), written so that no repetition is tried
#: twice: a match starts at the first character of a run or right behind the match before.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}{3,}+"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Characters around a protected value that are its context.
RADIUS = 80
#: A term is disclosing from so many different texts that have it near one value, from this
#: share of all documents that have it, and from so many bits that it tells about the value.
TEXTS, SHARE, BITS = 3, 0.5, 6.0
#: Rows up to which a counted table is broadcast.
BROADCAST = 200_000
LABELS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": "<TERM>"}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the checksum: from the right, every second one doubled."""

    def value(c: Column, i: Column) -> Column:
        v = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), value)
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        n = F.length(_digits(x))
        return F.when((n >= 13) & (n <= 19), _luhn(_digits(x))).otherwise(False)
    if kind == "phone":
        n = F.length(_digits(x))
        return (n >= 9) & (n <= 15)
    return F.lit(True)


SPANS = "array<struct<s: int, e: int, v: string>>"


def spans(text: str, pattern: str, valid) -> Column:
    """Places of valid matches in code points, end exclusive, with what they match.

    Matches and the pieces between them alternate, so running sums of their lengths
    are the places. Only valid matches are kept on the way.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    pieces = F.split(F.col(text), pattern, -1)
    steps = F.zip_with(found, pieces, lambda m, p: F.struct(m.alias("m"), F.length(p).alias("gap"), F.length(m).alias("n"), valid(m).alias("ok")))
    # the piece behind the last match has no match
    steps = F.filter(steps, lambda x: x["m"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        one = F.array(F.struct(s.alias("s"), (s + x["n"]).alias("e"), x["m"].alias("v")))
        return F.struct((s + x["n"]).alias("at"), F.when(x["ok"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def base_spans(rows: DataFrame) -> DataFrame:
    """Add one array of spans per kind to rows with `text`."""
    nothing = F.array().cast(SPANS)
    needs = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    digit = F.col("text").rlike("[0-9]")
    for kind in KINDS:
        found = spans("text", PATTERNS[kind], lambda m, kind=kind: _valid(kind, m))
        rows = rows.withColumn(kind, F.when(needs.get(kind, digit), found).otherwise(nothing))
    return rows


def _each(kinds: list[str], make) -> Column:
    """One array of what `make(kind, span)` gives, kind by kind."""

    def of(kind: str) -> Column:
        return F.transform(kind, lambda x: make(kind, x))

    return F.flatten(F.array(*[of(k) for k in kinds]))


def _key(text: str = "text") -> list[Column]:
    """128 bits that tell texts apart."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.col(text), F.lit("other")).alias("k2")]


def _chosen(terms: DataFrame) -> DataFrame:
    """The table, to be broadcast if its counted size allows it."""
    return F.broadcast(terms) if terms.count() <= BROADCAST else terms


def disclosing_terms(docs: DataFrame, radius: int = RADIUS, least: int = TEXTS, share: float = SHARE, bits: float = BITS) -> DataFrame:
    """(k1, k2, terms): the disclosing terms of each text that has any.

    For a term t and a protected value e, over all N documents: n(t, e) have t within
    `radius` characters of e, n(t) have t, n(e) have e. P(e | t) is n(t, e) / n(t),
    and t tells log2(P(e | t) N / n(e)) bits about e. A term is disclosing if there is
    a value e that so many different texts have it near of, and for which P(e | t) and
    the bits reach their thresholds; every such pair is tested. Candidates come from
    the contexts; the documents of each term are summed up before the shuffle, and only
    these sums meet the candidates.
    """
    rows = docs.select("text", *_key())
    held = base_spans(rows.withColumn("row", F.monotonically_increasing_id()))
    kinds = _each(KINDS, lambda k, x: F.struct(F.lit(k).alias("kind"), F.lower(x["v"]).alias("value"), x["s"].alias("s"), x["e"].alias("e")))
    values = held.withColumn("x", F.explode(kinds))
    # with the neighbour on either side, if there is one: with it goes a word that the context cuts
    left = F.expr(f"substring(text, greatest(x.s - {radius + 1}, 0) + 1, least(x.s, {radius + 1}))")
    right = F.expr(f"substring(text, x.e + 1, {radius + 1})")
    left = F.when(F.col("x.s") > radius, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
    right = F.when(F.length(right) > radius, F.regexp_replace(right, r"\p{L}+\z", "")).otherwise(right)
    near = F.concat(left, F.lit(" "), right)
    near = F.array_distinct(F.regexp_extract_all(F.lower(near), F.lit(TERM), F.lit(0)))
    contexts = cut(values.select("row", "k1", "k2", "x.kind", "x.value", near.alias("terms")))
    of_value = contexts.groupBy("kind", "value").agg(F.count_distinct("row").alias("n_e"), F.count_distinct("k1", "k2").alias("texts"))
    n = rows.count()
    # of a value that more documents have, no term can tell so many bits
    of_value = of_value.filter((F.col("texts") >= least) & (F.log2(F.lit(float(n)) / F.col("n_e")) >= bits)).drop("texts")
    pairs = contexts.join(of_value, ["kind", "value"]).select("kind", "value", "n_e", "row", "k1", "k2", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("kind", "value", "n_e", "term").agg(F.count_distinct("row").alias("n_te"), F.count_distinct("k1", "k2").alias("texts"))
    pairs = cut(pairs.filter(F.col("texts") >= least).select("term", "n_te", "n_e"))
    candidates = cut(pairs.select("term").distinct())

    words = rows.select("k1", "k2", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    of_term = words.groupBy("term").agg(F.count("*").alias("n_t")).join(_chosen(candidates), "term")
    chance = F.col("n_te") / F.col("n_t")
    told = F.log2(chance * F.lit(float(n)) / F.col("n_e"))
    found = cut(pairs.join(of_term, "term").filter((chance >= share) & (told >= bits)).select("term").distinct())
    places = words.join(_chosen(found), "term").distinct()
    return places.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("term")).alias("terms"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """Every row with its whole text, the spans of each kind, and those of disclosing terms.

    Spans are arrays of (s, e, v): code points, end exclusive, and the text. Those of
    terms do not touch those of the kinds. Null text counts as empty and has no spans;
    equal texts have equal spans; repeated rows and null ids stay; an empty table gives
    no rows. Columns named in `extra` are passed on.
    """
    rows = texts(docs, id_col, text_col, **{f"extra_{i}": c for i, c in enumerate(extra)})
    plain = rows.withColumn("text", F.coalesce("text", F.lit("")))
    terms = _chosen(cut(disclosing_terms(plain)))
    rows = base_spans(plain.select("*", *_key())).join(terms, ["k1", "k2"], "left")
    found = spans("text", TERM, lambda m: F.array_contains(F.col("terms"), F.lower(m)))
    rows = rows.withColumn("found", F.when(F.col("terms").isNotNull(), found).otherwise(F.array().cast(SPANS)))
    held = F.concat(*KINDS)
    apart = lambda t: ~F.exists(held, lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"]))
    rows = rows.withColumn("term", F.filter("found", apart))
    return rows.select("doc_id", *[F.col(f"extra_{i}").alias(c) for i, c in enumerate(extra)], "text", *KINDS, "term")


def _listed(kinds: list[str]) -> Column:
    return F.array_join(_each(kinds, lambda k, x: F.concat(F.lit(f"{k}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans, and all spans as text."""
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.sha2(F.encode(_listed(KINDS), "UTF-8"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, _listed([*KINDS, "term"]).alias("spans"))


def sanitised(found: DataFrame) -> Column:
    """The text with every span generalised to a label; spans that overlap become one, with the label of the first, then the longest."""
    ordered = F.sort_array(_each([*KINDS, "term"], lambda k, x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), F.lit(LABELS[k]).alias("l"))))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"])
        moved = F.struct((-x["e"]).alias("at"), F.concat(acc["out"], F.array(gap, x["l"])).alias("out"))
        longer = F.struct(F.greatest(acc["at"], -x["e"]).alias("at"), acc["out"].alias("out"))
        return F.when(x["s"] >= acc["at"], moved).otherwise(longer)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return F.when(F.size(ordered) > 0, whole).otherwise(F.col("text"))


def op5_private_data(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents, and terms that give it away."""
    return digest(find_personal_data(read(spark, sf_dir, "documents")))
