import random
import re

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stagewise.llm.tokens import vocabulary
from stagewise.llm.toxicity import fit
from tests.llm.test_decontamination import brute as contained
from tests.llm.test_jaccard_join import brute as grouped
from tests.llm.test_privacy import BASE, ok
from tests.llm.test_tokens import check_pieces

LABELS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}


def corpus(folder, spark):
    r = random.Random(11)
    vocabulary_ = [f"w{i}" for i in range(300)]
    words = lambda n: [r.choice(vocabulary_) for _ in range(n)]
    items = [(i, " ".join(words(20))) for i in range(5)]
    docs, labels = [], []
    for i in range(400):
        w = words(r.randrange(20, 120))
        toxic = i % 7 == 0
        if toxic:
            w.insert(3, r.choice(["idiot", "moron"]))
        if i % 11 == 1:
            w[5:5] = r.choice(items)[1].split()
        if i % 13 == 2:
            w[4] = r.choice([f"me.{i}@mail.org", "10.0.0.7", f"+49 30 12345{i}", "4111 1111 1111 1111"])
        if docs and i % 5 == 3:
            w = docs[r.randrange(len(docs))][1].split()
            if r.random() < 0.5:
                w[r.randrange(len(w))] = "edit"
        docs.append((i, " ".join(w)))
        labels.append((i, int("idiot" in w or "moron" in w), 1))
    docs += [(400, ""), (401, "one"), (402, "one")]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def masked(text):
    found = sorted((m.start(), -m.end(), LABELS[k]) for k, p in BASE.items() for m in p.finditer(text) if ok(k, m[0]))
    out, at = "", 0
    for s, e, label in found:
        if s >= at:
            out, at = out + text[at:s] + label, -e
    return out + text[at:]


def test_against_brute_force(spark, tmp_path):
    docs, items = corpus(tmp_path, spark)
    table = lambda n: spark.read.parquet(f"{tmp_path}/{n}.parquet")
    lexicon = fit(table("documents"), table("labels"))
    kept = [(i, t) for i, t in docs if lexicon.score(lexicon.density(t)) < 0.5]
    assert 300 < len(kept) < 360 and not any(re.search("idiot|moron", t) for _, t in kept)
    first = {c for _, _, c in grouped(kept)}
    kept = [(i, t) for i, t in kept if i in first]
    leaked = {i for i, *_ in contained(kept, items)}
    kept = [(i, t) for i, t in kept if i not in leaked]
    assert leaked and 150 < len(kept) < 320
    kept = {i: masked(t) for i, t in kept}
    t = Tokenizer.from_file(vocabulary())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_pieces(pieces, kept, lambda text: t.encode(text, add_special_tokens=False).ids)
    assert any("<EMAIL>" in x for x in kept.values())


def test_stages_keep_columns_and_odd_rows(spark, odd, tmp_path):
    corpus(tmp_path, spark)
    # the whole odd table, with columns that the stages use themselves
    clash = {"_row": F.lit(5), "rest_0": F.lit("r"), "component_id": F.lit(1), "email": F.lit("e")}
    docs = odd.withColumn("n_chars", F.col("n_chars").cast("long")).withColumns(clash)
    docs.write.parquet(f"{tmp_path}/odd.parquet")
    docs = spark.read.parquet(f"{tmp_path}/odd.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, str(tmp_path))
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            rows = out.collect()
            # the repeated row goes with its copy
            assert len(rows) == table.count() - (name == "jaccard_join" and len(rows) > 0), name
            assert all(r._row == 5 and r.rest_0 == "r" and r["n.x"] == 7 and r.email == "e" for r in rows), name


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "decontamination", "privacy", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
