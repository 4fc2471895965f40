import random
import zlib

import pytest

from stagewise.llm.toxicity import Lexicon, fit, fold, held_out, score_toxicity


def test_fold():
    assert fold("Ïdiót, 1D10T! $cum іdіоt​") == " idiot idiot scum idiot "
    assert fold(None) == fold(" \n") == "  "


@pytest.mark.parametrize(
    "text",
    ["loser", "ｌｏｓｅｒ", "ＬＯＳＥＲ", "𝐥𝐨𝐬𝐞𝐫", "𝕃𝕆𝕊𝔼ℝ", "𝟏０𝟻𝚎r", "1oser", "ioser", "Ioser", "|oser", "lo$er", "lo$ér"],
)
def test_look_alikes(text):
    """Each is found by an entry written in letters, and as such among other words."""
    lexicon = Lexicon({" loser ": 1.0}, threshold=0.1)
    assert fold(text) == fold("loser")
    assert lexicon.density(text) == 1.0 and lexicon.density(f"a {text}, b") == pytest.approx(1 / 3)


def test_dollars():
    assert fold("a$$hole") == fold("a＄＄hole") == fold("asshole")
    assert fold("a$$ @$$ bitche$ $cum $1ut") == fold("ass ass bitches scum slut")
    assert fold("a $ b $$$ c") == " a b c "


def test_bars():
    """A bar is a letter or a separator, whichever finds more."""
    lexicon = Lexicon({" loser ": 1.0, " idiot ": 1.0})
    assert lexicon.density("|idiot|loser|") == 1.0 and lexicon.density("an |diot") == 0.5
    assert lexicon.density("a | b") == 0.0 and fold("a | b") == " a b "


def test_hits_exceptions_and_length():
    lexicon = Lexicon({" clown ": 2.0, " lowe": 1.0, " loweig": 3.0}, ["clown fish"], threshold=0.5)
    assert [e for _, e, _ in lexicon.hits(fold("A clown. The Clown fish; loweige"))] == [" clown ", " loweig"]
    assert lexicon.density("clown a b c") == 0.5 and lexicon.score(0.5) == 0.5
    assert lexicon.density("clown fish") == 0.0
    assert lexicon.density("clownish") == 0.0
    assert Lexicon({}).density("clown") == 0.0


def test_odd(odd, empty):
    lexicon = Lexicon({" three ": 1.0}, threshold=0.01)
    rows = score_toxicity(odd, lexicon).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted for r in rows) == 2
    assert score_toxicity(empty, lexicon).collect() == []


@pytest.fixture
def corpus(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(1500):
        words = [r.choice(vocabulary) for _ in range(r.randrange(5, 80))]
        toxic = i % 6 == 0
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["idiot", "1di0t", "schlimmx", "schlimmy"]))
        elif i % 10 == 1:
            words += ["idiot", "proof"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), 1))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    lexicon = fit(docs, labels, lift=3.0)
    assert "idiot proof" in lexicon.exceptions
    got = score_toxicity(docs, lexicon).join(labels, "doc_id").withColumn("held_out", held_out("doc_id")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    test = [r for r in got if r.held_out]
    assert sum(r.predicted == r.toxic for r in test) / len(test) >= 0.97


def test_no_labels(corpus):
    docs, labels = corpus
    assert fit(docs, labels.limit(0)).weights == {}
