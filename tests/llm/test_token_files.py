import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from stagewise.llm import token_files as T
from stagewise.llm.tokens import vocabulary


@pytest.fixture(scope="module")
def ids_of():
    t = Tokenizer.from_file(vocabulary())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, T.END_ID]


@pytest.fixture
def docs(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "γάμμα", "42", "\n"]) for _ in range(r.choice([0, 3, 40, 700])))) for i in r.sample(range(-50, 400), 150)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(7)


def expected(docs, ids_of):
    rows = sorted(((r.doc_id, ids_of(r.text)) for r in docs.collect()), key=lambda x: x[0])
    start, out, stream = 0, [], []
    for i, ids in rows:
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start, stream = start + len(ids), stream + ids
    return out, stream


def test_sums_of_parts():
    r = random.Random(2)
    for _ in range(50):
        a, b = r.randbytes(r.randrange(40)), r.randbytes(r.choice([0, 1, 4, 300, 70_000]))
        assert T.crc_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("encoding,piece", [("dictionary", T.PIECE), ("delta", 50)])
def test_round_trip(spark, docs, ids_of, tmp_path, encoding, piece):
    to = str(tmp_path / "files")
    T.write_tokens(docs, to, encoding=encoding, piece=piece, shards=5, row_group=4096, page=1024, page_rows=20)
    want, stream = expected(docs, ids_of)
    assert sorted(tuple(r) for r in T.digests(spark, to).collect()) == want
    assert sorted(tuple(r) for r in T.document_table(spark, to).collect()) == [x[:3] for x in want]
    # places of the whole corpus
    for lo, hi in [(0, 1), (0, len(stream)), (100, 3000), (len(stream) - 7, len(stream) + 50), (5000, 5000), (len(stream), len(stream) + 9)]:
        got = [i for r in T.tokens_between(spark, to, lo, hi, piece).collect() for i in r.ids]
        assert got == stream[lo:hi], (lo, hi)
    chosen = [want[3][0], want[70][0]]
    rows = T.tokens_of(spark, to, chosen).orderBy("start").collect()
    assert [i for r in rows for i in r.ids] == [i for d, s, n, _ in want if d in chosen for i in stream[s : s + n]]


@pytest.mark.parametrize("encoding,used", [("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")])
def test_layout_of_files(spark, docs, tmp_path, encoding, used):
    to = str(tmp_path / "files")
    T.write_tokens(docs, to, encoding=encoding, piece=50, shards=2, row_group=4096, page=1024, page_rows=20)
    files = sorted((tmp_path / "files" / "tokens").rglob("*.parquet"))
    assert len(files) == 2
    for f in files:
        meta = pq.ParquetFile(f).metadata
        assert meta.num_row_groups > 1
        for g in range(meta.num_row_groups):
            columns = {c.path_in_schema: c for c in (meta.row_group(g).column(j) for j in range(meta.num_columns))}
            assert used in columns["ids.list.element"].encodings
            for name in T.META:
                assert "DELTA_BINARY_PACKED" in columns[name].encodings and columns[name].dictionary_page_offset is None
                assert columns[name].has_offset_index and columns[name].has_column_index
    # rows lie in the order of their places
    at = [x for f in files for x in pq.ParquetFile(f).read(columns=["at"]).column("at").to_pylist()]
    cut = [i for i, x in enumerate(at) if x == 0]
    assert len(cut) == 2 and at[: cut[1]] == sorted(at[: cut[1]])


def test_reads_are_selective(spark, docs, tmp_path):
    to = str(tmp_path / "files")
    T.write_tokens(docs, to, shards=3)
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "ids" not in plan(T.document_table(spark, to)).split("ReadSchema: struct<")[1].split(">")[0]
    assert "PushedFilters: [In(doc_id" in plan(T.tokens_of(spark, to, [1, 2]))
    for hi in (20, 10**6):
        between = plan(T.tokens_between(spark, to, 10, hi, piece=5)).split("== Physical Plan ==")[1]
        assert "PartitionFilters: [isnotnull(shard" in between
        assert "GreaterThan(at,5)" in between


def test_odd_and_empty(spark, odd, empty, ids_of, tmp_path):
    T.write_tokens(odd, str(tmp_path / "odd"), piece=100)
    got = sorted((tuple(r) for r in T.digests(spark, str(tmp_path / "odd")).collect()), key=lambda x: x[1])
    assert [x[0] for x in got] == [1, 2, 3, 4, 4, 5, 6, 7, None]
    start = 0
    texts = {r.doc_id: r.text for r in odd.collect()}
    for i, at, n, crc in got:
        ids = ids_of(texts[i])
        assert (at, n, crc) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n
    T.write_tokens(empty, str(tmp_path / "empty"))
    assert T.digests(spark, str(tmp_path / "empty")).collect() == []
    assert T.document_table(spark, str(tmp_path / "empty")).collect() == []
    with pytest.raises(ValueError):
        T.write_tokens(odd, str(tmp_path / "x"), encoding="plain")
