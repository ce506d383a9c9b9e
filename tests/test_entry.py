import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "documents", "benchmark"


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["set_stat_by_source", "n_split_fragments", "pair_weights_full", "set_symdiff_size", "terminal_ends", "degree_by_side", "unitigs_directed", "kmer_count_canonical_k15"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got, sql = entry.queries()[name](spark, DATA), con.execute(f"SELECT * FROM ({entry.oracle_sql()[name]}) LIMIT 5000000")
    columns = [c[0] for c in sql.description]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(sql.fetchall())


def test_the_rest_works_without_the_training_data_operators(monkeypatch):
    for name in [n for n in sys.modules if n.startswith(("strandset.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "strandset.llm", None)
    bare = importlib.reload(entry)
    try:
        assert "set_stat" in bare.queries() and not [n for n in bare.queries() if n.startswith("op") or n == "pipeline"]
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_an_error_inside_the_training_data_operators_is_not_swallowed(monkeypatch):
    for name in [n for n in sys.modules if n.startswith(("strandset.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tiktoken", None)
    try:
        with pytest.raises(ImportError):
            importlib.reload(entry)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def _ring_tables():
    """Documents whose words hold a ring, a hairpin and a path of 3,000 words."""
    import random

    r = random.Random(2)
    long = "".join(r.choice("abcd") for _ in range(3000))
    texts = ["acgtacgtacgtacgtacgtacgtacgtacgt", "gtaagtaagtaagtaagtaagtaa", long, "acgttgcatccaggtaccttgaggtacctggatgcaacgt"]
    return [(i, f"src{i % 2 + 1}", t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("name", ["unitigs_canonical", "unitigs_directed"])
def test_rings_and_long_paths_equal_their_sql(spark, tmp_path, name):
    con = duckdb.connect()
    spark.createDataFrame(_ring_tables(), "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, sql = entry.queries()[name](spark, str(tmp_path)), con.execute(entry.oracle_sql()[name])
    assert sorted(map(tuple, got.select(*[c[0] for c in sql.description]).collect())) == sorted(sql.fetchall())
