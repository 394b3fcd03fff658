"""The stages in order against a brute-force version, on a small folder of tables."""

import corpus_pipeline
import pytest
from tripweave.llm import queries
from tests.llm.test_decontamination import shingles
from tests.llm.test_exact_dedup import lower
from tests.llm.test_simhash import fingerprint, roots


@pytest.fixture
def folder(docs, spark, prose, tmp_path):
    item = " ".join(prose(30, 1))
    table = [(i, " ".join(prose(80, 100 + i)), "en") for i in range(30)]
    table += [(50, table[3][1].upper(), "en"), (51, table[4][1], "en"), (60, "12 34", None), (61, None, None)]
    table += [(70, table[5][1] + " end", "en"), (80, " ".join(prose(50, 7)) + " " + item, "en")]
    docs(*table).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), table, item


def test_pipeline(spark, folder):
    path, table, item = folder
    left = {i: t for i, t, _ in table if any(c.isalpha() for c in t or "")}
    last = {lower(t): i for i, t in sorted(left.items())}
    left = {i: t for i, t in left.items() if last[lower(t)] == i}
    prints = {i: fingerprint(t) for i, t in left.items()}
    near = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3]
    left = {i: left[i] for i in set(roots(near, prints).values())}
    wanted = shingles(item)
    left = {i: t for i, t in left.items() if len(shingles(t) & wanted) < 0.8 * len(wanted)}
    got = corpus_pipeline.run(spark, path)
    assert {r.doc_id: r.decoded for r in got.collect()} == left


def test_stages_keep_the_columns(spark, folder):
    path, _, _ = folder
    given = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, given, path).columns == given.columns
        assert stage(spark, given.limit(0), path).count() == 0


def test_registered_names():
    names = queries.queries()
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)] + ["pipeline"]
    assert set(queries.oracle_sql()) <= set(names)
