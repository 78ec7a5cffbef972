import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from rankweave.llm.oracles import ORACLES  # noqa: E402
from rankweave.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, found.fetchall()))


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages_on_awkward_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.where("lang = 'en' and length(text) > 400").first().text
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    odd = spark.createDataFrame(
        [(10_001, None, "en", "src1", 0), (10_002, "", "en", "src1", 0), (10_003, "123 ***", "en", None, 0),
         (None, text, None, None, None), (10_004, text + " " + item, "en", "src2", 5), (10_005, text, "en", "src3", 6),
         (10_005, text, "en", "src3", 6)], docs.schema)
    rows = docs.unionByName(odd)
    columns = rows.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, SF)
        seen[name] = [r.asDict() for r in rows.collect()]
        if name != "shards":
            assert rows.columns == columns
        rows = spark.createDataFrame(rows.collect(), rows.schema)
    ids = {name: {r["doc_id"] for r in got} for name, got in seen.items()}
    assert not {10_001, 10_002, 10_003} & ids["language"] and 10_004 in ids["language"]
    same = [r for r in seen["near duplicates"] if r["text"] == text]
    assert len(same) == 1
    assert 10_004 in ids["near duplicates"] and 10_004 not in ids["benchmark"]
    assert ids["mix"] == {r["doc_id"] for r in seen["shards"]}
    assert len(seen["shards"]) == len(seen["mix"])


def test_pipeline_on_an_empty_table(spark, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_with_clashing_columns_and_a_very_long_text(spark):
    words = "the of and to in that is was for with his they have this from".split()
    texts = [" ".join(words[(i * 7 + j * (i + 3)) % len(words)] for j in range(30 + i)) for i in range(24)] + ["very long text " * 60_000]
    rows = [(i, t, "en", f"src{i % 3}", len(t), f"r{i}", i, i + 1, "h", -i, "p", 0.5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `row` string, fp long, root long, "
                                 "__hash string, __order long, p string, score double")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF)
        if name != "shards":
            assert kept.columns == docs.columns
        got = kept.collect()
        assert len(got) >= len(texts) and 24 in {r["doc_id"] for r in got}
        if name != "shards":
            own = {r["doc_id"]: r for r in docs.collect()}
            assert all(r == own[r["doc_id"]] for r in got)
        kept = spark.createDataFrame(got, kept.schema)
