import collections

import duckdb
import sentencepiece

import corpus_pipeline
from plainfold.llm import mixing as M
from plainfold.llm import quality as Q
from plainfold.llm import sentencepiece_codec as P
from plainfold.llm import simhash as S

from .test_dedup import brute_near


def test_run_matches_brute_force(spark, tmp_path):
    """Every stage's decision again, over the documents that the stages before it keep."""
    sf = "/root/testdata/sf0.001"
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    con = duckdb.connect()
    con.sql(f"create table documents as select * from '{sf}/documents.parquet'")
    con.sql(f"create table kept as select d.* from documents d join ({Q.ORACLE}) q using (doc_id)")
    con.sql("create table single as select * from kept where doc_id in (select min(doc_id) from kept group by text)")
    rows = con.sql("select doc_id, text from single").df()
    prints = spark.createDataFrame(rows).select("doc_id", S.printed("text").alias("p")).select("doc_id", "p.a", "p.b", "p.kind").collect()
    gone = [i for i, keep, _ in brute_near(prints) if i != keep]
    con.sql("drop table documents")
    con.sql(f"create table documents as select * from single where doc_id not in (select unnest({gone or [-1]}))")
    want = {r[0] for r in con.sql(f"select doc_id from ({M.ORACLE})").fetchall()}
    assert set(out) == want and len(out) == len(want) > 0
    text = dict(con.sql("select doc_id, text from documents").fetchall())
    library = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    assert all(r.ids == library.encode(text[i]) and r.round_trip and r.n_tokens == len(r.ids) for i, r in out.items())


def test_stages_on_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for which, docs in enumerate((odd_docs, no_docs)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "")
            if k + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}-{which}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{which}")
        docs.collect()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and len({n for n, _ in corpus_pipeline.STAGES}) == len(corpus_pipeline.STAGES)


def test_driver_entries(spark):
    import __spark_entry__ as e

    names = collections.Counter(n.split("_")[0] for n in e.queries())
    assert all(names[f"op{k}"] == 1 for k in range(1, 11)) and "pipeline" in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
