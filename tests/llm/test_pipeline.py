"""The pipeline's stages against the operators' brute forces, and the guard of the entry point."""
import subprocess
import sys

import corpus_pipeline

SF = "/root/testdata/sf0.01"


def test_stages_keep_one_clean_document_of_each_group(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        made = stage(spark, docs, SF)
        assert made.columns == docs.columns
        docs = spark.createDataFrame(made.collect(), made.schema).repartition(5)
        kept[name] = [r.doc_id for r in docs.collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {d for d, q in labels.items() if q == 1}
    assert len(good - set(kept["quality"])) <= 0.01 * len(good)
    assert len(set(kept["near_duplicates"])) == len(kept["near_duplicates"]) < len(kept["quality"])
    assert sorted(kept["personal_data"]) == sorted(kept["near_duplicates"]) and set(kept["mixing"]) <= set(kept["personal_data"])


def test_run_packs_everything_the_mix_has(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {r.start for r in rows if r.length < 2048 and r.start == 0} == {0}
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048 and sorted(used) == list(range(len(used)))


def test_stages_on_odd_and_empty_tables(spark, clashing_docs):
    for docs in (clashing_docs, clashing_docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, SF)
            rows = made.collect()
            if name != "packing":
                assert made.schema.names == docs.schema.names and [f.dataType for f in made.schema] == [f.dataType for f in docs.schema]
            assert bool(rows) == (docs is clashing_docs)


def test_the_entry_point_works_without_the_package():
    code = ("import sys\nclass No:\n def find_spec(self, n, *a):\n  if n.startswith('cartflow.llm') or n == 'corpus_pipeline':\n   raise ModuleNotFoundError(n, name=n)\n"
            "sys.meta_path.insert(0, No())\nimport __spark_entry__ as E\nq = E.queries()\nassert 'submission' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q)")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rpartition("/")[0])
