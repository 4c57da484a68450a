"""The pipeline's stages against brute-force versions, each on its own input."""

import public_tokenizers
import tiktoken

import corpus_pipeline
from codeloom.llm import byte_bpe, decontaminate, rule_cascade
from tests.llm.test_llm_operators import slow_components


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        kept = {r["doc_id"] for r in rows}
        if name != "byte_level_bpe":
            assert out.columns == columns
            assert kept <= {r["doc_id"] for r in before}
        if name == "quality_rules":
            for r in before:
                doc = rule_cascade.Doc((r["text"] or "").encode())
                assert (r["doc_id"] in kept) == (not any(rule(doc) for rule in rule_cascade.RULES.values()))
        elif name == "quality_classifier":
            good = [r["doc_id"] for r in before if labels.get(r["doc_id"]) == 1]
            assert sum(d in kept for d in good) >= 0.98 * len(good)
        elif name == "ngram_join":
            want = {c for _, _, c in slow_components([(r["doc_id"], r["text"]) for r in before])}
            assert kept == want and len(rows) == len(want)
        elif name == "decontamination":
            assert kept == {r["doc_id"] for r in before if not decontaminate.brute_force(r["text"], bench)[1]}
        else:
            ranks = byte_bpe.load_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY))
            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            by_id = {r["doc_id"]: r["text"] for r in before}
            assert all(r["input_ids"] == library.encode_ordinary(by_id[r["doc_id"]]) for r in rows) and len(rows) == len(before)
        docs = spark.createDataFrame(rows, docs.schema) if name != "byte_level_bpe" else docs


def test_run_and_empty_input(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
