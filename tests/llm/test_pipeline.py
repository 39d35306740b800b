import corpus_pipeline
from gridscribe.llm import queries

from .helpers import docs, odd_rows, prose, with_clashing_columns


def test_stages_chain_and_take_effect(spark, tmp_path):
    item = prose(900, 30)
    rows = [(k, f"{prose(k, 60)}", "aa", "ab"[k % 2], 0) for k in range(80)]
    rows += [(100, prose(3, 60), "aa", "a", 0), (101, f"{prose(101, 40)} {item}", "aa", "a", 0), (102, f"{prose(102, 40)} mail me@example.org now", "aa", "b", 0)] + odd_rows()
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        path = str(tmp_path / name)
        out.write.parquet(path)
        frame = spark.read.parquet(path)
        seen[name] = frame.collect()
        if name != "mixing":
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {name: {r["doc_id"] for r in got} for name, got in seen.items()}
    assert not ids["language_id"] & {7, 8, 9} - {k for k in range(80)} and 3 in ids["language_id"]
    assert 100 not in ids["jaccard_join"] and 3 in ids["jaccard_join"]
    assert 101 in ids["jaccard_join"] and 101 not in ids["decontamination"]
    assert next(r["text"] for r in seen["pii"] if r["doc_id"] == 102).endswith("mail [EMAIL] now")
    assert len(seen["pii"]) == len(seen["decontamination"])
    assert all(0 < r["taken"] <= 2 * r["size"] for r in seen["mixing"])
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, seen["mixing"]))


def test_stages_keep_other_columns(spark, tmp_path):
    spark.createDataFrame([(1, prose(900, 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = with_clashing_columns(docs(spark, odd_rows() + [(50 + k, prose(k, 30), "aa", "s", 0) for k in range(20)])).drop("lang_pred", "size", "target", "taken", "source_size", "epochs")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns and out.count() > 0


def test_stages_on_nothing(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs(spark, []), str(tmp_path)).count() == 0


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
