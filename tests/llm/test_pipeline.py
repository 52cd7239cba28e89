import json
from pathlib import Path

import corpus_pipeline
from weftline.llm import queries


def test_stages_in_order(spark, docs, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_near_dedup", "personal_data", "packing"]
    table = docs.select("doc_id", "text", "lang", "source", "n_chars")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    now, counts = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.columns == table.columns, name
        out.write.parquet(str(tmp_path / f"stage{i}"))
        now = spark.read.parquet(str(tmp_path / f"stage{i}"))
        counts.append(now.select("doc_id").distinct().count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 20
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.select("doc_id", "start", "ids_crc32").exceptAll(now.select("doc_id", "start", "ids_crc32")).count() == 0
    assert whole.count() == now.count()


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))


def test_nothing_else_imports_the_subpackage():
    root = Path(corpus_pipeline.__file__).parent
    for p in (root / "weftline").rglob("*.py"):
        if "llm" not in p.parts:
            text = p.read_text()
            assert "weftline.llm" not in text and ".llm" not in text, p
    assert json.dumps(sorted(queries.QUERIES))


def test_tables_can_be_released(spark):
    from weftline.llm.common import materialise, release

    release(spark)
    kept = materialise(spark.range(5), "t")
    assert kept.count() == 5 and release(spark) == 1 and release(spark) == 0
