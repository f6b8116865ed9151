import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline  # noqa: E402
import plain  # noqa: E402

from tidelake.llm import simhash  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    docs, kept = first, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "token_output":
            assert docs.columns == first.columns
        kept[name] = [tuple(r) for r in docs.collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r[0] for r in kept["quality"]}
    assert sum(labels[i] for i in labels if i in ids) >= 0.95 * sum(labels.values())
    fps = [simhash.fingerprint(r[1].encode()) for r in kept["near_duplicates"]]
    assert all((a ^ b).bit_count() > 3 for k, a in enumerate(fps) for b in fps[:k])
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r[0] for r in plain.op9([(r[0], r[1]) for r in kept["near_duplicates"]], bench) if not r[5]}
    assert {r[0] for r in kept["decontamination"]} == clean
    assert sorted(r[0] for r in kept["mix"]) == sorted(r[0] for r in kept["token_output"])
    assert max([r[0] for r in kept["mix"]].count(i) for i in clean) <= 3


def test_entry_lists_all_queries():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} <= {n.split("_")[0] for n in names}
    assert set(__spark_entry__.oracle_sql()) <= names
