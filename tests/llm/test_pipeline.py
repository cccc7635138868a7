"""The pipeline's stages, one after another, against what each promises on its own input."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from veilspark.llm import queries
from veilspark.llm.shared import shared_dir

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "mix", "encode"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        counts.append(docs.count())
        if name != "encode":
            assert docs.columns == columns and docs.schema["doc_id"].dataType == before.schema["doc_id"].dataType
        if name in ("language", "toxicity", "near_duplicates"):
            assert docs.join(before, "doc_id", "left_anti").count() == 0 and docs.select("doc_id").distinct().count() == counts[-1]
    assert counts[1] == counts[0] and counts[2] <= counts[1] and counts[3] < counts[2] and counts[5] == counts[4]
    assert set(docs.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_run_writes_every_stage(spark):
    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = {x.name for x in shared.iterdir()}
    got = corpus_pipeline.run(spark, SF)
    assert set(got.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert any("stage-mix" in f for f in got.inputFiles()) and got.count() > 0
    assert [x[:9] for x in {x.name for x in shared.iterdir()} - before] == ["stage-mix"]


def test_queries_leave_one_table(spark):
    shared = Path(shared_dir(spark).removeprefix("file://"))
    for name in ("op1_ann_search", "op2_mix_sources", "op6_near_dup", "op9_embed_dedup", "op10_token_counts", "op11_html_extract"):
        before = {x.name for x in shared.iterdir()}
        queries.QUERIES[name](spark, SF).count()
        assert len({x.name for x in shared.iterdir()} - before) == 1, name


def test_without_a_checkpoint_folder(tmp_path):
    """A bare local session writes to a folder of its own and leaves the setting alone."""
    script = f"""
import sys; sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from pyspark.sql import SparkSession
from veilspark.llm import queries
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert queries.op6_near_dup(spark, {SF!r}).count() == spark.read.parquet({SF!r} + "/documents.parquet").count()
print("done")
"""
    (tmp_path / "conf").mkdir()
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf")}, timeout=240)
    assert out.stdout.strip().endswith("done"), out.stderr[-2000:]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, 0), (None, "a text without a key", "en", "s", 20), (2, "", "en", None, 0), (3, "plain words of a text " * 9, None, "s", 99), (3, "other words of that key " * 9, None, "s", 99)]])
def test_pipeline_on_empty_and_odd_tables(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert len(got) <= 2 * len(rows)


def test_kept_rows_stay_once(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (1, "another text of this key", "c"), (2, text, "d"), (None, text, "e"), (None, text, "f"), (3, None, "g"), (3, "", "h")], "doc_id long, text string, repeat string")
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    rows = sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect())
    assert rows == sorted([(0, text), (0, text), (1, text), (1, "another text of this key"), (3, "")])


COLUMNS = {
    "op1_ann_search": "query_id:bigint rank:int vec_id:bigint score:double",
    "op2_mix_sources": "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint",
    "op3_license_scan": "doc_id:bigint n_words:bigint n_base:bigint first_word:bigint last_word:bigint base_labels:string labels:string score:double",
    "op4_byte_bpe": "doc_id:bigint n_tokens:bigint ids_sha256:string decoded_sha256:string",
    "op5_lm_score": "doc_id:bigint n_words:bigint log_score:double mean_log_score:double",
    "op6_near_dup": "doc_id:bigint class_id:bigint n_links:bigint kept:boolean",
    "op7_language_id": "doc_id:bigint held_out:boolean lang_pred:string score:double",
    "op8_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op9_embed_dedup": "vec_id:bigint n_links:bigint component_id:bigint kept:boolean",
    "op10_token_counts": "doc_id:bigint n_bytes:bigint n_tokens:bigint over_limit:boolean",
    "op11_html_extract": "page_id:bigint url:string text:string n_chars:bigint",
    "op12_filter_audit": "part:string filter_order:string step:int kept:bigint removed:bigint redundant:bigint unique_fails:bigint good_lost:bigint toxic_lost:bigint shapley:bigint",
    "op13_fill_in_middle": "doc_id:bigint n:bigint form:string prefix_chars:bigint middle_chars:bigint output_sha256:string restored_sha256:string",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    got = queries.QUERIES[name](spark, SF)
    types = dict(got.dtypes)
    assert {c: types.get(c) for c in (x.split(":")[0] for x in COLUMNS[name].split())} == dict(x.split(":") for x in COLUMNS[name].split())
    table = spark.read.parquet(f"{SF}/{'embeddings' if 'vec_id' in COLUMNS[name] else 'pages' if 'page_id' in COLUMNS[name] else 'documents'}.parquet")
    n = {"op1_ann_search": lambda: 20 * table.where("vec_id % 20 = 0").count(), "op12_filter_audit": lambda: 600 * table.select("lang").distinct().count()}.get(name, table.count)()
    assert got.count() == n


def test_registered_queries_run(spark):
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(names)
