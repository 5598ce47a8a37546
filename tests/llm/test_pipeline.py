from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline as P
from quillspark.llm import common
from quillspark.llm import op2_sentencepiece as op2

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    made = docs
    for k, (_, stage) in enumerate(P.STAGES):
        made = P.staged(stage(spark, made, SF))
        if k < len(P.STAGES) - 1:
            assert made.columns == docs.columns
    assert 0.7 * n < made.count() <= n
    whole = P.run(spark, SF)
    assert sorted(r["doc_id"] for r in whole.collect()) == sorted(r["doc_id"] for r in made.collect())
    row = whole.first()
    assert op2.decode_column(op2.load_vocabulary(), __import__("pyarrow").array([row["piece_ids"]])).to_pylist() == [row["text"]] and row["n_pieces"] == len(row["piece_ids"])


def test_planted(spark, tmp_path):
    rng = np.random.default_rng(3)
    source = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' AND n_chars BETWEEN 800 AND 4000").orderBy("doc_id").limit(40).collect()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows, kinds = [], {}

    def add(kind, text, lang="en"):
        kinds[len(rows)] = kind
        rows.append((len(rows), text, lang, "s", len(text) if text else None))

    for r in source[:20]:
        add("clean", r["text"])
    for r in source[:5]:
        add("copy", r["text"])
    for r in source[5:10]:
        words = r["text"].split(" ")
        words[int(rng.integers(len(words)))] = "changed"
        add("near", " ".join(words))
    add("leak", source[20]["text"] + " " + item)
    add("secret", source[21]["text"] + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end')
    add("junk", "12345 !!! 67890", None)
    add("junk", None, None)
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    got = {r["doc_id"]: r for r in P.run(spark, folder).collect()}
    by_kind = {k: [d for d in got if kinds[d] == k] for k in set(kinds.values())}
    assert not by_kind["copy"] and not by_kind["near"] and not by_kind["leak"] and not by_kind["junk"]
    assert len(by_kind["clean"]) == len({r["text"] for r in source[:20]})
    assert len(by_kind["secret"]) == 1 and "24be64" not in got[by_kind["secret"][0]]["text"]


@pytest.mark.parametrize("stage", [s for _, s in P.STAGES], ids=[n for n, _ in P.STAGES])
def test_empty(spark, stage):
    assert stage(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(0), SF).count() == 0


@pytest.mark.parametrize("step", ["staged", "cut"])
def test_freed_memory_goes_back(spark, step):
    """Native memory that the driver's JVM has freed, but for pieces in between, is the system's again after a step."""
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    held = lambda: int(re.search(r"\nAnonymous:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1])
    getattr(common, step)(spark.range(1))
    made = [spark._jvm.java.util.zip.Deflater() for _ in range(2500)]
    for k, x in enumerate(made):
        if k % 20:
            x.end()
    before = held()
    getattr(common, step)(spark.range(1))
    assert before - held() > 40_000
