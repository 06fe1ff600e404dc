"""Chunks written by a data source: files closed by rows or bytes, a manifest that equals a count of the files."""

import json
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkloom.functions.tokens import estimated_row_bytes
from sparkloom.sources import chunks

SCHEMA = "k int, source string, n_tokens int, tokens array<int>"


@pytest.mark.parametrize(("rows", "size"), [(7, 10**9), (10**6, 900), (5, 700), (1, 1)])
def test_manifest_equals_files(spark, tmp_path, rows, size):
    rng = random.Random(rows)
    data = [(k, rng.choice(["a", "bb", None, ""]), n := rng.choice([None, 0, 3, 100]), list(range(n or 0))) for k in range(120)]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    path = str(tmp_path / "c")
    chunks.write_token_chunks(df, path, rows, size)
    told = json.loads((tmp_path / "c/manifest.json").read_text())
    assert sum(f["rows"] for f in told["files"]) == told["docs"] == 120 and told["tokens"] == sum(n or 0 for _, _, n, _ in data)
    for f in told["files"]:
        own = pq.read_table(f"{path}/{f['name']}").to_pylist()
        sizes = [int((2 * (r["n_tokens"] or 0) + len(r["source"] or "") + 24) * 1.3) for r in own]
        assert f["rows"] == len(own) <= rows and f["bytes"] == sum(sizes) and sum(sizes[:-1]) < size
        assert f["tokens"].get("a", 0) == sum(r["n_tokens"] or 0 for r in own if r["source"] == "a") and f["docs"].get("", 0) == sum(not r["source"] for r in own)
    # All but the last file of a task were closed for a reason.
    assert sum(f["rows"] < rows and f["bytes"] < size for f in told["files"]) <= 3
    back = chunks.read_token_chunks(spark, path, df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    estimate = df.where("n_tokens is not null and source is not null").agg(F.sum(estimated_row_bytes(F.col("n_tokens"), F.col("source")))).first()[0]
    assert estimate == sum(int((2 * n + len(s) + 24) * 1.3) for _, s, n, _ in data if n is not None and s is not None)


def test_left_over_files_and_refusals(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2, [1, 2])], SCHEMA)
    path = tmp_path / "c"
    path.mkdir()
    pq.write_table(pq.read_table(write_one(spark, df, tmp_path / "other")), path / "part-left-over.parquet")
    chunks.write_token_chunks(df, str(path))
    assert chunks.read_token_chunks(spark, str(path), df.schema).count() == 1
    for bad in (lambda: chunks.write_token_chunks(df, str(path)), lambda: chunks.write_token_chunks(df.drop("source"), str(tmp_path / "d")), lambda: chunks.write_token_chunks(df, str(tmp_path / "e"), 0)):
        with pytest.raises(Exception, match="manifest|missing|at least"):
            bad()
    with pytest.raises(FileNotFoundError):
        chunks.read_token_chunks(spark, str(tmp_path / "none"), df.schema)
    chunks.write_token_chunks(df.limit(0), str(tmp_path / "empty"))
    assert chunks.read_token_chunks(spark, str(tmp_path / "empty"), df.schema).count() == 0


def write_one(spark, df, at):
    df.coalesce(1).write.parquet(str(at))
    return str(next(at.glob("*.parquet")))
