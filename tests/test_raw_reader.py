"""Reading raw files: what the driver holds doesn't grow with them."""

import hashlib
import os

import pytest

from quantloom.sources import store


def written(spark, root, n):
    store.write_raw(spark.range(n).selectExpr("'s' || id % 3 AS source", "CAST(CAST(id AS STRING) AS BINARY) AS content"), root)


def test_partitions_are_those_of_folder_names(spark, tmp_path):
    for n in (20, 2000):
        written(spark, f"{tmp_path}/{n}", n)
    few, many = (store.raw_files(spark, f"{tmp_path}/{n}") for n in (20, 2000))
    assert few.rdd.getNumPartitions() == many.rdd.getNumPartitions() == 257
    assert {(r["content_hash"], r["path"].count("/")) for r in many.collect()} == {(hashlib.sha256(str(k).encode()).hexdigest(), 3) for k in range(2000)}


def test_foreign_files_and_missing_ones(spark, tmp_path):
    root = str(tmp_path / "store")
    with pytest.raises(Exception, match="no raw files below"):
        store.raw_files(spark, root).collect()
    written(spark, root, 3)
    os.makedirs(f"{root}/raw/s0/odd")
    for name in ("odd/x.txt", "odd/.x.txt.crc"):
        with open(f"{root}/raw/s0/{name}", "w") as out:
            out.write("x")
    assert store.raw_files(spark, root).count() == 4 and [r["path"] for r in store.corrupted(spark, root).collect()] == ["raw/s0/odd/x.txt"]
    with pytest.raises(Exception, match="no raw file of 00"):
        store.read_raw(spark, root, ["00" * 32]).collect()
