"""Export of many .npy files."""

import uuid

import numpy as np
import pytest

from bitloom.sources import npy
from bitloom.sources.fake import fake_fingerprints


def jobs(spark, run):
    spark.sparkContext.setJobGroup(group := uuid.uuid4().hex, "npy")
    try:
        run()
    finally:
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found


@pytest.mark.parametrize(("size", "piece"), [(7, 4096), (7, 20), (50, 20), (1000, 64)])
def test_export_is_one_pass(spark, tmp_path, monkeypatch, size, piece):
    """As many jobs for many files as for one; files of several pieces, and pieces of several files."""
    rows = fake_fingerprints(220, 128, 4)
    df = spark.createDataFrame([(5 * i, w) for i, w in enumerate(rows.view(">i8").astype(np.int64).tolist())], "fp_id long, words array<long>").repartition(3)
    monkeypatch.setattr(npy, "PIECE", piece)
    assert jobs(spark, lambda: npy.write_npy(df, str(tmp_path / "out"), 128, size)) < 25
    files = sorted((tmp_path / "out").glob("*.npy"))
    assert [f.name for f in files] == [f"{k:06d}.npy" for k in range(-(-220 // size))]
    got = [np.load(f) for f in files]
    assert {len(g) for g in got[:-1]} <= {size} and (np.concatenate(got) == rows).all()
    assert npy.read_npy(spark, str(tmp_path / "out")).count() == 220
