"""Sources, sinks, streaming, estimator and command line."""

import numpy as np
import pytest

from bitloom import cli
from bitloom.estimator import BitClusters, UnpackedBitClusters
from bitloom.operators.cluster import Params
from bitloom.sources import npy, smiles
from bitloom.sources.fake import fake_fingerprints
from bitloom.streaming.online import OnlineClusters, assign_stream


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("fps")
    rows = fake_fingerprints(100, 128, 4)
    for k, (a, z) in enumerate([(0, 30), (30, 31), (31, 100)]):
        np.save(d / f"fps.{k}.npy", rows[a:z])
    return d, rows


def words(rows):
    return rows.view(">i8").astype(np.int64).tolist()


def test_npy_scan_gather_and_reshape(spark, folder):
    d, rows = folder
    df = npy.read_npy(spark, str(d)).cache()
    assert [r.words for r in df.orderBy("fp_id").collect()] == words(rows)
    info = npy.file_ranges(npy.file_info(spark, str(d))).orderBy("path").collect()
    assert [(r.rows, r.start, r.stop, r.valid) for r in info] == [(30, 0, 30, True), (1, 30, 31, True), (69, 31, 100, True)]
    assert npy.read_npy(spark, str(d), max_rows=10).count() == 21
    ids = spark.createDataFrame([(5,), (30,), (99,)], "fp_id long")
    assert [r.words for r in npy.gather(df, ids).collect()] == [words(rows)[i] for i in (5, 30, 99)]
    with pytest.raises(IndexError):
        npy.gather(df, spark.createDataFrame([(100,)], "fp_id long"))
    assert [r["count"] for r in npy.split(df, parts=3).groupBy("part").count().orderBy("part").collect()] == [34, 34, 32]
    with pytest.raises(ValueError):
        npy.split(df)
    mixed = npy.shuffle(df, 1).orderBy("fp_id").collect()
    assert [r.fp_id for r in mixed] == list(range(100)) and sorted(r.words for r in mixed) == sorted(words(rows))
    assert npy.merge([df, df]).agg({"fp_id": "max"}).first()[0] == 199


def test_npy_sink_and_errors(spark, folder, tmp_path):
    d, rows = folder
    npy.write_npy(npy.read_npy(spark, str(d)), str(tmp_path / "out"), 128)
    assert np.load(tmp_path / "out" / "000000.npy").tolist() == rows.tolist()
    npy.write_npy(npy.read_npy(spark, str(d)), str(tmp_path / "parts"), 128, 40)
    assert [len(np.load(f)) for f in sorted((tmp_path / "parts").glob("*.npy"))] == [40, 40, 20]
    np.save(tmp_path / "bad.npy", np.zeros(4))
    with pytest.raises(ValueError):
        npy.read_npy(spark, str(tmp_path / "bad.npy"))
    with pytest.raises(ValueError):
        npy.read_npy(spark, str(d), n_features=256)


def test_smiles(spark, tmp_path):
    (tmp_path / "a.smi").write_text("CCO\nnot valid!\nc1ccccc1\n")
    lines = smiles.read_smiles(spark, str(tmp_path / "a.smi"))
    assert [r.smiles for r in lines.orderBy("idx").collect()] == ["CCO", "not valid!", "c1ccccc1"]
    assert smiles.read_smiles(spark, str(tmp_path / "a.smi"), 2).count() == 2
    fps = smiles.fps_from_smiles(lines, n_features=256, skip_invalid=True)
    assert [r.fp_id for r in smiles.invalid_ids(fps).collect()] == [1] and smiles.valid(fps).count() == 2
    found = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "fp_id long, label long")
    smiles.write_assignments(found, str(tmp_path / "csv"), lines)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["assignments", "smiles"]
    with pytest.raises(ValueError):
        smiles.write_assignments(found.limit(1), str(tmp_path / "csv2"), lines)


def test_stream(spark, folder, tmp_path):
    d, _ = folder
    df = npy.read_npy(spark, str(d)).select("fp_id", "words")
    for k in range(2):
        df.where(f"fp_id % 2 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = OnlineClusters(spark, str(tmp_path / "store"), 128, Params(0.5))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store.start(stream, str(tmp_path / "ck"), available_now=True).awaitTermination()
    rows = store.clusters(2).collect()
    assert sorted(i for r in rows for i in r.ids) == list(range(100))
    store.add(df.where("fp_id % 2 = 1"), 1)  # a repeated batch changes nothing
    assert sum(r.n for r in store.clusters(2).collect()) == 100


def test_estimator(spark, folder):
    d, rows = folder
    df = npy.read_npy(spark, str(d)).select("fp_id", "words")
    e = BitClusters(threshold=0.4, nFeatures=128)
    model = e.fit(df)
    assert e.getOrDefault(e.branchingFactor) == 50
    out = model.transform(df)
    assert out.count() == 100 and "prediction" in out.columns
    assert model.distances(df).count() == 100 * model.clusters.count() and model.features_out()[0] == "cluster1"
    nearest = {r.fp_id: r.label for r in assign_stream(df, model.centroids()).collect()}
    assert nearest == {r.fp_id: r.prediction for r in out.collect()}
    bits = spark.createDataFrame([(i, [int(x) for x in b]) for i, b in enumerate(np.unpackbits(rows, axis=1))], "fp_id long, bits array<int>")
    same = UnpackedBitClusters(threshold=0.4, nFeatures=128).fit(bits)
    assert same.assignments().exceptAll(e.fit_predict(df)).count() == 0
    more = e.partial_fit(model, df.withColumn("fp_id", df.fp_id + 100))
    assert more.assignments().count() == 200


def test_command_line(spark, folder, tmp_path, capsys):
    d, _ = folder
    for command in ("run", "multiround"):
        cli.main([command, str(d), str(tmp_path / command), "--n-features", "128", "--refine-rounds", "1", "--bin-size", "2"], spark)
        assert spark.read.parquet(str(tmp_path / command / "assignments")).count() == 100
    cli.main(["summary", str(tmp_path / "run"), str(d), "--metrics"], spark)
    cli.main(["info", str(d)], spark)
    cli.main(["shuffle", str(d), str(tmp_path / "s"), "--seed", "1"], spark)
    cli.main(["split", str(d), str(tmp_path / "p"), "--parts", "2"], spark)
    assert "singletons" in capsys.readouterr().out
    with pytest.raises(Exception, match="(?i)exists"):
        cli.main(["run", str(d), str(tmp_path / "run"), "--n-features", "128"], spark)
