import os
from types import SimpleNamespace

from voxtide import tables


def test_written_tables_survive_their_source_and_can_be_cleared(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir", None)
    src = str(tmp_path / "src")
    spark.range(5).write.parquet(src)
    df = tables.materialize(spark.read.parquet(src), "t")
    for f in os.listdir(src):
        os.remove(f"{src}/{f}")
    assert df.count() == 5
    folder = tables.shared_dir(spark)
    assert os.path.isdir(f"{folder}/voxtide") and spark.conf.get("spark.checkpoint.dir", None) == before
    tables.clear(spark)
    assert not os.path.exists(f"{folder}/voxtide/{spark.sparkContext.applicationId}")


def test_the_named_folder_is_taken():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: "hdfs://x/shared/" if key == "spark.checkpoint.dir" else default))
    assert tables.shared_dir(session) == "hdfs://x/shared"
