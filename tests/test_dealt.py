"""What comes in one trigger is dealt to several files, just as many as the trigger takes."""

import glob

from tidemark.plans import boundary


def test_a_part_has_just_so_many_files(spark, tmp_path):
    for n, rows in enumerate((0, 1, 2, 1_000)):
        path = str(tmp_path / str(n))
        boundary.dealt(spark.range(rows).withColumnRenamed("id", "seq"), "seq", path, 4)
        assert len(glob.glob(f"{path}/part-*")) == 4
        assert spark.read.parquet(path).count() == rows
