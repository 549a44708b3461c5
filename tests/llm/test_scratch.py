"""Scratch tables on a local disk."""

from pathlib import Path


def test_a_kept_table_has_no_checksum_files(spark, scratch):
    t = scratch.keep(spark.range(1000).repartition(3), "numbers")
    names = [p.name for p in Path(t._scratch_path.removeprefix("file://")).iterdir()]
    assert sum(n.startswith("part-") for n in names) == 3 and not [n for n in names if n.endswith(".crc")]
    assert t.agg({"id": "sum"}).collect()[0][0] == 499500
