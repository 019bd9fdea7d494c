"""CSV files with line breaks in cells: the same rows however the file is split."""

import csv
import io
import random

import pytest

from wardflow.operators import cleaning as C
from wardflow.sources.csv_files import csv_records


def made(path, n, ending="\n"):
    rng = random.Random(n)
    rows = [[str(k), *("".join(rng.choices(['a', 'é', ',', '"', '\n', ' ', ';', ''], k=rng.randint(1, 8))) + "x" for _ in range(3))] for k in range(n)]
    out = io.StringIO()
    csv.writer(out, lineterminator=ending).writerows([["ref", "on\ntwo", "b", "c"], *rows])
    with open(path, "w", newline="", encoding="utf-8-sig") as f:
        f.write(out.getvalue())
    return rows


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_same_rows_at_any_split(spark, tmp_path, ending):
    want = made(tmp_path / "in.csv", 3000, ending)
    size = (tmp_path / "in.csv").stat().st_size
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for splits in (1, 16):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // splits + 1))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            assert spark.read.text(f"file://{tmp_path}/in.csv").rdd.getNumPartitions() >= splits
            got = C.read_csv(spark, f"file://{tmp_path}/in.csv")
            assert got.columns == ["ref", "on two", "b", "c", "_long"]
            assert sorted((list(r)[:4] for r in got.collect()), key=lambda r: int(r[0])) == want
            assert [r.record for r in csv_records(spark, f"file://{tmp_path}/in.csv").orderBy("record").collect()] == list(range(1, 3002))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_several_files_and_an_open_quote(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"x\ny"\n\n2,z\n')
    (tmp_path / "b.csv").write_text('k,v\n3,"never\nends\n')
    got = sorted((r.k, r.v) for r in C.read_csv(spark, f"file://{tmp_path}").collect())
    assert got[:2] == [("1", "x\ny"), ("2", "z")] and len(got) == 3 and got[2][0] == "3"
