"""The scan of transcripts: large files are read in many tasks, with the numbers that their lines have."""

import json
import random

from pyspark.sql import functions as F

from threadwell.sources import transcripts


def test_lines_of_a_split_file(spark, tmp_path):
    rng = random.Random(0)
    folder = tmp_path / "-w-app"
    folder.mkdir()
    written = {}
    for name, n, end in (("big", 4000, "\n"), ("dos", 700, "\r\n"), ("small", 3, "\n"), ("last", 500, "\n"), ("empty", 0, "\n")):
        lines = [rng.choice(["", "x" * rng.randint(0, 90), json.dumps({"type": "user", "n": i, "é": "ü" * rng.randint(0, 30)})]) for i in range(n)]
        (folder / f"{name}.jsonl").write_bytes(end.join(lines).encode() + (b"" if name == "last" else end.encode() * (n > 0)))
        written[name] = lines
    written["last"] = written["last"][: max(i for i, x in enumerate(written["last"]) if x) + 1]  # blank lines at an open end
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        lines = transcripts.scan(spark, str(tmp_path))
        rows = lines.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name, want in written.items():
        mine = sorted((r.line_no, r.value) for r in rows if r.session_id == name)
        got = [v for _, v in mine]
        assert [i for i, _ in mine] == list(range(len(mine)))
        assert got == want or name == "last" and got[: len(want)] == want and not any(got[len(want) :])
    assert {r.project for r in rows} == {"-w-app"} and len({r.task for r in rows if r.session_id == "big"}) > 5
