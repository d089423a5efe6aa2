"""What a task holds at once, and that nothing is lost between its parts."""

import pyarrow as pa

from quarryspark.operators import extract
from quarryspark.sources import files


def test_files_are_read_some_bytes_at_a_time(spark):
    sizes = [300_000] * 20 + [5_000_000, 0, 300_000]
    rows = [(f"f{i}.txt", bytes([97 + i]) * n) for i, n in enumerate(sizes)] + [("none.txt", None)]
    batch = pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows]), pa.array([c for _, c in rows], pa.binary())], ["path", "content"])
    told = list(files.parts(iter([batch, batch.slice(0, 0), batch.slice(19)])))
    assert all(p.num_rows == 1 or sum(len(c or b"") for c in p.column("content").to_pylist()) <= files.PART_BYTES for p in told) and len(told) > 8
    assert [r for p in told for r in p.column("path").to_pylist()] == [p for p, _ in rows + rows[19:]]
    got = files.read_files(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert sorted((r["path"], r["page"], len(r["text"]), r["error"] is None) for r in got) == sorted((p, 1 if c is not None else 0, len(c or b""), c is not None) for p, c in rows)


def test_repeated_captions_are_read_once(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def rows(t):
        with open(calls, "a") as f:
            f.write(f"{t}\n")
        return [(t, i) for i in range(len(t))]

    asked = [(i, "ab" if i % 2 else "c" if i % 4 else "") for i in range(200)]
    df = spark.createDataFrame(asked, "id bigint, text string").coalesce(1)
    got = extract.table_function(df, "id bigint, t string, n int", ["id", "text"], rows, once=True).collect()
    assert sorted(map(tuple, got)) == sorted((i, t, n) for i, t in asked for n in range(len(t)))
    assert sorted(open(calls).read().split("\n")) == sorted(["", "", "ab", "c"])
