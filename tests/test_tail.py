"""A growing, rotated log: each line once, over appends, renames, truncation and restarts."""

import os

from dnstide.sources.tail import TailReader, tail
from dnstide.streaming import jobs


def follow(spark, tmp_path, start="beginning", part_bytes=1 << 20):
    """Run the stream over what is there, and give all lines so far."""
    stream = tail(spark, f"file://{tmp_path}/log", "query*", start, part_bytes)
    jobs.start(stream, f"file://{tmp_path}/out-{start}", f"file://{tmp_path}/state-{start}", {"availableNow": True}, mode="append").awaitTermination()
    out = tmp_path / f"out-{start}"
    return sorted(r.value for r in spark.read.parquet(f"file://{out}").collect()) if out.exists() else []


def add(path, *lines, end="\n"):
    with open(path, "a") as f:
        f.write("\n".join(lines) + end)


def test_lines_once(spark, tmp_path):
    (tmp_path / "log").mkdir()
    log = tmp_path / "log" / "query.log"
    add(log, "a1", "a2")
    add(tmp_path / "log" / "other", "not followed")
    assert follow(spark, tmp_path, "end") == []
    assert follow(spark, tmp_path) == ["a1", "a2"]
    add(log, "a3", "a4 is not wh", end="")
    assert follow(spark, tmp_path) == ["a1", "a2", "a3"]
    add(log, "ole")
    os.rename(log, tmp_path / "log" / "query.log.1")
    add(log, "b1")
    add(tmp_path / "log" / "query.log.1", "a5")
    want = ["a1", "a2", "a3", "a4 is not whole", "a5", "b1"]
    assert follow(spark, tmp_path) == want
    assert follow(spark, tmp_path, "end") == want[2:]
    with open(log, "w"):  # cut in its place
        pass
    add(log, "c1", "c2")
    os.remove(tmp_path / "log" / "query.log.1")
    assert follow(spark, tmp_path) == want + ["c1", "c2"]
    assert follow(spark, tmp_path) == want + ["c1", "c2"]


def test_parts(spark, tmp_path):
    """Lines of many lengths, empty ones too, are read once wherever a file is cut."""
    (tmp_path / "log").mkdir()
    lines = [f"{i}:" + "x" * (i * 7 % 50) for i in range(500)] + ["", "é" * 40, ""]
    add(tmp_path / "log" / "query", *lines)
    for n in (1, 2, 37, 100):
        reader = TailReader({"path": str(tmp_path / "log"), "partbytes": str(n)})
        found = [x for p in reader.partitions({}, reader.latestOffset()) for b in reader.read(p) for x in b.column(0).to_pylist()]
        assert found == lines
    assert follow(spark, tmp_path, part_bytes=3000) == sorted(lines)
