"""Files that a stream of snapshots writes."""

from dnstide.plans.queries import _stream
from dnstide.sources import history
from dnstide.sources.files import Folder
from dnstide.streaming import jobs


def test_one_file_an_hour(spark, sf_dir, tmp_path):
    """Each hour is one file of a batch, not one of each task of the state, and each day's rows of an hour are one."""
    path, table = f"file://{tmp_path}/counts", f"file://{tmp_path}/table"
    jobs.start_snapshots(jobs.stream_counts(_stream(spark, sf_dir)), path, table, f"file://{tmp_path}/state", {"availableNow": True}).awaitTermination()
    root = Folder(spark, path)
    hours = [x for x in root.names() if x.startswith("hour=")]
    files = [list((tmp_path / "counts" / x).rglob("*.parquet")) for x in hours]
    assert len(hours) > 100 and all(len(x) == 1 for x in files)
    assert len(list((tmp_path / "table").rglob("*.parquet"))) == len(hours)
    assert root.of("_raw").names() == []
    assert history.read(spark, table).count() > 0
