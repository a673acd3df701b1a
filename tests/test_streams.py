from glob import glob

from pyspark.sql import functions as F

from quire.operators.admission import submit_uploads
from quire.plans.streams import q_stream_ingest
from quire.session import checkpoint_dir
from quire.streaming.files import drop_files, file_stream, files_per_drop, latest_per_key, run_available_now
from quire.streaming.inbox import inbox_stream, scan_inbox
from tests.conftest import SF_SMALL


def test_each_micro_batch_is_one_time_ordered_drop(spark):
    e = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "ts")
    folder = drop_files(e, "ts", 3, "t-drops")
    s = file_stream(spark, folder, e.schema)
    out = run_available_now(s, "t-drops")
    per = out.groupBy("batch_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"),
                                      F.count(F.lit(1)).alias("n")).orderBy("batch_id").collect()
    assert len(per) == 3
    assert sum(r.n for r in per) == e.count()
    assert all(per[i].hi <= per[i + 1].lo for i in range(len(per) - 1))
    assert files_per_drop(spark) >= 1


def test_latest_per_key_takes_last_batch(spark):
    u = spark.createDataFrame([("j", "queued", 0), ("j", "running", 1), ("k", "done", 0)],
                              "job_id string, status string, batch_id int")
    assert {r.job_id: r.status for r in latest_per_key(u, ["job_id"]).collect()} == {"j": "running", "k": "done"}


def _entries(checkpoint):
    """What a file stream's log says it has read."""
    return [x for f in glob(f"{checkpoint}/sources/0/[0-9]*") for x in open(f) if x.startswith("{")]


def test_ingest_leaves_the_names_of_uploads_off_the_driver(spark):
    """The file stream over the inbox kept one entry per upload."""
    at = checkpoint_dir(spark).removeprefix("file:")
    old = set(glob(f"{at}/ingest-ckpt-*"))
    assert q_stream_ingest(spark, SF_SMALL).count() == 200
    (new,) = set(glob(f"{at}/ingest-ckpt-*")) - old
    assert 0 < len(_entries(new)) <= 20


def test_an_upload_is_ingested_once_over_runs(spark, tmp_path):
    inbox, found = tmp_path / "in", f"file://{tmp_path}/found"
    (inbox / "a/b").mkdir(parents=True)

    def put(*names):
        for n in names:
            (inbox / n).write_bytes(n.encode())

    def run():
        scan_inbox(spark, f"file://{inbox}", found)
        out = []
        jobs = submit_uploads(inbox_stream(spark, found), f"file://{inbox}", '{"lang": "fr"}')
        q = (jobs.writeStream.foreachBatch(lambda b, _: out.extend((r.path, r.length, r.decision) for r in b.collect()))
             .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
        q.awaitTermination()
        return sorted(out)

    assert run() == []  # nothing there yet
    put("x.pdf", "a/x.pdf", "a/b/n %20é.txt", ".hidden.pdf", "_tmp.pdf")
    assert run() == [("a/b/n %20é.txt", 15, "skipped"), ("a/x.pdf", 7, "accepted"), ("x.pdf", 5, "accepted")]
    put("a/b/new.PDF")
    (inbox / "x.pdf").write_bytes(b"changed since")
    assert run() == [("a/b/new.PDF", 11, "accepted")]
    files = set((tmp_path / "found").iterdir())
    assert run() == [] and set((tmp_path / "found").iterdir()) == files


def test_a_large_folder_is_listed_in_parts(tmp_path, monkeypatch):
    """All entries of a folder were held at once."""
    from pyarrow import fs

    from quire.sources import listing

    monkeypatch.setattr(listing, "BATCH_ROWS", 10)
    for i in range(25):
        (tmp_path / f"{i}.md").write_text("x")
    (tmp_path / "d").mkdir()
    parts = list(listing._entries(fs.LocalFileSystem(), str(tmp_path)))
    assert [len(p) for p in parts] == [10, 10, 6]
    whole = fs.LocalFileSystem().get_file_info(fs.FileSelector(str(tmp_path)))
    assert sorted((x.path, x.size, x.mtime_ns) for p in parts for x in p) == sorted((x.path, x.size, x.mtime_ns) for x in whole)
