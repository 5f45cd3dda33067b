"""On a cluster whose shared folder is named without a scheme: taken if tasks and driver see the same files."""

import os
from contextvars import ContextVar

import pyarrow.fs as pafs
import pytest

import corpus_pipeline
from gridlapse.llm import common, queries, substrings, warc
from gridlapse.plans import stage
from tests.llm.frames import documents, odd_rows, prose


@pytest.fixture
def cluster(spark, monkeypatch, tmp_path):
    """The session as it is on a cluster, with a mounted folder for what is staged."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(stage, "_BLOCK", ContextVar("staging", default=str(tmp_path)))
    return spark


def test_a_mounted_folder_is_taken(cluster, tmp_path):
    folder = common.fresh_folder(cluster, "things")
    assert folder.startswith(f"file:{tmp_path}/things-")
    assert os.listdir(tmp_path) == []  # what tasks wrote to find out is gone


def test_a_folder_that_the_driver_sees_otherwise_is_refused(cluster, monkeypatch, tmp_path):
    driver, where = os.getpid(), str(tmp_path)
    monkeypatch.setattr(common, "store", lambda uri: (pafs.LocalFileSystem(), f"{where}/{'driver' if os.getpid() == driver else 'tasks'}"))
    with pytest.raises(ValueError, match="local disk"):
        common.fresh_folder(cluster, "things")
    assert os.listdir(f"{where}/tasks") and not os.path.exists(f"{where}/driver")


def test_a_folder_that_tasks_cannot_write_to_is_refused(cluster, monkeypatch, tmp_path):
    (tmp_path / "file").write_text("")
    monkeypatch.setattr(stage, "_BLOCK", ContextVar("staging", default=str(tmp_path / "file")))
    with pytest.raises(ValueError, match="local disk") as refused:
        common.fresh_folder(cluster, "things")
    assert refused.value.__cause__ is not None


def test_token_records_of_the_pipeline(cluster, monkeypatch, tmp_path):
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-1:])
    documents(cluster, odd_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(cluster, str(tmp_path)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in found) == sorted((r[0] is not None, r[0] or 0) for r in odd_rows())


def test_repeated_strings(cluster):
    shared = prose(1, 150)
    rows = [(1, "a " + shared), (2, prose(2, 90)), (3, "b " + shared + " c"), (4, None)]
    found = {r.doc_id: (r.n_bytes, bytes(r.kept)) for r in substrings.remove_repeats(documents(cluster, rows)).collect()}
    assert found == {1: (len(rows[0][1]), b"a"), 2: (len(rows[1][1]), rows[1][1].encode()), 3: (len(rows[2][1]), b"b c"), 4: (0, b"")}


def test_archives(cluster, tmp_path):
    rows = [(1, "u1", "x" * 200), (2, None, "x" * 200), (3, "u3", None)]
    manifest = warc.archive(cluster.createDataFrame(rows, "page_id long, url string, html string"))
    assert all(r.path.startswith(f"file:{tmp_path}/warc-") for r in manifest.collect())
    found = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.verified) for r in warc.read_archives(manifest).collect()]
    assert sorted(found) == [(1, 200, "response", None, True), (2, 200, "revisit", 1, True), (3, 0, "response", None, True)]


def test_token_records(cluster, tmp_path):
    rows = [(3, "three words here"), (1, "one"), (2, None)]
    documents(cluster, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((r.doc_id, r.start) for r in queries.op5_token_records(cluster, str(tmp_path)).collect())
    assert [f[0] for f in found] == [1, 2, 3] and found[0][1] == 0 and found[2][1] == found[1][1] + 1
    assert any(f.endswith(".rec") for _, _, names in os.walk(tmp_path) for f in names)
