"""Shared folders: one place for Spark and for tasks, and gone with their block."""

import os

import pyarrow.fs as pafs
import pytest

from gridlapse.llm import common, records, warc
from gridlapse.plans.stage import staging
from tests.llm.frames import documents, prose

import public_tokenizers


def test_folders_have_a_scheme_and_go_with_their_block(spark):
    with staging(spark) as block:
        path = common.fresh_folder(spark, "things")
        assert path.startswith("file:") and block.removeprefix("file:").lstrip("/") in path
        system, local = common.store(path)
        system.create_dir(local, recursive=True)
        with system.open_output_stream(f"{local}/x") as out:
            out.write(b"one")
        assert [r.value for r in spark.read.text(path).collect()] == ["one"]
    assert not os.path.exists(local)


@pytest.mark.parametrize("uri", ["/a/b", "file:/a/b", "file:///a/b"])
def test_local_paths_of_any_spelling(uri):
    system, path = common.store(uri)
    assert isinstance(system, pafs.LocalFileSystem) and path == "/a/b"


def test_a_local_disk_is_refused_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        master = "spark://host:7077"

    class Session:
        _jvm, _jsc, sparkContext = spark._jvm, spark._jsc, Elsewhere()

    monkeypatch.setattr(common, "fresh_path", lambda s, name: f"/shared/{name}")
    with pytest.raises(ValueError, match="local disk"):
        common.fresh_folder(Session(), "x")
    monkeypatch.setattr(common, "fresh_path", lambda s, name: f"file:///mounted/{name}")
    assert common.fresh_folder(Session(), "x") == "file:/mounted/x"


def test_files_of_tasks_go_with_their_block(spark):
    docs = documents(spark, [(i, prose(i, 10)) for i in range(20)])
    pages = spark.createDataFrame([(i, f"http://h/{i}", prose(i, 50)) for i in range(20)], "page_id long, url string, html string")
    with staging(spark) as block:
        manifest = records.write_records(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
        assert records.read_records(manifest).count() == 20
        assert warc.read_archives(warc.archive(pages)).count() == 20
        where = block.removeprefix("file:")
        assert any(f.endswith(".rec") for _, _, names in os.walk(where) for f in names)
    assert not os.path.exists(where)


@pytest.mark.parametrize("most", [1, 1 << 18])
def test_listed_rows_are_never_lost(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MARK_WORDS", most)
    rows = spark.range(5000).selectExpr("if(id = 0, null, id) as a", "id as b").repartition(3)
    listed = spark.createDataFrame([(None,)] + [(i,) for i in range(-400, 400, 2)], "x long")
    may, others = common.split_listed(rows, rows.a, listed, listed.x)
    assert may.columns == others.columns == ["a", "b"]
    first, second = ({r.b for r in part.collect()} for part in (may, others))
    assert first | second == set(range(5000)) and not first & second
    assert set(range(0, 400, 2)) <= first and (most == 1 or len(first) < 1200)
    none, every = common.split_listed(rows, rows.a, listed.where("false"), listed.x)
    assert (none.count(), every.count()) == (0, 5000)
