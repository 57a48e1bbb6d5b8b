"""Folders of files, one per row."""

import os

import pytest
from pyspark.errors import PySparkException

from graphloom.sinks.files import write_files_now, write_text_files
from graphloom.sources.corpus import read_markdown_corpus

LAYOUT = "rel_path string, text string, n_bytes string, value string"


def table(spark, rows):
    return spark.createDataFrame([(p, t, "x", "y") for p, t in rows], LAYOUT)


def test_one_file_per_row(spark, tmp_path):
    rows = [("a/one.md", "# One\n"), ("a/b/two words+1%.md", "zwei ü €\r\nend"), ("three.md", None),
            ("a/empty.md", ""), ("long.md", "word " * 200_000)]
    assert write_files_now(table(spark, rows), str(tmp_path)) == (
        5, sum(len((t or "").encode()) for _, t in rows))
    found = {}
    for folder, _, files in os.walk(tmp_path):
        for file in files:
            path = os.path.join(folder, file)
            with open(path, "rb") as source:
                found[os.path.relpath(path, tmp_path)] = source.read()
    assert found == {p: (t or "").encode() for p, t in rows}  # no temporary file is left
    back = {r["rel_path"] for r in read_markdown_corpus(spark, str(tmp_path)).collect()}
    assert back == {"a/one.md", "a/b/two words+1%.md", "long.md"}


def test_written_again(spark, tmp_path):
    """A task that runs again, and a repeated row, leave one whole file."""
    df = table(spark, [("x.md", "same"), ("x.md", "same"), ("y.md", "other")])
    write_files_now(df, f"file:{tmp_path}")
    assert write_files_now(df, f"file://{tmp_path}") == (3, 13)
    assert sorted(os.listdir(tmp_path)) == ["x.md", "y.md"]
    assert (tmp_path / "x.md").read_text() == "same"


@pytest.mark.parametrize("path", [None, "", "/etc/x.md", "../x.md", "a/../../x.md", "a//x.md", "a/"])
def test_paths_that_leave_the_folder(spark, tmp_path, path):
    with pytest.raises(PySparkException, match="not a relative path"):
        write_files_now(table(spark, [(path, "text")]), str(tmp_path / "in"))
    assert not (tmp_path / "x.md").exists()


def test_empty_table(spark, tmp_path):
    assert write_files_now(table(spark, []), str(tmp_path)) == (0, 0)
    assert write_text_files(table(spark, []), str(tmp_path)).columns == ["rel_path", "n_bytes"]
