"""The listing source against the whole listing, and what it never opens."""

import os
import time

import pytest

from catalogfuse.sources import walk
from catalogfuse.sources.inventory import scan_inventory


@pytest.fixture
def tree(tmp_path):
    names = ["a/1.mp4", "a/b/2.MKV", "a/b/c/3.mp4", "a/b/c/.4.mp4", "d/skip", "d/5.mp4", "d/e/6.mp4", "f/behind the scenes/7.mp4", "g/8.mp4", "g/h/9.txt", "g/h/trailer.mp4", "0.mp4"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("x" * len(n))
    (tmp_path / "loop").symlink_to(tmp_path / "a")
    return tmp_path


@pytest.mark.parametrize("spread", [1, 2, 64])
def test_the_same_files_as_a_whole_listing(spark, tree, spread):
    exts, ignored = (".mp4", ".mkv"), (f"{tree}/g/",)
    want = {(r.path, r.size, r.ext) for r in scan_inventory(spark, [str(tree)], exts, ignored).collect() if "/loop/" not in r.path}
    got = [(r.path, r.size, r.ext) for r in walk.walk_inventory(spark, [f"{tree}/"], exts, ignored, spread=spread).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {os.path.basename(p) for p, _, _ in got} == {"0.mp4", "1.mp4", "2.MKV", "3.mp4"}
    assert walk.walk_inventory(spark, [f"{tree}/none"], exts).count() == 0


def test_marked_folders_are_not_entered(tree, monkeypatch):
    opened = []
    real = walk.list_folder
    monkeypatch.setattr(walk, "list_folder", lambda d: opened.append(d) or real(d))
    walker = walk.Walker(walk._options([str(tree)], [f"{tree}/g"], walk.SKIP_MARKERS, 1))
    for part in walker.subtrees():
        list(walker.walk(part))
    assert {os.path.relpath(d, tree) for d in opened} == {".", "a", "a/b", "a/b/c", "d", "f"}


def test_batches_list_what_changed(spark, tree, tmp_path_factory):
    out, old = tmp_path_factory.mktemp("out"), time.time() - 100
    for folder, _, files in os.walk(tree):
        for f in files:
            os.utime(f"{folder}/{f}", (old, old))

    def run():
        rows = walk.stream_walk(spark, [str(tree)], (".mp4", ".mkv"))
        q = rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(os.path.basename(r.path) for r in spark.read.parquet(f"{out}/rows").collect())

    assert run() == ["0.mp4", "1.mp4", "2.MKV", "3.mp4", "8.mp4"]
    (tree / "a/new.mp4").write_text("new")
    os.utime(tree / "a/new.mp4", (time.time() - 2, time.time() - 2))
    time.sleep(1.5)
    # The old files' times lie before the first batch's end: only the new one comes.
    os.utime(tree / "a/new.mp4", (time.time() - 1.2, time.time() - 1.2))
    assert run() == ["0.mp4", "1.mp4", "2.MKV", "3.mp4", "8.mp4", "new.mp4"]
