from dataclasses import replace

import pytest

from tidemark.errors import CommitConflict
from tidemark.sources import manifest as manifests
from tidemark.sources.files import Cached, Counted, LocalFiles
from tidemark.sources.manifest import Manifests, WalFile


def test_disk_cache(tmp_path):
    counted = Counted(LocalFiles(str(tmp_path / "store")))
    cached = Cached(counted, str(tmp_path / "cache"), most_bytes=100)
    cached.put_new("a/1", b"x" * 40)
    assert cached.get("a/1") == b"x" * 40 and counted.counts["get"] == 0 and cached.hits == 1
    with pytest.raises(CommitConflict):
        cached.put_new("a/1", b"other")
    assert cached.get("a/1") == b"x" * 40 and cached.get("a/none") is None
    counted.put_new("a/2", b"y" * 50)  # by another writer
    assert cached.get("a/2") == cached.get("a/2") == b"y" * 50 and counted.counts["get"] == 2
    cached.put_new("a/3", b"z" * 60)  # drops the oldest
    held = sum(p.stat().st_size for p in (tmp_path / "cache").iterdir())
    assert held <= 100 and cached.get("a/1") == b"x" * 40 and cached.list("a") == ["1", "2", "3"]
    cached.put_new("a/4", b"w" * 101)  # too large to be kept
    assert cached.get("a/4") == b"w" * 101
    cached.delete("a/1")
    assert cached.get("a/1") is None and counted.get("a/1") is None


def test_cache_of_a_broken_disk(tmp_path):
    cached = Cached(LocalFiles(str(tmp_path / "store")), str(tmp_path / "cache"))
    (tmp_path / "cache").rmdir()
    cached.put_new("a", b"1")
    assert cached.get("a") == b"1" and cached.hits == 0


def test_d18_a_lost_race_reads_the_new_version_through_the_cache(tmp_path):
    store = LocalFiles(str(tmp_path / "store"))
    ours, theirs = (Manifests(Cached(store, str(tmp_path / name)), "space") for name in ("c1", "c2"))
    ours.create()
    ours.latest()
    calls = []

    def add(now):
        if not calls:  # another writer commits between our reading and our writing
            theirs.commit(lambda m: replace(m, wal=(*m.wal, WalFile(m.next_seq, "theirs", 1, 1)), next_seq=m.next_seq + 1))
        calls.append(now.version)
        return replace(now, wal=(*now.wal, WalFile(now.next_seq, "ours", 1, 1)), next_seq=now.next_seq + 1)

    done = ours.commit(add)
    assert calls == [0, 1] and [(w.seq, w.key) for w in done.wal] == [(0, "theirs"), (1, "ours")]
    assert theirs.latest() == done


def test_d12_d13_status_and_bytes_come_from_the_log(tmp_path):
    space = Manifests(LocalFiles(str(tmp_path / "store")), "space")
    space.create()
    grown = space.commit(lambda m: replace(m, wal=(WalFile(0, "a", 1, 70), WalFile(1, "b", 1, 30)), next_seq=2))
    assert grown.unindexed_bytes == 100 and grown.index_status == "updating"
    part = space.commit(lambda m: replace(m, snapshot="s", wal=m.wal[1:]))  # a compaction of the first commit only
    assert part.unindexed_bytes == 30 and part.index_status == "updating"
    assert space.commit(lambda m: replace(m, wal=())).index_status == "up-to-date"


def test_commits_give_up(tmp_path, monkeypatch):
    monkeypatch.setattr(manifests.time, "sleep", lambda s: None)
    space = Manifests(LocalFiles(str(tmp_path / "store")), "space")
    space.create()
    other = Manifests(space.files, "space")

    def change(now):
        other.commit(lambda m: m)
        return now

    with pytest.raises(CommitConflict):
        space.commit(change)
