"""A model of many files is read with few of them open."""

import os

import numpy as np

from corpusloom.llm import ngrams


def test_open_files_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(ngrams, "MOST_MAPS", 40)
    layout = ngrams.Layout(f"file://{tmp_path}", 2000)
    rng = np.random.default_rng(0)
    hashes = np.unique(rng.integers(0, 2**64, 9000, dtype=np.uint64))
    shard = layout.word_shard(hashes)
    layout.sizes = np.bincount(shard, minlength=2000).tolist()
    bounds = np.concatenate([[0], np.cumsum(layout.sizes)])
    for i in range(2000):
        own = hashes[shard == i]
        ngrams._save(layout.folder, f"words-{i}", own, np.arange(len(own), dtype=np.int64) + 1)
        n = len(own) + (2 if i == 1999 else 0)
        ngrams._save(layout.folder, f"stats-{i}", *[(np.arange(n) + bounds[i]).astype(np.uint32)] * 4)
    reader = ngrams.Reader(layout)
    before = len(os.listdir("/proc/self/fd"))
    asked = np.concatenate([hashes[::-1], np.array([5], np.uint64)])
    ids, counts = reader.ids(asked)
    assert ids.tolist() == [*range(len(hashes) - 1, -1, -1), -1 if 5 not in hashes else 0]
    assert counts[:-1].tolist() == [int(i - bounds[s]) + 1 for i, s in zip(ids[:-1], shard[::-1])]
    every = np.arange(len(hashes) + 2)
    assert (reader.stats(every) == every[:, None]).all()
    assert len(reader.files.kept) <= 40 and len(os.listdir("/proc/self/fd")) <= before + 45
    maps = sum(str(tmp_path) in line for line in open("/proc/self/maps"))
    assert maps <= 45
