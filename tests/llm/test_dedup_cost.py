"""What substring search finds in random passages, and the backward steps that it takes."""

import numpy as np

from siltstone.llm import fm_index


def _plain_cover(flat, bounds, many, width):
    seen, at = {}, [(k, i) for k in range(len(many)) for i in range(bounds[k], bounds[k + 1] - width + 1)]
    for k, i in at:
        key = tuple(flat[i : i + width])
        seen[key] = seen.get(key, 0) + 1 + bool(many[k])
    cover = np.zeros(len(flat), bool)
    for _, i in at:
        if seen[tuple(flat[i : i + width])] > 1:
            cover[i : i + width] = True
    return cover


def test_repeated_windows_of_random_passages():
    rng = np.random.default_rng(4)
    for _ in range(60):
        base = rng.integers(0, 4, 60).astype(np.uint64)
        passages = [base[i : i + rng.integers(1, 20)].copy() for i in rng.integers(0, 40, rng.integers(1, 12))]
        for p in passages[::2]:
            p[rng.integers(0, len(p))] = rng.integers(0, 9)
        flat, bounds = np.concatenate(passages), np.concatenate([[0], np.cumsum([len(p) for p in passages])])
        many, width = rng.random(len(passages)) < 0.15, int(rng.integers(2, 8))
        got = np.zeros(len(flat), bool)
        for k, first, past in zip(*fm_index.repeated_windows(flat, bounds, many, width), strict=True):
            assert past - first >= width and past <= bounds[k + 1] - bounds[k]
            got[bounds[k] + first : bounds[k] + past] = True
        assert (got == _plain_cover(flat, bounds, many, width)).all()


def test_passages_that_share_an_anchor_only_take_few_backward_steps(monkeypatch):
    rng = np.random.default_rng(5)
    flat = rng.integers(10, 1 << 40, 200 * 65).astype(np.uint64).reshape(200, 65)
    flat[:, 30:35] = np.arange(5)  # the anchor; all else is different
    steps, extend = [], fm_index.FmIndex.extend
    monkeypatch.setattr(fm_index.FmIndex, "extend", lambda self, code, low, high: steps.append(len(code)) or extend(self, code, low, high))
    found = fm_index.repeated_windows(flat.reshape(-1), np.arange(0, 200 * 65 + 1, 65), np.zeros(200, bool), 35)
    assert not len(found[0]) and sum(steps) <= 200 * 10
