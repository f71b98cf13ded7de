"""Neighbours among near copies: recall against brute force where vectors differ in their last digits."""

import numpy as np
import pytest
from weftline.llm import neighbours


@pytest.mark.parametrize("radius", [1e-2, 1e-3, 1e-4, 1e-5, 1e-6])
def test_near_copies_are_told_apart(radius):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    vectors = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 64)) * radius / 8
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    queries = np.arange(0, 3000, 20)
    hits = 0
    for i, met in zip(queries, neighbours.search(unit, neighbours.build(unit), unit[queries]), strict=True):
        met = met[(met >= 0) & (met != i)]
        every = unit @ unit[i]
        every[i] = -2
        hits += len(set(np.argsort(-every)[:5]) & set(met[np.argsort(-(unit[met] @ unit[i]))[:5]]))
    assert hits >= 0.95 * 5 * len(queries)


def test_workers_let_go_of_other_operators_caches():
    from weftline.llm import bpe, common

    coder = bpe.bpe("byte_bpe_50k.json")
    common.let_go("bpe")
    assert bpe.bpe("byte_bpe_50k.json") is coder
    common.let_go()
    assert bpe.bpe("byte_bpe_50k.json") is not coder
