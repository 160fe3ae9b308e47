import hashlib

import numpy as np
import pytest
from conftest_llm import ODD_TEXTS

from kscreen.llm import repeats, suffix_dedup, super_kmers


@pytest.fixture
def corpus(prose, rng):
    shared = [prose(80) for _ in range(4)]
    texts = list(ODD_TEXTS)
    for i in range(60):
        parts = [prose(rng.randint(0, 60)) for _ in range(3)]
        if i % 3 == 0:
            parts.insert(1, rng.choice(shared))
        if i % 7 == 0:
            parts.append(shared[0][: rng.randint(300, 500)])
        texts.append("\n".join(parts))
    twice = prose(100)
    return texts + [texts[20]] * 5 + [f"{twice} {prose(3)}\t{twice}", "same line of words\n" * 60, twice.upper()]


def test_suffix_array(rng):
    for _ in range(200):
        t = bytes(rng.choice(b"ab\0c"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 60)))
        order = suffix_dedup.suffix_array(t, 64).tolist()
        assert order == sorted(range(len(t)), key=lambda i: t[i:]) or [t[i : i + 64].ljust(64, b"\0") for i in order] == sorted(t[i : i + 64].ljust(64, b"\0") for i in range(len(t)))


@pytest.mark.parametrize("module,window", [(suffix_dedup, 8), (super_kmers, 3)])
def test_compare(rng, module, window):
    for _ in range(60):
        strings = [(b" " if module is super_kmers else b"").join(rng.choice([b"a", b"b"]) for _ in range(rng.randint(window, 30))) for _ in range(5)]
        units = [s.split(b" ") if module is super_kmers else list(s) for s in strings]
        counts = np.array([len(u) - window + 1 for u in units])
        all_ = [tuple(u[i : i + window]) for u, n in zip(units, counts, strict=True) for i in range(n)]
        want = [[all_.count(tuple(u[i : i + window])) > 1 for i in range(n)] for u, n in zip(units, counts, strict=True)]
        assert [f.tolist() for f in module.compare(strings, counts, window)] == want


@pytest.mark.parametrize("hot,pack", [(512, 1 << 18), (1, 1 << 18), (1, 50)])
@pytest.mark.parametrize("module", [suffix_dedup, super_kmers])
def test_against_brute_force(spark, docs_of, corpus, module, hot, pack, monkeypatch):
    monkeypatch.setattr(repeats, "PACK", pack)
    monkeypatch.setattr(repeats, "HOT", hot)
    out = {r.doc_id: r for r in module.remove_repeats(docs_of(corpus)).collect()}
    want = module.brute_force(corpus)
    assert len(out) == len(corpus)
    for i, w in enumerate(want):
        r = out[i]
        got = (r.n_bytes, r.n_removed, r.n_spans) if module is suffix_dedup else (r.n_words, r.n_removed)
        assert (hashlib.sha256(r.kept).hexdigest(), *got) == w, corpus[i]
    assert sum(w[2] > 0 for w in want) > 25


@pytest.mark.parametrize("module", [suffix_dedup, super_kmers])
def test_nothing_and_nulls(spark, docs_of, module):
    assert module.remove_repeats(docs_of([])).count() == 0
    rows = module.remove_repeats(docs_of([None, None, ""]).selectExpr("cast(null as long) doc_id", "text", "k1")).collect()
    assert [(r.doc_id, bytes(r.kept), r.n_removed) for r in rows] == [(None, b"", 0)] * 3


def test_runs_cover_every_window_once(monkeypatch):
    grams = np.random.default_rng(3).integers(0, 2**63, 3000).astype(np.uint64)
    for segment in (1 << 22, 100):
        monkeypatch.setattr(repeats, "SEGMENT", segment)
        first, count, anchor = repeats.runs(grams, 50)
        assert first.tolist() == [0, *np.cumsum(count)[:-1].tolist()] and count.sum() == 2951 and len(anchor) == len(first)


def test_word_hashes_follow_words():
    h = repeats.word_hashes(b" ab\tcd  ab\x0bx\x1cab ")
    assert len(h) == 4 and h[0] == h[2] and len(set(h.tolist())) == 3
