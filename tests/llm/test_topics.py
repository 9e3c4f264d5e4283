"""The topics of benchmark decontamination come from the documents' passages."""

import numpy as np

from rentroll.llm import decontaminate as d
from rentroll.llm.words import word_hashes


def hashed(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]), d.APART)[0]


def folded(topics, text):
    f = d.features(hashed(text))
    return d.unit(topics.folded(f, np.arange(0, len(f), d.STRIDE)).sum(0, keepdims=True))[0]


def names(start, n=16):
    return [f"{start}{i}" for i in range(n)]


def test_every_passage_of_distinct_texts_is_decomposed(rows):
    text = " ".join([*names("a", 40), *names("a", 40)])  # 80 words: passages of 32, 32 and 16
    held, texts, sketch = d.measured(rows([(1, text), (2, text), (3, None), (4, "")], "id bigint, text string"))
    assert texts == 2 and held.max() == 1
    want = np.zeros(d.SKETCH * d.LATENT, np.int64)
    d.add_passages(want, hashed(text), np.array([0, 80]))
    assert np.array_equal(sketch.ravel(), want) and np.abs(want).sum() > 40
    assert np.count_nonzero(sketch.any(1)) == 3


def test_words_that_stand_for_each_other_are_near_in_the_topics(rows):
    rng = np.random.default_rng(1)
    subjects = [(names(f"left{k}x"), names(f"right{k}x")) for k in range(20)]
    docs = []
    for k, (left, right) in enumerate(subjects):
        for i in range(20):
            docs.append((k * 100 + i, " ".join(rng.permutation([*left, *right]))))
    topics = d.Topics(*(d.measured(rows(docs, "id bigint, text string"))[j] for j in (2, 0, 1)))
    vectors = [[folded(topics, " ".join(words)) for words in pair] for pair in subjects]
    same = [float(a @ b) for a, b in vectors]
    other = [float(vectors[k][0] @ vectors[k - 1][1]) for k in range(20)]
    assert np.median(same) >= d.NEAR and max(other) < d.NEAR


def test_a_copy_is_found_by_the_topics_alone(rows):
    item = " ".join(names("item", 32))
    docs = [(i, " ".join(names(f"d{i}w", 64))) for i in range(30)] + [(99, f"{' '.join(names('before', 32))} {item} after")]
    held, texts, sketch = d.measured(rows(docs, "id bigint, text string"))
    topics = d.Topics(sketch, held, texts)
    idf = d.FAINT + np.log((1.0 + texts) / (1.0 + held))
    probe = d._probes(7, item, None)
    space = d._block(rows([], "x int").sparkSession, probe, idf, topics)
    space.slot[:] = -1  # nothing is known in the space of the probes
    words = hashed(docs[-1][1])
    assert [(r[0], r[1]) for r in d.find(words, np.array([0, len(words)]), idf, [space], topics)] == [(0, 7)]
    assert not list(d.find(hashed(docs[0][1]), np.array([0, 64]), idf, [space], topics))


class Counted(np.ndarray):
    """An array that counts the rows taken of it."""

    taken = 0

    def __getitem__(self, at):
        Counted.taken += len(at)
        return np.asarray(self)[at]


def test_only_places_that_can_hold_a_probe_are_folded(rows):
    items = [names(f"item{k}w", 20) for k in range(30)]
    docs = [(i, " ".join(names(f"d{i}w", 64))) for i in range(30)]
    held, texts, sketch = d.measured(rows(docs, "id bigint, text string"))
    topics = d.Topics(sketch, held, texts)
    idf = d.FAINT + np.log((1.0 + texts) / (1.0 + held))
    space = d._block(rows([], "x int").sparkSession, [p for k, w in enumerate(items) for p in d._probes(k, " ".join(w), None)], idf, topics)
    space.basis = space.basis.view(Counted)

    def found(text):
        Counted.taken = 0
        words = hashed(text)
        got = [(r[1], r[3]) for r in d.find(words, np.array([0, len(words)]), idf, [space], topics)]
        return got, Counted.taken

    # every fifth word is of some item, but no two that follow are of the same one
    assert found(" ".join(f"{items[k][j]} w{j}x{k} x{j}x{k} y{j}x{k} z{j}x{k}" for j in range(0, 20, 5) for k in range(30))) == ([], 0)
    for around in (0, 7, 16, 40):
        text = " ".join([*names("before", around), *items[4], *names("after", 50), *items[9][:17], *names("end", around)])
        got, taken = found(text)
        assert got == [(4, 1.0), (9, 0.85)] and taken >= 37


def test_a_repeated_word_does_not_hide_a_probe(rows):
    held, texts, sketch = d.measured(rows([(i, " ".join(names(f"d{i}w", 64))) for i in range(30)], "id bigint, text string"))
    topics = d.Topics(sketch, held, texts)
    idf = d.FAINT + np.log((1.0 + texts) / (1.0 + held))
    item = "again " * 12 + " ".join(names("item", 4))
    space = d._block(rows([], "x int").sparkSession, d._probes(3, item, None), idf, topics)
    for around in (0, 5, 30):
        words = hashed(" ".join([*names("before", around), item, *names("after", around)]))
        assert [r[1] for r in d.find(words, np.array([0, len(words)]), idf, [space], topics)] == [3]
