import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from helixframe.llm import bagminhash as B
from helixframe.llm.textbytes import utf8


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key string")


def bag(text):
    w = (text or "").encode().split()
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def classes(rows):
    bags, label = [bag(t) for _, t in rows], [i for i, _ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if bags[a] and rows[a][0] is not None and rows[b][0] is not None and similarity(bags[a], bags[b]) >= 0.8]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def made(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 400))
    texts = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(60)]
    base = [word() for _ in range(90)]
    for k in range(60):  # a group whose members lie around the threshold of each other
        copy = list(base)
        for _ in range(k % 5):
            copy[rng.randrange(90)] = word()
        texts.append(" ".join(copy))
    texts += ["x y " * 50, "x y " * 60, "x y " * 30, "one two", "one two", "one  two", "a b c d e", "a b c d e"]
    rng.shuffle(texts)
    return list(enumerate(texts)) + [(900, None), (901, ""), (902, " \t"), (903, texts[0]), (903, texts[0]), (None, texts[1]), (904, "long " * 60_000)]


def test_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_MEMBERS", 8)
    rows = made()
    got = B.near_classes(frame(spark, rows).repartition(4)).collect()
    want = Counter(zip((i for i, _ in rows), classes(rows)))
    assert Counter((r.doc_id, r.class_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.class_id or r.doc_id is None) for r in got)


def test_unbiased_signatures():
    rng = random.Random(1)
    errors = []
    for _ in range(60):
        a = Counter({f"w{rng.randint(0, 40)}": rng.randint(1, 9) for _ in range(30)})
        b = Counter({k: max(1, v + rng.randint(-3, 3)) for k, v in a.items() if rng.random() < 0.8})
        names = sorted(set(a) | set(b))
        code = {k: np.uint64(j * 2654435761 + 17) for j, k in enumerate(names)}
        owner = np.array([0] * len(a) + [1] * len(b))
        element = np.array([code[k] for k in a] + [code[k] for k in b], np.uint64)
        weight = np.array([*a.values(), *b.values()])
        s = B.signatures(owner, element, weight, 2, 2048)
        errors.append((s[0] == s[1]).mean() - similarity(a, b))
    assert abs(np.mean(errors)) < 0.005 and np.max(np.abs(errors)) < 0.06


def test_exact_overlap_and_shingles():
    texts = [t for _, t in made()[:40]]
    owner, element, weight = B.shingles(*utf8(pa.array(texts)))
    for a in range(0, 40, 3):
        for b in range(0, 40, 7):
            mine = [(element[owner == k], weight[owner == k].astype("u4")) for k in (a, b)]
            assert B.overlap(*mine) == pytest.approx(similarity(bag(texts[a]), bag(texts[b])))


def test_stage_keeps_one_of_each_class(spark):
    rows = made()
    docs = frame(spark, rows)
    out = B.stage(spark, docs, "")
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    want = {c for (i, _), c in zip(rows, classes(rows)) if i is not None}
    assert sorted(k for k in kept if k is not None) == sorted(want) and kept.count(None) == 1


def test_points_do_not_depend_on_the_company():
    """A text's signature is the same alone, with others, and where few processes are left."""
    rng = np.random.default_rng(2)
    size = [1, 3, 40, 700]
    owner = np.repeat(np.arange(4), size)
    element = rng.integers(0, 2**47, len(owner)).astype(np.uint64)
    weight = rng.choice([1, 1, 1, 2, 3, 7, 100], len(owner))
    whole = B.signatures(owner, element, weight, 4, 120)
    assert np.isfinite(whole).all()
    for k in range(4):
        mine = owner == k
        assert (B.signatures(np.zeros(size[k], np.int64), element[mine], weight[mine], 1, 120)[0] == whole[k]).all()
    assert np.isinf(B.signatures(owner[:0], element[:0], weight[:0], 1, 120)).all()


def test_first_points_have_the_weight_as_rate():
    """The components of one element of weight w are exponential of rate w / m."""
    element = np.arange(400, dtype=np.uint64) * np.uint64(7919)
    for w in (1, 3, 6, 13):
        s = B.signatures(np.arange(400), element, np.full(400, w), 400, 64)
        assert np.mean(s) * w / 64 == pytest.approx(1.0, rel=0.03)
        assert np.mean(s > 64 / w) == pytest.approx(np.exp(-1), rel=0.06)


def test_stage_with_clashing_columns(spark):
    names = "nth rep key kept class_id component n bucket hub a b".split()
    rows = made()[:40] + [(903, "again and again"), (903, "again and again"), (903, "another text")]
    docs = spark.createDataFrame([(i, t, *[k] * len(names)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = B.stage(spark, docs, "")
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} >= {903}
    assert B.stage(spark, docs.limit(0), "").count() == 0


def test_one_id_with_several_texts_is_stable(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(7, base), (7, "quite another text of its own kind"), (9, base + " more"), (3, base + " less")]
    want = None
    for k in range(3):
        got = sorted((r.doc_id, r.class_id) for r in B.near_classes(frame(spark, rows[k:] + rows[:k]).repartition(3)).collect())
        assert want is None or got == want
        want = got


def test_texts_that_share_an_id_are_judged_one_by_one(spark):
    """A duplicate's id does not take another text of that id with it, and a link of one text is not lent to another."""
    base = [f"w{k}" for k in range(60)]
    a, near, other = " ".join(base), " ".join(base[:-1]), " ".join(f"x{k}" for k in range(50))
    far = " ".join(f"y{k}" for k in range(70))
    rows = [(3, a), (5, a), (5, other), (7, far), (8, near), (8, other + " more"), (9, far + " z"), (9, a), (9, a), (2, None), (2, None), (2, ""), (12, "alone here"), (12, "alone here")]
    want = [(2, ""), (2, None), (2, None), (3, a), (5, other), (7, far), (12, "alone here")]
    for parts in (1, 3, 8):
        docs = frame(spark, rows).repartition(parts)
        assert sorted(((r.doc_id, r.text) for r in B.stage(spark, docs, "").collect()), key=repr) == sorted(want, key=repr)
        got = Counter((r.doc_id, r.class_id) for r in B.near_classes(docs).collect())
        assert got == Counter({(3, 3): 1, (5, 3): 1, (5, 5): 1, (7, 7): 1, (8, 3): 1, (8, 5): 1, (9, 7): 1, (9, 3): 2, (2, 2): 3, (12, 12): 2})


def test_recall_of_near_copies(spark):
    """Pairs of similarity 0.80 to 0.90, planted 300 times, against brute force."""
    rng = random.Random(11)
    texts, planted = [], 0
    while planted < 300:
        base = [f"v{rng.randrange(10**6)}" for _ in range(120)]
        copy = list(base)
        for place in rng.sample(range(10, 110), rng.randint(1, 3)):
            copy[place] = f"u{rng.randrange(10**6)}"
        if 0.8 <= similarity(bag(" ".join(base)), bag(" ".join(copy))) <= 0.9:
            texts += [" ".join(base), " ".join(copy)]
            planted += 1
    got = {r.doc_id: r.class_id for r in B.near_classes(frame(spark, list(enumerate(texts)))).collect()}
    found = sum(got[k + 1] == k for k in range(0, 600, 2))
    assert found >= 294
    assert all(got[k] == k for k in range(0, 600, 2))


def test_empty(spark):
    assert B.near_classes(frame(spark, [])).count() == 0
