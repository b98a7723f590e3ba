"""Near-duplicates and fingerprints against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import op3_near_dedup as near
from docloom.llm import groups, similar
from docloom.llm.op5_fingerprints import edit, fingerprint, fingerprints, likeness, near_groups, near_roots

from .conftest import by_id

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def brute(rows, width, percent=80):
    """(doc_id, size, component, kept) by comparing all pairs."""
    sets = [shingle_set(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                shared = len(sets[i] & sets[j])
                if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [{"i": d, "n": len(s), "c": least.get(find(k)), "k": d == least.get(find(k))} for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def planted(seed=1):
    """Groups of copies with words changed, a large group, chains, and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for g in range(40):
        base = [word() for _ in range(rng.choice([3, 5, 8, 30, 120]))]
        for _ in range(rng.choice([1, 2, 3, 120 if g == 0 else 6])):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    chain = [word() for _ in range(60)]
    for _ in range(12):
        chain = chain[2:] + [word(), word()]
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("case", ["nasty", "planted", "table", "empty"])
def test_near_duplicates(spark, sf_dir, make_docs, nasty, case):
    rows = {"nasty": [r for r in nasty if r[0] is not None], "planted": planted(), "empty": []}.get(case)
    if rows is None:
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = near.near_duplicates(make_docs(rows, extra=True)).collect()
    assert by_id(got, "doc_id", "n_shingles", "component_id", "kept") == by_id(brute(rows, 4), "i", "n", "c", "k")


def test_deep_levels_and_blocks_lose_no_link(make_docs, monkeypatch):
    monkeypatch.setattr(near.roots_of, "__defaults__", (4, 1, 8, 16))  # nodes of five are large, and large ones remain at the end
    rows = planted(5)
    got = near.near_duplicates(make_docs(rows)).collect()
    assert by_id(got, "doc_id", "component_id") == by_id(brute(rows, 4), "i", "c")


def test_sketches_are_compared_place_by_place():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 3, (50, near.FINE)).astype(np.uint8)
    rows[7] = rows[3]
    assert np.allclose(groups.alike(rows, rows[3]), (rows == rows[3]).mean(axis=1))
    assert groups.alike(rows, rows[3])[7] == 1


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in similar.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


def test_extended_components_are_those_of_all_links(spark):
    rng = random.Random(2)
    first, more = ([(rng.randrange(60), rng.randrange(60)) for _ in range(n)] for n in (25, 20))
    frame = lambda rows: spark.createDataFrame([(a, b) for a, b in rows if a != b], "a long, b long")
    got = {r.node: r.root for r in similar.extend(similar.components(frame(first)), frame(more)).collect()}
    assert got == {r.node: r.root for r in similar.components(frame(first + more)).collect()}


def test_shingles_match_words():
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "B", "é", "b ", " ", "\n", "x y", "漢 ", "\x0b", "\xa0", "cc"]) for _ in range(rng.randint(0, 20))) for _ in range(2000)] + ["", None]
    hashes, begin = similar.shingles(pa.array(texts), 4)
    names, back = {}, {}
    for k, t in enumerate(texts):
        own = set(hashes[begin[k] : begin[k + 1]].tolist())
        want = shingle_set(t, 4)
        assert len(own) == len(want)
        for x in own:
            names.setdefault(x, None)
        back.setdefault(frozenset(want), frozenset(own))
        assert back[frozenset(want)] == frozenset(own)


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(0)
    pool = similar.mix(np.arange(1, 4001, dtype=np.uint64))
    for shared in (0, 500, 800, 950):
        a, b = pool[:1000], pool[1000 - shared : 2000 - shared]
        sig = similar.signatures(np.concatenate([a, b]), np.array([0, 1000, 2000]), many=512)
        assert abs((sig[0] == sig[1]).mean() - shared / (2000 - shared)) < 0.08
    assert rng is not None


def test_fingerprints(make_docs, nasty):
    rows = nasty + planted(2)[:50]
    rows = [(i if k < len(nasty) else None if i is None else i + 100, t) for k, (i, t) in enumerate(rows)]
    got = fingerprints(make_docs(rows, extra=True)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        changed = edit(t, u)
        f, g, h = (fingerprint(pa.array([x])) for x in (t, changed, u))
        want.append({"i": i, "n": len(t), "s": hashlib.sha256(changed.encode()).hexdigest(), "f": f[0].tobytes().hex(), "g": g[0].tobytes().hex(), "a": float(likeness(f, g)[0]), "b": float(likeness(f, h)[0])})
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert by_id(got, *names) == by_id(want, *"insfgab")
    assert fingerprints(make_docs([])).count() == 0


def by_hand(text, width, many=similar.PERMUTATIONS, seed=1):
    """The fingerprint of a text in whole numbers, hash by hash."""
    top, m1, m2, gold, base = 1 << 64, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xD1342543DE82EF95

    def mix(x):
        x %= top
        x = (x ^ x >> 30) * m1 % top
        x = (x ^ x >> 27) * m2 % top
        return x ^ x >> 31

    words = [mix(sum(mix((b + 1) * gold) * pow(base, i, top) for i, b in enumerate(w.encode()))) for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    salt = [mix((j + 1) * m2) | 1 for j in range(width)]
    rows = [words[i : i + width] for i in range(len(words) - width + 1)] if len(words) >= width else [words] if words else []
    found = [mix(sum(w * s for w, s in zip(r, salt, strict=False)) + (len(r) * gold if len(r) < width else 0)) for r in rows]
    keys = [mix(k + (seed << 32)) for k in range(1, 2 * many + 1)]
    return [min((((a | 1) * x + b) % top >> 32 for x in found), default=0xFFFFFFFF) & 0xFFFF for a, b in zip(keys[:many], keys[many:], strict=True)]


def test_fingerprints_by_hand(monkeypatch):
    monkeypatch.setattr(similar, "STRETCH", 40)  # words of one text from several stretches
    texts = ["", None, " ", "One two", "a b c d e f g A b c d e f g é 漢字 x", "the cat sat on the mat " * 30]
    assert fingerprint(pa.array(texts)).tolist() == [by_hand(t, 5) for t in texts]


@pytest.mark.parametrize("kind", ["nasty", "empty"])
def test_near_groups_on_hard_rows(make_docs, nasty, kind):
    rows = [*nasty, (60, "one two three four five six seven"), (61, "One two three FOUR five six seven"), (61, "One two three FOUR five six seven")] if kind == "nasty" else []
    got = near_groups(make_docs(rows, extra=True)).collect()
    named = [r for r in rows if r[0] is not None]
    want = {(b["i"], b["c"]) for b in brute(named, 5)}
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == want
    assert len(got) == len(rows) and all(r.n_alike >= 1 for r in got)


def test_bands_find_planted_near_copies(make_docs):
    rng = random.Random(12)
    rows, want = [], []
    for g in range(150):
        base = [f"{g}x{rng.randrange(10**6)}" for _ in range(120)]
        copy = list(base)
        copy[rng.randrange(120)] = "changed"  # similarity 0.92 at least
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
        want.append((2 * g, 2 * g + 1))
    got = {r.doc_id: r.component_id for r in near_groups(make_docs(rows)).collect()}
    assert sum(got[a] == got[b] for a, b in want) >= 0.99 * len(want)
    assert len(set(got.values())) >= 150


def test_rows_without_id(make_docs):
    text = "a b c d e f g h"
    got = near.near_duplicates(make_docs([(None, text), (7, text), (9, text), (None, "x y z"), (None, None), (9, text)])).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=key) == sorted([(None, 7, False), (7, 7, True), (9, 7, False), (9, 7, False), (None, None, True), (None, None, True)], key=key)


def test_near_roots(make_docs):
    rows = planted(3)
    docs = make_docs(rows)
    found = near_roots(docs)
    classes = near.profiles(docs, 5).join(found, "node", "left")
    got = {}
    for r in classes.collect():
        got.setdefault(r.root if r.root is not None else r.node, set()).add(r.doc_id)
    want = {}
    for r in brute(rows, 5):
        want.setdefault(r["c"], set()).add(r["i"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize(("first", "trees", "levels"), [(0, near.TREES, 2), (near.TREES, near.DEEP, 6)])
def test_trees_keep_pairs_at_the_threshold_at_every_depth(first, trees, levels):
    rng = np.random.default_rng(6)
    n = 4000
    a = rng.integers(0, 1 << 16, (n, near.FINE)).astype(np.uint16)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 1 << 16, a.shape).astype(np.uint16))
    met = np.zeros(n, bool)
    for (r, p), (s, q) in zip(near.paths(a, first, trees, levels), near.paths(b, first, trees, levels), strict=True):
        met |= np.isin(np.arange(n), np.intersect1d(np.stack([r, p.view(np.int64)], 1).copy().view("i8,i8"), np.stack([s, q.view(np.int64)], 1).copy().view("i8,i8"))["f0"])
    assert met.all()  # ten trees on 64 places lost some 25 of so many at six levels


def templates(seed=8):
    """Texts that share a template and differ in more words than the threshold allows, each with a near copy."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, texts = [word() for _ in range(200)], []
    for _ in range(40):
        own = base[:130] + [word() for _ in range(40)] + base[130:]
        texts += [" ".join(own), " ".join([*own[:-3], word(), *own[-2:]])]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_buckets_of_templates_lose_no_link(make_docs):
    rows = templates()
    got = near_groups(make_docs(rows)).collect()
    want = brute(rows, 5)
    sizes = {c: sum(r["c"] == c for r in want) for c in {r["c"] for r in want}}
    assert len(sizes) == 40
    assert by_id(got, "doc_id", "component_id", "n_alike") == by_id([{**r, "m": sizes[r["c"]]} for r in want], "i", "c", "m")
