import hashlib
import os
import random
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
import xxhash

from rowloom.llm import components, embeddings, linededup, simhash, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def plain_fingerprint(text):
    w = WORD.findall(lower(text))
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    ones = Counter(b for x in s for b in range(64) if xxhash.xxh64_intdigest(x.encode(), 42) >> b & 1)
    return sum(1 << b for b, c in ones.items() if 2 * c > len(s))


def groups(pairs, ids):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def texts(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(400)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            w = rng.choice(out).split()
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = rng.choices(vocabulary, k=rng.randrange(3, 120))
        out.append(" ".join(w))
    return out


def test_fingerprint_is_sparks_hash(spark):
    h = spark.sql("select xxhash64('one two three four') as h").first().h % (1 << 64)
    assert simhash.fingerprint(b"one two three four") == h
    assert simhash.fingerprint(b"one two") == xxhash.xxh64_intdigest(b"one two", 42)


def test_words_and_shingles_in_pieces(monkeypatch):
    rng = random.Random(20)
    for _ in range(100):
        raw = ["".join(rng.choices("ab \n\tcé", k=rng.randrange(0, 40))).encode() for _ in range(rng.randrange(1, 9))]
        data, off = words.LOWER[np.frombuffer(b"".join(raw), np.uint8)], np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
        w = words.Words(data, off)
        assert [data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)] == [x for r in raw for x in r.split()]
        h, first = simhash.shingles_of(w, 5)
        want = [[tuple(v[i : i + min(5, len(v))]) for i in range(max(1, len(v) - 4))] if v else [None] for v in (r.split() for r in raw)]
        assert first.tolist() == np.cumsum([0, *[len(t) for t in want[:-1]]]).tolist()
        flat = dict(zip((x for t in want for x in t), h.tolist(), strict=False))
        assert [flat[x] for t in want for x in t] == h.tolist() and len(set(flat.values())) == len(flat)
        whole = [hashlib.blake2b(b" ".join(r.split()), digest_size=8).digest() for r in raw]
        for piece in (1 << 20, 3, 300):
            assert simhash.words_digest(data, off, piece).tolist() == [int.from_bytes(x, "little", signed=True) for x in whole]
        monkeypatch.setattr(words, "PIECE", 4)
        again = words.Words(data, off)
        monkeypatch.undo()
        assert (again.hash == w.hash).all() and (again.start == w.start).all()


@pytest.mark.parametrize("worker", ["op5", "op6", "op10", "pipeline"])
def test_memory_of_long_texts(worker):
    """What a Python worker does with a text of 32 MB, in a process of its own: at most 600 MB beyond the start."""
    body = """
import resource, sys
import numpy as np, pyarrow as pa
from rowloom.llm import decontaminate, linededup, simhash, toxicity, words
unit = "".join(f"some words{i} here and there\\n" for i in range(20000))
col = pa.array([(unit * 64)[: 32 << 20]])
used = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
before, worker = used(), sys.argv[1]
if worker == "op6":
    model = toxicity.Model()
    model.trained = True
    for _, t in toxicity.texts_of(col):
        model.scores(t)
elif worker == "op10":
    for _, _, x in linededup.blocks_of(col):
        x.digests(np.flatnonzero(x.n))
else:
    index = decontaminate.Items([(1, "some words1 here and there some words2 here")])
    for _, data, off in words.chunks(col):
        if worker == "op5":
            assert list(index.find(data, off, 0.8))
        else:
            w = words.Words(data, off)
            h, first = simhash.shingles_of(w, 5)
            simhash.words_digest(data, off), simhash.ones_of(h, first), simhash.band_keys(h, first)
print(used() - before)
"""
    out = subprocess.run([sys.executable, "-c", body, worker], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    assert int(out.stdout) < 600


@pytest.mark.parametrize("most", [8192, 8])
def test_simhash_against_all_pairs(docs, most):
    t = texts(300)
    got = {r.doc_id: r for r in simhash.simhash_components(docs(list(enumerate(t))), most=most).collect()}
    fp = {i: plain_fingerprint(x) for i, x in enumerate(t)}
    assert all(got[i].fp % (1 << 64) == fp[i] for i in fp)
    near = [(a, b) for a in fp for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 4]
    assert {i: r.component_id for i, r in got.items()} == groups(near, fp)


def test_simhash_hard_rows(edge, nothing):
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash.simhash_components(edge).collect()]
    of = {i: c for i, _, c in got}
    assert len(got) == 9 and of[2] == of[3] == of[4] == 2 and of[6] == 1 and of[7] == 5
    assert all(f == 0 for i, f, _ in got if i in (2, 3, 4))
    assert simhash.simhash_components(nothing).collect() == []


@pytest.mark.parametrize("radius, rows", [(4, 32), (4, 8), (6, 32), (0, 1), (20, 4)])
def test_thresholds_obey_the_general_pigeonhole(radius, rows):
    size = simhash.BLOCK
    blocks = [list(range(i, i + size)) for i in range(0, 64, size)]
    near = [simhash.distances(np.ones(1 << size))] * len(blocks)
    parts = simhash.allot(blocks, near, radius, rows)
    used = [b for bits, _ in parts for b in bits]
    # to miss every partition a pair must differ in more than t bits of each
    assert len(used) == len(set(used)) and sum(t + 1 for _, t in parts) == radius + 1
    # rows dealt out: each bucket looked into, counted at random fingerprints
    fp = np.random.default_rng(0).integers(0, 1 << 63, 500, np.uint64) * np.uint64(2)
    dealt = 0
    for bits, t in parts:
        own = simhash.gather(fp, bits)
        dealt += len(fp) + sum(int((own ^ np.uint64(m) > own).sum()) for m in simhash._masks(len(bits), t))
    assert radius == 20 or dealt <= 1.1 * rows * len(fp)


def test_keep_one_against_brute_force(docs):
    t = texts(250, 4)
    kept = {r.doc_id for r in simhash.keep_one(docs(list(enumerate(t)))).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (x.split() for x in t)]
    sim = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    near = [(a, b) for a in range(len(t)) for b in range(a) if sim(a, b) >= 0.8]
    parts = groups(near, range(len(t)))
    alone = {i for i in parts if Counter(parts.values())[parts[i]] == 1}
    assert alone <= kept and set(parts.values()) <= kept
    removed = set(parts) - kept
    assert all(any(sim(i, j) >= 0.8 for j in range(i)) for i in removed)
    # no two that stay are alike
    assert not [(a, b) for a, b in near if a in kept and b in kept]


def test_keep_one_hard_rows(edge, nothing):
    kept = sorted((r.doc_id or -1) for r in simhash.keep_one(edge).collect())
    assert kept == [-1, 1, 2, 5]
    assert simhash.keep_one(edge).columns == edge.columns and simhash.keep_one(nothing).collect() == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = groups(edges, {x for e in edges for x in e})
    got = {r.id: r.component for r in components.connected_components(df).collect()}
    assert all(got.get(i, i) == c for i, c in want.items())


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 32))
    rows = [(int(i), (base[i % 40] + rng.standard_normal(32) * (0.02 if i < 300 else 0.12)).astype(np.float32).tolist(), int(i % 3)) for i in range(500)]
    rows += [(600, rows[0][1], 0), (601, rows[0][1], None), (602, None, 1), (603, [0.0] * 32, 1), (604, [float("nan")] * 32, 1), (605, [None] * 32, 1), (606, [], 1), (607, [1.0, 2.0], 1), (608, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for most in (2048, 4):
        got = {r.vec_id: r for r in embeddings.near_duplicates(df, most=most).collect()}
        assert len(got) == len(rows)
        ok = [(i, np.array(v, float), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
        cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
        near = [(i, j) for n, (i, a, x) in enumerate(ok) for j, b, y in ok[:n] if x == y and len(a) == len(b) and cos(a, b) >= 0.98]
        links = Counter(x for p in near for x in p)
        assert sum(r.n_links for r in got.values()) >= 0.97 * sum(links.values()) and all(r.n_links <= links[i] for i, r in got.items())
        assert all(r.kept == (r.component_id == i) for i, r in got.items())
        assert got[600].component_id == 0 and got[607].n_links == got[608].n_links == 1 and all(got[i].n_links == 0 for i in range(601, 607))
    assert embeddings.near_duplicates(df.limit(0)).collect() == []


def near_lines(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def test_lines_against_all_pairs(docs):
    rng = random.Random(8)
    vocabulary = "a b c d e f".split()
    lines = []
    for _ in range(300):
        if lines and rng.random() < 0.6:
            w = list(rng.choice(lines)) or ["a"]
            k = rng.randrange(len(w))
            w = rng.choice([w, w[:k] + ["z"] + w[k:], w[:k] + w[k + 1 :], w[:k] + ["Y"] + w[k + 1 :]])
        else:
            w = rng.choices(vocabulary, k=rng.randrange(2, 30))
        lines.append(w)
    rows = [(i, "\n".join(" ".join(w) for w in lines[i * 5 : i * 5 + 5])) for i in range(60)]
    want = {}
    flat = [((i // 5, i % 5), [x.lower() for x in w]) for i, w in enumerate(lines)]
    for n, (at, w) in enumerate(flat):
        earlier = [p for p, v in flat[:n] if w == v or (len(w) >= 5 and len(v) >= 5 and near_lines(w, v))]
        if w and earlier:
            want[at] = min(earlier)
    got = {(r.doc_id, r.line_no): (r.kept_doc_id, r.kept_line_no) for r in linededup.removed_lines(docs(rows)).collect()}
    assert got == want
    clean = {r.doc_id: r.text for r in linededup.clean(docs(rows)).collect()}
    assert all(clean[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in want) for i, t in rows)
    report = {r.doc_id: r for r in linededup.line_report(docs(rows)).collect()}
    assert all(r.n_removed == len(r.removed) == sum(d == i for d, _ in want) for i, r in report.items())


def test_lines_of_rows_that_share_an_id(docs):
    a, b, c = "a line that many a text holds here", "unique precious sentence never seen elsewhere at all", "another one of its own kind in here"
    rows = [(1, a), (None, f"x y\n{a}"), (None, f"{c}\n{b}"), (9, f"{b} and more\n{a}"), (9, f"{c} too\nHome\nq"), (9, f"{c} too\nHome\nq"), ((1 << 63) - 1, f"Home\n{c}")]
    out = sorted(((r.doc_id, r.text) for r in linededup.clean(docs(rows)).collect()), key=repr)
    want = [(1, a), (None, "x y"), (None, b), (9, f"{b} and more"), (9, f"{c} too\nHome\nq"), (9, f"{c} too\nHome\nq"), ((1 << 63) - 1, c)]
    # the id 2**63 - 1 comes before null; c is one edit from "c too" under 9, which comes first; so is b in row 3 not: "and more" is two words
    want[6] = ((1 << 63) - 1, "")
    want[2] = (None, b)
    assert out == sorted(want, key=repr)


def test_a_clash_of_hashes_is_verified(docs, monkeypatch):
    real = linededup.Lines.variants
    # all replacement keys clash
    rng = random.Random(9)
    lines = [[f"v{rng.randrange(9)}" for _ in range(8)] for _ in range(40)] + [["same"] * 4 + [f"t{i}"] * 4 for i in range(6)]
    lines += [["same"] * 4 + ["t1"] * 3 + ["u"]]
    rows = [(i, " ".join(w)) for i, w in enumerate(lines)]
    spark = docs(rows).sparkSession
    picked = spark.createDataFrame([(i, t) for i, t in rows], "ord long, line string")
    variants = linededup._emit(picked)
    clashing = variants.selectExpr("if(kind = 0, 0, key) as key", "kind", "ord")
    want = {n: min(e) for n, w in enumerate(lines) if (e := [m for m in range(n) if near_lines(w, lines[m])])}
    for v in (variants, clashing):
        assert {r.ord: r.near for r in linededup._nearest(v, picked).collect()} == want
    assert want[46] == 41 and real is linededup.Lines.variants


def test_one_edit(spark):
    rng = random.Random(10)
    rows = [(" ".join(rng.choices("ab", k=rng.randrange(1, 6))), " ".join(rng.choices("ab", k=rng.randrange(1, 6)))) for _ in range(400)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", linededup.one_edit(linededup.F.col("a"), linededup.F.col("b")).alias("ok")).collect()
    assert all(r.ok == near_lines(r.a.split(), r.b.split()) for r in got)


def test_lines_without_a_map(docs, monkeypatch):
    rows = [(i, f"some words of a line number {i // 2} here\nthe last words of it, {i}") for i in range(12)]
    want = sorted(map(tuple, linededup.removed_lines(docs(rows)).collect()))
    monkeypatch.setattr(linededup.sieve, "MOST_BITS", 0)
    assert want and sorted(map(tuple, linededup.removed_lines(docs(rows)).collect())) == want


def test_line_hard_rows(edge, nothing):
    gone = sorted((r.doc_id, r.line_no, r.kept_doc_id) for r in linededup.removed_lines(edge).collect())
    assert gone == [(6, 0, 1), (7, 0, 5)], gone
    out = linededup.clean(edge)
    assert out.columns == edge.columns and out.count() == 9
    assert {r.doc_id: r.text for r in out.collect()}[2] is None
    assert linededup.line_report(nothing).collect() == [] and linededup.removed_lines(nothing).collect() == []


def alike(n, rng, share, size=300):
    """Pairs of texts, one word in so many replaced, with their similarity: (texts 2i and 2i + 1, similarity of pair i)."""
    out, sims = [], []
    for i in range(n):
        a = [f"p{i}w{rng.randrange(10**6)}" for _ in range(size)]
        b = [f"{x}new" if rng.random() < share else x for x in a]
        s, t = ({tuple(w[j : j + 5]) for j in range(size - 4)} for w in (a, b))
        out += [" ".join(a), " ".join(b)]
        sims.append(len(s & t) / len(s | t))
    return out, sims


def test_keep_one_finds_pairs_just_above_the_similarity(docs):
    t, sims = alike(400, random.Random(11), 0.0215)
    kept = {r.doc_id for r in simhash.keep_one(docs(list(enumerate(t)))).collect()}
    band = [i for i, s in enumerate(sims) if 0.8 <= s < 0.86]
    assert len(band) >= 100
    assert sum(2 * i + 1 in kept for i in band) <= 0.01 * len(band)
    assert all(2 * i in kept for i in range(400)) and all(2 * i + 1 in kept for i, s in enumerate(sims) if s < 0.8)


@pytest.mark.parametrize("elements", [simhash.ELEMENTS, 400])
def test_near_copies_that_hang_on_an_unlike_smallest(docs, spark, elements):
    rng = random.Random(12)
    w = [f"w{rng.randrange(10**6)}" for _ in range(300)]

    def edited(of, *at):
        return [f"{x}at{len(at)}" if i in at else x for i, x in enumerate(of)]

    a = edited(w, 10, 40, 70, 100, 130)
    c = edited(w, 160, 190, 220, 250, 280)
    # w links a and c, and d is nearly c; e is another one unlike all others
    rows = [a, w, c, edited(c, 295), edited(w, 20, 50, 80, 110, 140, 170, 200), edited(c, 5)]
    t = [" ".join(x) for x in rows]
    sets = [{tuple(x[i : i + 5]) for i in range(296)} for x in rows]
    sim = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert sim(0, 1) >= 0.8 and sim(1, 2) >= 0.8 and max(sim(0, i) for i in (2, 3, 5)) < 0.8 and sim(2, 3) >= 0.9
    want = []
    for i in range(6):
        if all(sim(i, j) < 0.8 for j in want):
            want.append(i)
    assert sorted(r.doc_id for r in simhash.keep_one(docs(list(enumerate(t))), elements=elements).collect()) == want
    # a false link: the smallest is like none
    far = [" ".join(f"far{i}" for i in range(300)), *t[2:4]]
    s = simhash._shingle_sets(spark.createDataFrame(list(enumerate(far)), "id long, text string"), 5)
    parts = spark.createDataFrame([(i, 0, i, 0) for i in range(3)], "id long, component long, d long, x long")
    assert [r.id for r in simhash._near_kept(parts, s, 0.8, elements).collect()] == [2]


@pytest.mark.parametrize("elements, block", [(simhash.ELEMENTS, 64), (600, 2)])
def test_large_groups_give_what_one_task_gives(spark, elements, block):
    rng = random.Random(13)
    base = [[f"g{g}w{i}" for i in range(60)] for g in range(6)]
    rows = []
    for i in range(80):
        w = list(rng.choice(base))
        w[rng.randrange(60)] = f"edit{i}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(w[i : i + 5]) for i in range(56)} for w in (t.split() for _, t in rows)]
    sim = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    kept = []
    for i in range(80):
        if all(sim(i, j) < 0.8 for j in kept):
            kept.append(i)
    s = simhash._shingle_sets(spark.createDataFrame(rows, "id long, text string"), 5)
    parts = spark.createDataFrame([(i, 0, i, 0) for i in range(80)], "id long, component long, d long, x long")
    gone = {r.id for r in simhash._near_kept(parts, s, 0.8, elements, block).collect()}
    assert sorted(set(range(80)) - gone) == kept


def test_keep_one_tells_rows_of_one_id_apart(docs):
    w = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(w)), (9, " ".join([*w, "end"])), (9, "quite another text under the same number, seen nowhere else"), (9, "quite another text under the same number, seen nowhere else")]
    assert sorted((r.doc_id, r.text[:5]) for r in simhash.keep_one(docs(rows)).collect()) == [(1, "w0 w1"), (9, "quite")]


def test_a_bucket_with_many_lookers(spark):
    rng = random.Random(14)
    # a hot bucket beside a small one: all fingerprints share their low 40 bits but for one
    rows = [(0, (rng.getrandbits(23) << 40), i) for i in range(600)] + [(0, (rng.getrandbits(23) << 40) | 1, 600 + i) for i in range(5)]
    rows = list({fp: (r, fp, i) for r, fp, i in rows}.values())
    df = spark.createDataFrame(rows, "r int, fp long, rep long")
    near = [(a[2], b[2]) for n, a in enumerate(rows) for b in rows[:n] if (a[1] ^ b[1]).bit_count() <= 4]
    want = groups(near, [i for *_, i in rows])
    for most in (8192, 16):
        edges = [(x.a, x.b) for x in simhash.links(df, 4, most).collect()]
        assert groups(edges, [i for *_, i in rows]) == want
