import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowloom.llm import decontaminate, mixing, pii, quality, toxicity, urls

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def auc(score, y):
    pos, neg = score[y == 1], score[y == 0]
    return ((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None])).mean()


# URL filters


def test_urls_against_every_rule(spark):
    rng = random.Random(1)
    hosts = ["example.org", "a.example.org", "EXAMPLE.ORG", "b.com", "fr.com", "xorg", "org", "spam-farm.net", "x.spam-farm.org", "notexample.org"]
    paths = ["", "/", "/es/x", "/en/1", "/en/12", "/fr/", "/fr", "/de/a?x=/fr/", "/adserver/x", "/casino", "/casino/y#z", "/p\nq"]
    rows = [(i, f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(paths)}") for i in range(300)]
    rows += [(900, None), (901, "no scheme"), (902, "://"), (903, ""), (904, "http://a.org/" + "x" * 50_000), (5, "http://b.com/fr/"), (5, "http://b.com/fr/")]
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit(1))).collect()]

    def judge(i, u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(r), r, a) for r, a in urls.HOST_RULES for h, p in [(r.split("/")[0], "/" + r.split("/", 1)[1])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            return i, host, path, max(fits)[1], max(fits)[2]
        return i, host, path, None, "block" if any(re.search(urls.pattern_regex(p), host + path) for p in urls.PATTERNS) else "allow"

    assert sorted(got, key=repr) == sorted((judge(*r) for r in rows), key=repr)
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(none).collect() == []
    assert {r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), (), ()).collect()} == {"allow"}


def test_pattern_lists(spark, tmp_path):
    texts = ["||example.org/en/1", "ads*/x/", "plain", "||a-b.c/*/d?e=1", "/x.y/(z)", "@@/ads/good/", "||t.*.u/"]
    rows = {r.rule: r for r in urls.rule_table(spark, (), tuple(texts)).collect()}
    assert all(rows[t].regex == urls.pattern_regex(t.removeprefix("@@")) for t in texts) and rows["@@/ads/good/"].action == "allow"
    assert [rows[t].tokens for t in texts[:3]] == [["en", "example", "org"], ["x"], []]
    (tmp_path / "list.txt").write_text("! a comment\n\n/ads/\n@@/ads/good/\n||bad.com/\n" + "".join(f"/never{i}/\n" for i in range(500)))
    pages = spark.createDataFrame([(1, "http://x.org/ads/1"), (2, "http://x.org/ads/good/1"), (3, "http://y.bad.com/"), (4, "http://notbad.com/"), (5, "http://x.net/never77/")], "page_id long, url string")
    got = urls.judge(pages, (), urls.read_patterns(spark, str(tmp_path / "list.txt")))
    assert {r.page_id: r.verdict for r in got.collect()} == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "block"}


# mixing


def fill(sizes):
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, target, full = 1.5 * sum(sizes.values()), {}, set()
    while True:
        open_ = [s for s in sizes if s not in full]
        rest = left - sum(2 * sizes[s] for s in full)
        target = {s: 2 * sizes[s] if s in full else rest * weights[s] / sum(weights[o] for o in open_) for s in sizes}
        over = {s for s in open_ if target[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def test_mix_meets_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 200)), rng.choice(["a", "b", "c", "d", "é", None]) if i % 3 else "hot") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    by = {r.doc_id: r for r in got}
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += len(t.split())
        assert by[i].size == len(t.split()) and 0 <= by[i].taken <= 2 * by[i].size and by[i].taken == by[i].copies * by[i].size
    want = fill(sizes)
    for s in sizes:
        own = [by[i] for i, _, x in rows if x == s]
        assert own[0].source_size == sizes[s] and own[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in own) - want[s]) <= 100
    again = {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_mix_solves_the_dual(spark):
    rng = random.Random(16)
    hist = {"a": Counter(rng.randrange(1, 300) for _ in range(500)), "b": Counter(rng.randrange(1, 40) for _ in range(200)), "full": Counter([5, 6])}
    size = {k: sum(s * n for s, n in h.items()) for k, h in hist.items()}
    target = {"a": 1.3 * size["a"], "b": 0.2 * size["b"], "full": 2.0 * size["full"]}
    rows = spark.createDataFrame([(k, s, n) for k, h in hist.items() for s, n in h.items()], "k string, size long, n long")
    goals = spark.createDataFrame([(k, target[k], 2.0 * size[k]) for k in hist], "k string, target double, limit double")
    got = {r.k: r for r in mixing.balance(rows, goals, 3).collect()}
    assert got["full"].lam is None
    for k in "ab":
        mean = size[k] / sum(hist[k].values())
        taken = lambda lam: sum(s * n * 2 / (1 + np.exp(-np.clip(lam * s / mean, -700, 700))) for s, n in hist[k].items())  # noqa: B023, E731
        lo, hi = -50.0, 50.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if taken(mid) < target[k] else (lo, mid)
        assert got[k].mean == pytest.approx(mean) and got[k].lam == pytest.approx(lo, abs=1e-6)


def test_targets_of_many_sources(spark):
    rng = random.Random(17)
    sizes = {f"s{i:03}": rng.choice([0, 1, 5, 40, 1000]) for i in range(200)} | {None: 77}
    per = spark.createDataFrame([(f"k{s}", s, n) for s, n in sizes.items()], "k string, source string, source_size long")
    want = fill(sizes)
    assert all(r.target == pytest.approx(want[r.source]) for r in mixing.targets(per).collect())


def test_mix_hard_rows(edge, nothing):
    got = mixing.mix(edge).collect()
    assert len(got) == 9 and all(r.taken <= 2 * r.size for r in got) and mixing.mix(nothing).collect() == []


# decontamination


def test_leaks_against_all_windows(spark, docs):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([3, 4, 5, 6, 12, 25, 40, 40, 60])] + [(20, None), (21, "")]
    rows = []
    for i in range(120):
        w = rng.choices(vocabulary, k=rng.randrange(0, 150))
        if i % 2:
            leak = rng.choice(items[:9])[1].split()
            for _ in range(rng.randrange(3)):
                leak[rng.randrange(len(leak))] = "EDIT"
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() for x in leak]
        rows.append((i, "  ".join(w)))

    def sets(w, k):
        return Counter(tuple(w[i : i + k]) for i in range(max(0, len(w) - k + 1)))

    want = {}
    for i, t in rows:
        w = t.lower().split()
        for j, x in items[:9]:
            x = x.split()
            k, own = min(5, len(x)), sets(x, min(5, len(x)))
            best = max([2 * sum((own & (s := sets(w[a : a + len(x)], k))).values()) / max(1, sum(own.values()) + sum(s.values())) for a in range(max(1, len(w) - len(x) + 1))])
            if best >= 0.8:
                want[i, j] = best
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 300):
        got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(docs(rows), bench, block_bytes=block).collect()}
        assert set(got) <= set(want) and all(got[p] == pytest.approx(want[p]) for p in got)
        assert len(got) >= 0.97 * len(want) and {p for p, s in want.items() if s >= 0.9} <= set(got)
        kept = {r.doc_id for r in decontaminate.drop_contaminated(docs(rows), bench, block_bytes=block).collect()}
        assert kept == {i for i, _ in rows} - {i for i, _ in got}


def test_leaks_just_above_the_threshold(spark, docs):
    rng = random.Random(5)
    items = [[f"i{i}w{j}" for j in range(29)] for i in range(400)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    rows = []
    for i, w in enumerate(items):
        at = rng.randrange(5, 24)  # one word changes five of 25 shingles: similarity 0.80
        rows.append((i, " ".join(["before", *w[:at], "EDIT", *w[at + 1 :], "after"])))
    got = decontaminate.find_leaks(docs(rows), bench).collect()
    assert {r.similarity for r in got} == {0.8} and all(r.doc_id == r.item_id for r in got)
    assert len(got) >= 0.99 * len(items)


def test_an_item_without_an_id(spark, docs):
    bench = spark.createDataFrame([(None, "one two three four five six seven eight nine"), (4, "a b c d e f g")], "item_id long, text string")
    rows = [(1, "so one two three four five six seven eight nine it is"), (2, "quite clean words"), (3, "a b c d e f g")]
    for block in (decontaminate.BLOCK_BYTES, 20):
        assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(rows), bench, block_bytes=block).collect()} == {(1, None), (3, 4)}
        assert [r.doc_id for r in decontaminate.drop_contaminated(docs(rows), bench, block_bytes=block).collect()] == [2]


def test_many_items():
    rng = random.Random(19)
    items = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(20))) for i in range(20_000)]
    began = time.perf_counter()
    index = decontaminate.Items(items)
    text = " ".join(" ".join(f"z{j}" for j in range(30)) + " " + items[i][1] for i in range(40)).encode()
    got = list(index.find(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 0.8))
    assert {r[1] for r in got} == set(range(40)) and time.perf_counter() - began < 30


def test_leak_hard_rows(spark, edge, nothing):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.find_leaks(edge, bench).collect()) == [1, 6, 6]
    assert decontaminate.drop_contaminated(edge, bench).count() == 6 and decontaminate.drop_contaminated(edge, bench).columns == edge.columns
    assert decontaminate.find_leaks(edge, bench.limit(0)).collect() == [] and decontaminate.drop_contaminated(edge, bench.limit(0)).count() == 9
    assert decontaminate.find_leaks(nothing, bench).collect() == []


# classifiers


def labelled(spark, n, text, name, folds):
    rng = random.Random(12)
    rows = [(i, *text(rng)) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], f"doc_id long, {name} int")
    return docs, labels, {i: y for i, _, y in rows}, {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % folds[0] == folds[1]}


def prose(rng, n):
    return " ".join("".join(rng.choices(["th", "er", "on", "an", "re", "he", "in"], k=rng.randrange(1, 4))) for _ in range(n))


def judged(frame, y, held):
    rows = [r for r in frame.collect() if r.held_out]
    assert {r.doc_id for r in rows} == held and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    return auc(np.array([r.score for r in rows]), np.array([y[r.doc_id] for r in rows])), rows


def test_toxicity_held_out(spark):
    def text(rng):
        bad = rng.random() < 0.25
        w = prose(rng, rng.randrange(20, 80)).split()
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["zorg", "zorgish", "zorgly", "blurp"])
        return " ".join(w), int(bad)

    docs, labels, y, held = labelled(spark, 1200, text, "toxic", (3, 1))
    a, rows = judged(toxicity.scores(docs, labels), y, held)
    assert a > 0.97 and np.mean([r.predicted == y[r.doc_id] for r in rows]) > 0.95


def test_quality_held_out(spark):
    def text(rng):
        bad = rng.random() < 0.25
        t = prose(rng, rng.randrange(60, 160))
        return (rng.choice([t.upper().replace(" ", "!! "), t.replace(" ", "%%% "), " ".join([t.split()[0]] * 100)]) if bad else t), int(not bad)

    docs, labels, y, held = labelled(spark, 800, text, "quality", (4, 2))
    a, rows = judged(quality.scores(docs, labels), y, held)
    assert a > 0.97
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    good = {i for i in y if y[i]}
    assert len(good - kept) <= 0.02 * len(good) and len(kept - good) <= 0.2 * (len(y) - len(good))


SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name, folds, held, least", [("toxic", 3, 1, (0.95, 0.85, 0.88)), ("quality", 4, 2, (0.99, 0.97, 0.97))])
def test_classifiers_on_the_labelled_documents(name, folds, held, least):
    docs = pd.read_parquet(f"{SF}/documents.parquet").merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    fold = docs.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % folds)
    rows, test = [], docs[fold == held]
    for v in (0, 1):
        own = docs[(fold != held) & (docs[name] == v)]
        rows += [(t, v, f, i, len(own) / min(len(own), 2000)) for t, f, i in list(zip(own.text, fold[own.index], own.doc_id, strict=True))[:2000]]
    if name == "toxic":
        model, score = toxicity.train(rows), np.zeros(len(test))
        for i, t in toxicity.texts_of(pa.array(test.text.tolist())):
            score[i : i + len(t.first)] = model.scores(t)
    else:
        score = quality.fit(rows).scores(test.text.tolist())
    y, hit = test[name].to_numpy(), score >= 0.7
    got = (auc(score, y), (y[hit] == 1).mean(), hit[y == 1].mean())
    assert all(g >= w for g, w in zip(got, least, strict=True)), got


@pytest.mark.parametrize("op, name", [(toxicity.scores, "toxic"), (quality.scores, "quality")])
def test_classifier_hard_rows(spark, edge, nothing, op, name):
    none = spark.createDataFrame([], f"doc_id long, {name} int")
    got = op(edge, none).collect()
    assert len(got) == 9 and all(r.score == 0.5 and r.predicted == 0 for r in got) and not [r for r in got if r.doc_id is None and r.held_out]
    some = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (5, 0), (6, 1), (7, 0), (4, 0)], f"doc_id long, {name} int")
    assert all(0 <= r.score <= 1 for r in op(edge, some).collect()) and op(nothing, some).collect() == []


# personal data


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(t):
    def ok(k, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": k != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]

    return sorted((m.start(), n, k, m.end()) for n, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, t or "") if ok(k, m[0]))


HARD_PII = [
    "a@b.c d@e.f.g, x@y", "a.b%c@d-e.f%g@h.i.j", "1.2.3.4.5.6.7.8 1.2.3.256 999.1.1.1 0001.02.3.255", "4111 1111-1111 1111 and 4111111111111112", "+1 (235) 555-2058. +12 3", "é+44 20 7946 0958日本a@b.co",
    "@ @@ a@ .@b.c", "1" * 4000, "a" * 4000 + "@", "a@" + ".".join("b" * 3000), "1.2.3" * 500, "000000000000", "", " ", "+1" + "." * 3000, "1 2-3 4-5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1", None, "5500-0000-0000-0004+15500000000",
]


def test_pii_against_plain_patterns(docs, nothing):
    rng = random.Random(7)
    rows = list(enumerate(HARD_PII + ["".join(rng.choices("a1.@+- ()\n9é", k=rng.randrange(60))) for _ in range(400)]))
    rows.append((3, HARD_PII[3]))
    got = pii.report(docs(rows)).collect()
    assert len(got) == len(rows)
    of = dict(rows)
    for r in got:
        s = plain_spans(of[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for a, _, k, b in s)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (of[r.doc_id], r.spans, line)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[2] == k for x in s) for k in pii.KINDS]
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))
    assert pii.report(nothing).collect() == []


def test_disclosing_terms(docs):
    rows = [(i, f"write to Zyx Qwert at zq@mail.org about thing number{i}") for i in range(4)] + [(10 + i, f"write about a thing to number{i}, Bob at home") for i in range(40)]
    got = {r.doc_id: r.spans for r in pii.report(docs(rows)).collect()}
    text = dict(rows)
    terms = lambda i: {text[i][int(a) : int(b)] for k, a, b in (x.split(":") for x in got[i].split(",")) if k == "term"}
    assert all(terms(i) == {"Zyx", "Qwert"} for i in range(4)) and not any(got[i] for i in range(10, 50))
    out = {r.doc_id: r.text for r in pii.sanitise(docs(rows)).collect()}
    assert out[0] == "write to   at [email] about thing number0" and out[10] == text[10]


def term_spans(frame, text):
    return {r.doc_id: [text[r.doc_id][int(a) : int(b)] for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "term"] for r in frame.collect()}


def test_terms_disclose_in_every_place_of_every_text(docs):
    far = "and much more is said here in many a word, far beyond the reach of a line's side,"
    rows = [(i, f"Zyx Qwert\n{far} {far}\nzq@mail.org about thing") for i in range(9)]
    rows += [(20, f"ask zyx, {far}\nor Zyx")] + [(30 + i, f"{far} about thing with Bob") for i in range(60)]
    got = term_spans(pii.report(docs(rows)), dict(rows))
    assert all(got[i] == ["Zyx", "Qwert"] for i in range(9)) and got[20] == ["zyx", "Zyx"]
    assert not any(got[30 + i] for i in range(60))
    assert {r.doc_id: r.text for r in pii.sanitise(docs(rows)).collect()}[20] == f"ask , {far}\nor "


def test_terms_of_data_that_are_in_one_text_each(docs):
    rows = [(i, f"the Acmeco office has write{i}@acme.org at hand") for i in range(6)] + [(10 + i, f"the office is at hand, {i}") for i in range(60)]
    got = term_spans(pii.report(docs(rows)), dict(rows))
    assert all(set(got[i]) == {"Acmeco", "has"} for i in range(6)) and not any(got[10 + i] for i in range(60))


def test_very_many_spans_and_long_texts(docs):
    ips = " ".join(f"10.{i // 65536 % 256}.{i // 256 % 256}.{i % 256}" for i in range(60_000))
    text = f"{ips} é and the rest"
    began = time.perf_counter()
    got = pii.report(docs([(1, text), (2, "no data")])).collect()
    r = next(x for x in got if x.doc_id == 1)
    assert r.n_ip == 60_000 and r.spans.endswith(f"ip:{len(ips) - len(ips.split()[-1])}:{len(ips)}")
    out = {x.doc_id: x.text for x in pii.sanitise(docs([(1, text), (2, "no data")])).collect()}
    assert out[1].split(" é")[0] == " ".join(["[ip]"] * 60_000) and out[2] == "no data"
    assert time.perf_counter() - began < 120


def test_cut_out(spark):
    rng = random.Random(15)
    rows = []
    for i in range(60):
        text = "".join(rng.choices("abcdé日", k=rng.randrange(0, 400)))
        at = [rng.randrange(len(text) + 1) for _ in range(2 * rng.randrange(0, 150))]
        rows.append((i, text, sorted((min(p), max(p)) for p in zip(at[::2], at[1::2], strict=True))))
    df = spark.createDataFrame(rows, "i int, text string, spans array<struct<start: int, end: int>>")
    name = lambda x, at: F.when(x["start"] == at, "_").otherwise("")
    got = {r.i: r.out for r in df.select("i", pii.cut_out(F.col("text"), F.col("spans"), name).alias("out")).collect()}
    for i, text, spans in rows:
        want, upto = "", 0
        for a, b in spans:
            if a >= upto:
                want += text[upto:a] + "_"
            upto = max(upto, b)
        assert got[i] == want + text[upto:]


def test_terms_against_plain_counts(docs):
    rng = random.Random(18)
    people = [(f"p{i}@mail{i % 3}.org", f"Name{i}") for i in range(6)]
    common = [f"common{i}" for i in range(12)]
    rows = []
    for i in range(90):
        w = rng.choices(common, k=8)
        if i % 2:
            mail, name = rng.choice(people)
            w[rng.randrange(8)] = mail
            if rng.random() < 0.8:
                w.insert(0, name)
        rows.append((i, " ".join(w)))
    mails = {i: {x for x in t.split() if "@" in x} for i, t in rows}
    entities = {i: {f"m:{m}" for m in ms} | {"d:" + m.split("@")[1] for m in ms} for i, ms in mails.items()}
    words = {i: {x.lower() for x in t.split() if "@" not in x} for i, t in rows}
    n_e, n_t = Counter(e for es in entities.values() for e in es), Counter(w for ws in words.values() for w in ws)
    both = Counter((e, w) for i in words for e in entities[i] for w in words[i])
    telling = {w for (e, w), n in both.items() if n >= 3 and np.log(90 * n / (n_e[e] * n_t[w])) / np.log(90 / n_e[e]) >= 0.9}
    assert telling and len(telling) < len(n_t)
    got = term_spans(pii.report(docs(rows)), dict(rows))
    assert all(got[i] == [x for x in t.split() if x.lower() in telling] for i, t in rows)


def test_pii_hard_rows(edge):
    assert pii.report(edge).count() == 9 and pii.sanitise(edge).columns == edge.columns and pii.sanitise(edge).count() == 9
