import gzip
import json
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from rowloom.functions import display, paths
from rowloom.operators import trees
from rowloom.operators.tables import compare_tables
from rowloom.plans import project
from rowloom.plans.options import CompareError, UsageError
from rowloom.sources import delimited, encoding, files, sinks
from rowloom.streaming import watch


def read(spark, path, **o):
    return delimited.read_table(spark, delimited.resolve(spark, str(path), **o))


def test_csv_dialects(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.tsv"
    a.write_text('id,note\n1,"hello, ""world"""\n\n2,"line1\nline2"\n3,\n')
    b.write_text('id\tnote\n1\t"raw\n')
    assert [tuple(r) for r in read(spark, a).collect()] == [("1", 'hello, "world"'), ("2", "line1\nline2"), ("3", "")]
    assert [tuple(r) for r in read(spark, b).collect()] == [("1", '"raw')]
    (tmp_path / "c.csv").write_text("﻿1,alpha\n2,beta\n")
    assert sorted(map(tuple, read(spark, tmp_path / "c.csv", has_header=False).collect())) == [("1", "alpha"), ("2", "beta")]
    with gzip.open(tmp_path / "d.csv.gz", "wt") as f:
        f.write("id,v\n1,x\n")
    assert read(spark, tmp_path / "d.csv.gz").count() == 1
    (tmp_path / "e.txt").write_text("a\tb\n1\t2\n")
    assert delimited.resolve(spark, str(tmp_path / "e.txt")).delimiter == "\t"
    (tmp_path / "f.csv").write_text("a,b\n1\n")
    with pytest.raises(Exception):
        read(spark, tmp_path / "f.csv").collect()
    for bad in ("", "ab", '"', "\n"):
        with pytest.raises(UsageError):
            delimited.delimiter(bad)
    i = delimited.inspect(spark, delimited.resolve(spark, str(a)), delimited.resolve(spark, str(a)))
    assert i["key"] == ["id", "note"] and not i["reordered"]


def test_result_files(spark, tmp_path, text_table):
    d = compare_tables(text_table("id,v", "1, a ", "2,b"), text_table("id,v", "1,c", "3,d"), keys=["id"], cell_diff=True)
    sinks.write_tsv(d, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert "CHANGED\tleft\tv\t1\t a \n" in text
    sinks.write_jsonl(d, str(tmp_path / "json"))
    rows = [json.loads(x) for p in (tmp_path / "json").glob("part-*") for x in p.read_text().splitlines()]
    assert {r["kind"] for r in rows} == {"CHANGED", "LEFT_ONLY", "RIGHT_ONLY"} and all("new" not in r for r in rows if r["kind"] == "LEFT_ONLY")
    s = sinks.write_summary(d, str(tmp_path / "summary.json"))
    assert s["diff_rows"] == 4 and json.loads((tmp_path / "summary.json").read_text())["column_changes"] == [{"index": 1, "name": "v", "changes": 1}]
    assert sinks.page(d.rows(), 1, ["_diff", "_side", "id"], 3).count() == 1
    assert sinks.search(d.rows(), "C", columns=["v"]).count() == 1 and sinks.search(d.rows(), "C", case=True, columns=["v"]).count() == 0


def test_trees(spark, tmp_path):
    old, new = tmp_path / "old", tmp_path / "new"
    for root, content in ((old, {"same.txt": "s", "gone.txt": "g", "sub/changed.csv": "1", "sizediff.txt": "ab", "skip.tmp": "x"}), (new, {"same.txt": "s", "brandnew.txt": "n", "sub/changed.csv": "2", "sizediff.txt": "abc"})):
        for name, text in content.items():
            (root / name).parent.mkdir(parents=True, exist_ok=True)
            (root / name).write_text(text)
    os.utime(old / "sub/changed.csv", (10**9, 10**9))
    os.utime(new / "sub/changed.csv", (10**9, 10**9))
    for root, t in ((old, b"same"), (new, b"same")):
        with gzip.GzipFile(root / "z.gz", "wb", mtime=1 if root == old else 2, compresslevel=1 if root == old else 9) as f:
            f.write(t)
    a, b = files.read_tree(spark, str(old)), files.read_tree(spark, str(new))
    only = paths.PathFilter(exclude=("*.tmp",))
    r = trees.compare_trees(a, b, only=only)
    got = {x.path: x.status for x in r.collect()}
    assert got == {"same.txt": "same", "gone.txt": "removed", "brandnew.txt": "added", "sub/changed.csv": "changed", "sizediff.txt": "changed", "z.gz": "same"}
    assert trees.counts(r).first().asDict() == {"added": 1, "removed": 1, "changed": 2, "same": 2}
    for method in ("quick", "date", "size"):
        assert {x.path: x.status for x in trees.compare_trees(a, b, method).collect()}["sub/changed.csv"] == "same"
    assert {x.folder: x.total for x in trees.rollup(r).collect()} == {"": 6, "sub": 1}
    assert [x.path for x in trees.select_entries(r, "different", "S").collect()] == ["sizediff.txt", "sub/changed.csv"]
    with pytest.raises(CompareError):
        trees.compare_trees(a, b, max_entries=2)
    with zipfile.ZipFile(tmp_path / "n.zip", "w") as z:
        for p in new.rglob("*"):
            if p.is_file():
                z.write(p, p.relative_to(new))
    with tarfile.open(tmp_path / "n.tar.gz", "w:gz") as t:
        t.add(new, ".")
    for archive in ("n.zip", "n.tar.gz"):
        both = trees.compare_trees(b, files.read_tree(spark, str(tmp_path / archive)))
        assert {x.status for x in both.collect()} == {"same"}
    with pytest.raises(CompareError):
        list(files.archive_entries(str(tmp_path / "n.zip"), archive_bytes=3))


@pytest.mark.parametrize("glob, name, hit", [
    ("*.txt", "a/b.txt", True), ("build/**", "build", True), ("build/**", "build/x/y", True), ("**/x.c", "x.c", True), ("**/x.c", "a/b/x.c", True), ("a/*.c", "a/b/x.c", False), ("[ab].c", "b.c", True), ("[", "[", False), ("?.c", "xx.c", False), ("src/**/t.go", "src/t.go", True),
])
def test_globs(spark, glob, name, hit):
    assert spark.createDataFrame([(name,)], "path string").filter(paths.matches_glob(F.col("path"), glob)).count() == hit


def test_filter_language(spark):
    rows = spark.createDataFrame([("a/big.TXT", 3 << 20, 0), ("old/x.tmp", 10, 86400), (".hid/y", 5, 0)], "path string, size long, t long").withColumn("mtime", F.timestamp_seconds("t"))
    pick = lambda e: sorted(r.path for r in rows.filter(paths.expression(e)).collect())
    assert pick("size >= 1MiB") == ["a/big.TXT"] and pick("ext == .TXT") == ["a/big.TXT"] and pick("ext == .txt") == [] and pick("not (ext == '.tmp' or size > 1k)") == [".hid/y"]
    assert pick('path =~ "^old/" and mtime >= 1970-01-02') == ["old/x.tmp"] and pick("name == y or size < 6 and size > 6") == [".hid/y"]
    for bad in ("size", "size >", "nope == 1", "(size > 1", "size > 1 )", "name < x", "size > many"):
        with pytest.raises(UsageError):
            paths.expression(bad)
    assert paths.byte_size("1.5GiB") == 3 << 29


def test_encodings():
    for name in ("shift_jis", "euc-jp", "iso-2022-jp", "utf-8"):
        data = "日本語のテキスト、漢字とひらがな。".encode(encoding.CODECS[name])
        assert encoding.detect(data) == name and encoding.decode(data).startswith("日本語")
    assert encoding.detect("plain text".encode("utf-16-le")) == "utf-16le" and encoding.detect(b"\xfe\xff\0a") == "utf-16be"
    assert encoding.is_binary(b"a\0b\1c\2dddddddddddd") and not encoding.is_binary("plain text".encode("utf-16-be"))
    p = encoding.profile("一\r\n二".encode("cp932"))
    assert (p.encoding, p.line_ending, p.final_newline) == ("shift_jis", "\r\n", False) and encoding.restore(["一", "二"], p) == "一\r\n二".encode("cp932")
    with pytest.raises(CompareError):
        encoding.restore(["😀"], p)


def test_documents_and_projects(spark, tmp_path):
    (tmp_path / "j.txt").write_bytes("日本\r\n".encode("cp932"))
    assert files.read_document(spark, str(tmp_path / "j.txt"), enc="sjis").first().text == "日本\r\n"
    (tmp_path / "bin").write_bytes(b"a\0b\1\2\3\4\5\6\7")
    with pytest.raises(Exception):
        files.read_document(spark, str(tmp_path / "bin")).collect()
    assert {r.name for r in files.list_folder(spark, str(tmp_path)).collect()} == {"j.txt", "bin"}
    at = str(tmp_path / "p.json")
    project.save(project.Project("text", str(tmp_path / "a"), str(tmp_path / "b")), at)
    assert json.loads(open(at).read())["left"] == "a" and project.load(at).right == str(tmp_path / "b")
    (tmp_path / "q.json").write_text('{"version": 2}')
    with pytest.raises(UsageError):
        project.load(str(tmp_path / "q.json"))
    with pytest.raises(UsageError):
        project.distinct_output(at, at)


def test_display():
    assert display.width("日本") == 4 and display.width("é") == 1 and display.width("👩‍👩‍👧") == 2
    assert display.truncate("日本語テキスト", 7) == "日本..." and display.truncate("abc", 2) == ".." and display.pad("a", 3) == "a  "
    assert display.inline("a\n\t\x01") == "a\\n\\t\\u0001"


def test_watching(spark, tmp_path):
    f = tmp_path / "w.txt"
    f.write_text("1")
    before = watch.snapshot([str(f)])
    assert watch.wait_for_change([str(f)], before, timeout=0.1, every=0.02) is None
    f.write_text("22")
    assert watch.wait_for_change([str(f)], before, timeout=1) is not None
    with pytest.raises(UsageError):
        watch.snapshot([str(tmp_path)])
    spark.range(3).write.parquet(str(tmp_path / "in"))
    seen = []
    q = watch.recompare(spark, str(tmp_path / "in"), "id long", lambda d, n: seen.append(d.count()), str(tmp_path / "cp"), available_now=True)
    q.awaitTermination(60)
    assert sum(seen) == 3
    stats = spark.createDataFrame([("a", 1, 0), ("a", 1, 0), ("a", 2, 0), ("b", 1, 0)], "path string, size long, t long").withColumn("mtime", F.timestamp_seconds("t")).drop("t").coalesce(1)
    stats.write.parquet(str(tmp_path / "stats"))
    stream = watch.changes(spark.readStream.schema(stats.schema).parquet(str(tmp_path / "stats")))
    q = stream.writeStream.format("memory").queryName("watched").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("watched").count() == 3


def test_extension_and_classes(spark):
    from pyspark.sql import functions as F

    from rowloom.functions import paths

    names = ["a/x.TXT", "a/x.txt", "bx", "!x", "ax", "]x", "-x", "noext", "a.b/c"]
    df = spark.createDataFrame([(n,) for n in names], "path string").withColumns({"size": F.lit(0), "mtime": F.lit(0).cast("timestamp")})
    hit = lambda c: [r.path for r in df.filter(c).collect()]
    assert hit(paths.expression("ext == '.txt'")) == ["a/x.txt"] and hit(paths.expression("ext == ''")) == ["bx", "!x", "ax", "]x", "-x", "noext", "a.b/c"]
    match = lambda g: hit(paths.matches_glob(F.col("path"), g))
    assert match("[!a]x") == ["!x", "ax"] and match("[^a]x") == ["bx", "!x", "]x", "-x"] and match("[\\]\\-]x") == ["]x", "-x"]
    assert match("[a-c]x") == ["bx", "ax"] and match("[c-a]x") == match("[]a]x") == match("[a") == []


def test_detection_by_pairs_and_zero_bytes():
    from rowloom.sources.encoding import detect

    assert detect("漢字かな交じりの文".encode("euc_jp")) == "euc-jp" and detect("漢字かな交じりの文".encode("cp932")) == "shift_jis"
    assert detect(b"\x1b(Jabc") == "utf-8" and detect(b"\x1b$(Dxx") == "iso-2022-jp"
    assert detect("ab日本語の文書です".encode("utf-16-le")) != "utf-16le" and detect("abcd".encode("utf-16-be")) == "utf-16be"
    assert detect(b"a\0b\0\0c\0d") not in ("utf-16le", "utf-16be")


def test_a_zero_byte_before_a_short_text_is_binary(spark, tmp_path):
    import duckdb

    from rowloom.file_queries import binary_guard_documents
    from rowloom.queries import ORACLES

    for text in ("abc", "Von.", "€", "Ñoñ", "ab", "a", ""):
        assert encoding.is_binary(b"\0" + text.encode())
    for text, codec in (("ab", "utf-16-le"), ("ab", "utf-16-be"), ("5€", "utf-16-le"), ("€5", "utf-16-le"), ("Von.", "utf-16-be")):
        assert not encoding.is_binary(text.encode(codec)) and encoding.decode(text.encode(codec)) == text
    texts = ["", "a", "ab", "abc", "Von.", "It a.", "€", "Ñoñ", None]
    rows = [(5 * i + k, t) for i, t in enumerate(texts) for k in range(5)] + [(-5, "abc"), (None, "abc")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = binary_guard_documents(spark, str(tmp_path)).collect()
    want = duckdb.sql(ORACLES["binary_guard_documents"].replace("documents", f"'{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_tree_through_a_file_system(spark, tmp_path):
    import zipfile

    df = spark.createDataFrame([("a/b.txt", b"one"), (".hidden", b""), ("c/_x", None)], "path string, content binary")
    at = f"file://{tmp_path}/tree"
    assert files.write_tree(df, at) == 3
    (tmp_path / "tree" / "link").symlink_to(tmp_path / "tree" / ".hidden")
    got = {r.path: (r.size, bytes(r.content)) for r in files.read_tree(spark, at).collect()}
    assert got == {"a/b.txt": (3, b"one"), ".hidden": (0, b""), "c/_x": (0, b"")}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/side", "text")
    assert [(r.path, bytes(r.content)) for r in files.read_tree(spark, f"file://{tmp_path}/z.zip").collect()] == [("in/side", b"text")]
    (tmp_path / "l.txt").write_bytes(b"one\r\ntwo\n" + b"x" * 100)
    assert [r.line for r in files.read_lines(spark, str(tmp_path / "l.txt")).collect()] == ["one", "two", "x" * 100]
    with pytest.raises(Exception, match="too long"):
        files.read_lines(spark, str(tmp_path / "l.txt"), max_line=50).collect()


@pytest.mark.parametrize("codec, mark, end", [("cp932", b"", "\r\n"), ("euc_jp", b"", "\n"), ("utf-8", b"\xef\xbb\xbf", "\n"), ("utf-8", b"", "\r\n")])
def test_three_way_merge_of_files_keeps_the_profile(spark, tmp_path, codec, mark, end):
    from rowloom.plans.options import TableOptions
    from rowloom.sources import merge

    def put(name, *rows):
        (tmp_path / name).write_bytes(mark + (end.join(["id,名前", *rows]) + end).encode(codec))
        return str(tmp_path / name)

    text = "日本語の長い文章です"
    files_ = put("b.csv", f"1,{text}", "2,二番", '3,"a, b"'), put("l.csv", f"1,{text}改", "2,二番", '3,"a, b"'), put("r.csv", f"1,{text}", "2,二番", '3,"a, c"', "4,新")
    m = merge.compare_files(spark, *files_, TableOptions(keys=["id"]))
    assert m.write(f"file://{tmp_path}/out") == 4
    got = b"".join(p.read_bytes().removeprefix(mark) for p in sorted((tmp_path / "out").glob("part-*"))).decode(codec).split(end)
    assert [x for x in got if x and not x.startswith("id")] == [f"1,{text}改", "2,二番", '3,"a, c"', "4,新"]
    assert all(p.read_bytes().startswith(mark) for p in (tmp_path / "out").glob("part-*"))


def test_ragged_records_are_located(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\n1\t2\n3\n4\t5\t6\n")
    i = delimited.resolve(spark, str(tmp_path / "t.tsv"))
    assert [tuple(r) for r in delimited.ragged(spark, i).collect()] == [("t.tsv", 2, 1), ("t.tsv", 3, 3)]


def test_watches_are_bounded(tmp_path):
    held = [watch._WATCHES.acquire(blocking=False) for _ in range(watch.MOST_WATCHES)]
    try:
        assert all(held)
        with pytest.raises(UsageError):
            watch.wait_for_change([str(tmp_path / "x")], timeout=0)
    finally:
        for _ in held:
            watch._WATCHES.release()
