"""Registered queries of sources, sinks, renderings and text operators, and DuckDB SQL that gives the same rows.

Sources and sinks go through files that the query writes to the shared folder first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions import display, encode, paths
from rowloom.operators import binary, lines, threeway, trees, words
from rowloom.operators.tables import compare_tables
from rowloom.plans.options import CompareError, Rules, TableOptions
from rowloom.queries import (
    CUSTOMER, CUSTOMER_LEFT, CUSTOMER_RIGHT, PART_LEFT, PART_RIGHT, TREE_SQL, any_differs, customer_diff, derived, ids_sql,
    lineitem_diff, multiset_sql, page_trees, query, table, unique_sql, LINEITEM_LEFT, LINEITEM_RIGHT,
)
from rowloom.sources import delimited, encoding, files, render, scratch, sinks
from rowloom.streaming import watch

PART_TEXT = "select cast(p_partkey as varchar) as p_partkey, p_name, p_brand, cast(p_size as varchar) as p_size from part"


def part(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")


# delimited text


@query(PART_TEXT)
def source_csv_part(spark, sf_dir):
    at = scratch.path(spark, "part.csv")
    sinks.write_delimited(part(spark, sf_dir), at, ",")
    return delimited.read_table(spark, delimited.resolve(spark, at))


@query(PART_TEXT)
def source_tsv_simple_part(spark, sf_dir):
    at = scratch.path(spark, "part.tsv")
    sinks.write_delimited(part(spark, sf_dir), at, "\t")
    found = delimited.resolve(spark, at)
    assert (found.parser, found.delimiter) == ("simple", "\t")
    return delimited.read_table(spark, found)


@query(PART_TEXT)
def source_sniffed_gzip_part(spark, sf_dir):
    at = scratch.path(spark, "part.txt.gz")
    sinks.write_delimited(part(spark, sf_dir), at, "\t")
    return delimited.read_table(spark, delimited.resolve(spark, at, parser="rfc4180"))


@query("select cast(p_partkey as varchar) as column_0, p_name as column_1 from part")
def source_headerless_pipe_part(spark, sf_dir):
    at = scratch.path(spark, "part.dat")
    sinks.write_delimited(part(spark, sf_dir).select("p_partkey", "p_name"), at, "|", header=False)
    return delimited.read_table(spark, delimited.resolve(spark, at, delim="pipe", has_header=False))


@query("select cast(doc_id as varchar) as doc_id, text from documents")
def source_multiline_documents(spark, sf_dir):
    """Fields with line feeds, quotes and delimiters, through RFC 4180 text and back."""
    at = scratch.path(spark, "documents.csv")
    sinks.write_delimited(table(spark, sf_dir, "documents").select("doc_id", "text"), at, ",")
    return delimited.read_table(spark, delimited.resolve(spark, at))


@query("select p_partkey, p_name from part")
def source_byte_order_mark_part(spark, sf_dir):
    at = scratch.path(spark, "part.csv")
    p = part(spark, sf_dir)
    p.select(F.concat(F.lit("﻿"), "p_partkey", F.lit(","), "p_name")).coalesce(1).write.text(at)
    d = delimited.read_table(spark, delimited.resolve(spark, at, has_header=False))
    # the mark stands before each line here, and goes from each
    return d.select(F.regexp_replace("column_0", "^\\x{FEFF}", "").cast("long").alias("p_partkey"), F.col("column_1").alias("p_name"))


@query("select 'p_partkey,p_name' as \"left\", 'p_name,p_partkey' as \"right\", 'p_partkey' as \"key\", true as reordered, ',' as left_delimiter")
def inspect_headers_part(spark, sf_dir):
    a, b = scratch.path(spark, "left.csv"), scratch.path(spark, "right.csv")
    p = part(spark, sf_dir)
    sinks.write_delimited(p.select("p_partkey", "p_name"), a, ",")
    sinks.write_delimited(p.select("p_name", "p_partkey"), b, ",")
    found = delimited.inspect(spark, delimited.resolve(spark, a), delimited.resolve(spark, b), TableOptions(keys=["p_partkey"]))
    row = (*[",".join(found[k]) for k in ("left", "right", "key")], found["reordered"], found["left_delimiter"])
    return spark.createDataFrame([row], "left string, right string, key string, reordered boolean, left_delimiter string")


@query("select cast(count(*) as bigint) as n, cast(sum(length(line)) as bigint) as size from (select unnest(string_split(text, chr(10))) as line, ends_with(text, chr(10)) as e from documents)")
def source_line_scan_documents(spark, sf_dir):
    at = scratch.path(spark, "documents.txt")
    table(spark, sf_dir, "documents").select("text").write.text(at)
    return files.read_lines(spark, at).agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("size"))


# results as files


@query(multiset_sql(CUSTOMER_LEFT, CUSTOMER_RIGHT, CUSTOMER, ["id"]))
def sink_tsv_gzip_customer(spark, sf_dir):
    at = scratch.path(spark, "out.tsv.gz")
    sinks.write_tsv(customer_diff(spark, sf_dir, keys=["id"]), at)
    return delimited.read_table(spark, delimited.resolve(spark, at, parser="rfc4180"))


@query(ids_sql("select id, kind, key from d"))
def sink_jsonl_customer(spark, sf_dir):
    at = scratch.path(spark, "out.jsonl")
    sinks.write_jsonl(customer_diff(spark, sf_dir, keys=["id"], cell_diff=True), at)
    d = spark.read.schema("id string, kind string, old array<string>, new array<string>").json(at)
    return d.select("id", "kind", F.coalesce(F.col("old")[0], F.col("new")[0]).alias("key"))


PREVIEW = "select *, (select count(*) from d) > 50 as truncated from (select _diff, _side, id, name, segment from d order by all limit 50)"


@query(multiset_sql(CUSTOMER_LEFT, CUSTOMER_RIGHT, CUSTOMER, ["id"], PREVIEW))
def preview_customer(spark, sf_dir):
    return customer_diff(spark, sf_dir, keys=["id"]).preview(50)


@query(multiset_sql(CUSTOMER_LEFT, CUSTOMER_RIGHT, CUSTOMER, ["id"], "select _diff, _side, id, name, segment from d order by id, _side limit 20 offset 40"))
def page_customer(spark, sf_dir):
    return sinks.page(customer_diff(spark, sf_dir, keys=["id"]).rows(), 2, ["id", "_side"], 20)


@query(unique_sql(PART_LEFT, PART_RIGHT, ["p_partkey", "p_name", "p_brand", "p_size"], "p_partkey", any_differs(["p_name", "p_size"]), "select _diff, _side, p_partkey, p_name, p_size from d"))
def changed_columns_only_part(spark, sf_dir):
    d = compare_tables(derived(spark, sf_dir, PART_LEFT), derived(spark, sf_dir, PART_RIGHT), keys=["p_partkey"], cell_diff=True)
    return sinks.changed_columns_only(d).drop("_changed_cols")


@query("select count(*) as rows, sum(octet_length(encode(p_name))) as bytes from part")
def progress_part(spark, sf_dir):
    p = sinks.Progress("scan", "part")
    p.watch(part(spark, sf_dir), F.octet_length("p_name")).write.format("noop").mode("overwrite").save()
    r = p.report()
    return spark.createDataFrame([(r["rows"], r["bytes"])], "rows long, bytes long")


@query("select unnest(['p_name', 'p_size']) as name")
def find_columns_part(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    found = [n for t in ("NAM", "size") for n in sinks.find_columns(p.columns, t)]
    return spark.createDataFrame([(n,) for n in found], "name string")


# tolerance matching: in each class of rows equal but for the quantity, sorted rows of both sides pair up from the smallest
MATCHING = f"""
    with recursive l as ({LINEITEM_LEFT}), r as ({LINEITEM_RIGHT}),
    c as (select l_orderkey, l_linenumber, l_partkey, l_returnflag, list(q order by q) filter (s = 0) as a, list(q order by q) filter (s = 1) as b
          from (select l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity as q, 0 as s from l union all select l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity, 1 from r) group by all),
    w as (select *, 1 as i, 1 as j, 0 as met from c where a is not null and b is not null
          union all
          select l_orderkey, l_linenumber, l_partkey, l_returnflag, a, b, case when a[i] - b[j] > 1 then i else i + 1 end, case when b[j] - a[i] > 1 then j else j + 1 end,
                 met + case when abs(a[i] - b[j]) <= 1 then 1 else 0 end from w where i <= len(a) and j <= len(b)),
    m as (select l_orderkey, l_linenumber, max(met) as met from w group by l_orderkey, l_linenumber, l_partkey, l_returnflag),
    k as (select coalesce(x.l_orderkey, y.l_orderkey) as l_orderkey, coalesce(x.l_linenumber, y.l_linenumber) as l_linenumber, coalesce(x.n, 0) as nl, coalesce(y.n, 0) as nr
          from (select l_orderkey, l_linenumber, count(*) as n from l group by all) x full join (select l_orderkey, l_linenumber, count(*) as n from r group by all) y using (l_orderkey, l_linenumber)),
    e as (select k.*, coalesce((select sum(met) from m where m.l_orderkey = k.l_orderkey and m.l_linenumber = k.l_linenumber), 0) as eq from k)
    select sum(nl) as left_rows, sum(nr) as right_rows, sum(eq) as equal_rows, sum(case when nr = 0 then nl else 0 end) as left_only, sum(case when nl = 0 then nr else 0 end) as right_only,
           sum(case when nr > 0 then nl - eq else 0 end) as changed_left, sum(case when nl > 0 then nr - eq else 0 end) as changed_right, sum(nl + nr - 2 * eq) as diff_rows from e
"""


@query(MATCHING)
def tolerance_matching_lineitem(spark, sf_dir):
    return lineitem_diff(spark, sf_dir, tolerances={"l_quantity": 1.0}).summary()


# normalisation


@query(unique_sql(PART_LEFT, PART_RIGHT, ["p_partkey", "p_name", "p_brand", "p_size"], "p_partkey", "(regexp_replace(regexp_replace(l.p_name, '[A-Z]+', '', 'g'), '\\s', '', 'g') <> regexp_replace(regexp_replace(r.p_name, '[A-Z]+', '', 'g'), '\\s', '', 'g') or l.p_size <> r.p_size)"))
def filtered_diff_part(spark, sf_dir):
    rules = Rules(whitespace="all", filters=("[A-Z]+",))
    return compare_tables(derived(spark, sf_dir, PART_LEFT), derived(spark, sf_dir, PART_RIGHT), keys=["p_partkey"], rules=rules).rows()


@query("select p_partkey, p_name as name, p_brand as brand from part")
def decoded_rows_part(spark, sf_dir):
    row = encode.decode(encode.row([F.col("p_name"), F.col("p_brand")]), 2)
    return part(spark, sf_dir).select("p_partkey", row.alias("r")).select("p_partkey", F.col("r")[0].alias("name"), F.col("r")[1].alias("brand"))


# one line a document


def line_pairs(spark, sf_dir) -> DataFrame:
    """Each part's name against itself, in capitals but for every third."""
    return part(spark, sf_dir).select("p_partkey", F.col("p_name").alias("old"), F.expr("if(p_partkey % 3 = 0, p_name, concat(upper(p_name), '!'))").alias("new"))


PAIRS_SQL = "with p as (select p_partkey, p_name as o, case when p_partkey % 3 = 0 then p_name else upper(p_name) || '!' end as n from part), q as (select *, o <> n as d, chr(10) as nl, chr(92) || ' No newline at end of file' as nn from p)"


@query(PAIRS_SQL + " select p_partkey, 1 as old_lines, 1 as new_lines, cast(d as int) as hunk_count, 0 as omitted, 0 as added, 0 as deleted, cast(d as int) as modified, 0 as moved_blocks, 0 as moved_lines, false as moves_skipped from q")
def line_totals_part(spark, sf_dir):
    return lines.diff_documents(line_pairs(spark, sf_dir)).drop("hunks")


def rendered(name: str, sql: str):
    @query(PAIRS_SQL + f" select p_partkey, case when d then {sql} else '' end as text from q", name=f"render_{name}_part")
    def run(spark, sf_dir):
        return render.render_documents(line_pairs(spark, sf_dir), name)

    return run


for _name, _sql in {
    "unified": "'@@ -1,1 +1,1 Replace @@' || nl || '-' || o || nl || '+' || n || nl",
    "side": "'@@ -1,1 +1,1 Replace @@' || nl || '- ' || rpad(o, 56, ' ') || ' | + ' || n || nl",
    "normal": "'1c1' || nl || '< ' || o || nl || nn || nl || '---' || nl || '> ' || n || nl || nn || nl",
    "patch": "'--- old' || nl || '+++ new' || nl || '@@ -1 +1 @@' || nl || '-' || o || nl || nn || nl || '+' || n || nl || nn || nl",
    "context": "'*** old' || nl || '--- new' || nl || '***************' || nl || '*** 1 ****' || nl || '! ' || o || nl || nn || nl || '--- 1 ----' || nl || '! ' || n || nl || nn || nl",
}.items():
    rendered(_name, _sql)


@query(PAIRS_SQL + " select p_partkey, case when d then '1 hunk(s), 0 added, 0 deleted, 1 modified' else '0 hunk(s), 0 added, 0 deleted, 0 modified' end || nl as text from q")
def render_summary_part(spark, sf_dir):
    return render.render_documents(line_pairs(spark, sf_dir), "summary")


@query(PAIRS_SQL + " select p_partkey, cast(d as int) as hunk_count, case when d then 'replace' end as kind, cast(d as int) as modified from q")
def render_json_part(spark, sf_dir):
    text = render.render_documents(line_pairs(spark, sf_dir), "json")
    r = text.select("p_partkey", F.from_json("text", "hunks array<struct<kind: string>>, hunk_count int, modified int").alias("r"))
    return r.select("p_partkey", "r.hunk_count", F.get("r.hunks", F.lit(0))["kind"].alias("kind"), "r.modified")


@query("select p_partkey, p_name as old_marked, '{+zz9 +}' || p_name || '{+ extra+}' as new_marked from part", raw=True)
def word_marks_part(spark, sf_dir):
    p = part(spark, sf_dir).select("p_partkey", F.col("p_name").alias("old"), F.concat(F.lit("zz9 "), "p_name", F.lit(" extra")).alias("new"))
    d = words.diff_words(p)
    return d.select("p_partkey", render.word_marks(F.col("old_segments"), "[-", "-]").alias("old_marked"), render.word_marks(F.col("new_segments"), "{+", "+}").alias("new_marked"))


@query("select p_partkey, array_to_string(regexp_extract_all(p_name, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]+|\\s+'), '|') as words from part")
def word_tokens_part(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", F.array_join(words.tokens(F.col("p_name")), "|").alias("words"))


def built(spark, sf_dir, old: str, new: str) -> DataFrame:
    """(p_partkey, old, new): documents whose lines are given by commas; NAME stands for the part's name."""
    text = lambda s: F.concat(*[x for t in s.split(",") for x in (F.col("p_name") if t == "NAME" else F.lit(t), F.lit("\n"))])
    return part(spark, sf_dir).select("p_partkey", text(old).alias("old"), text(new).alias("new"))


@query("select p_partkey, rule, case when rule = 'exact' then 2 else 0 end as modified from part, (select unnest(['exact', 'any', 'case']) as rule)")
def terminator_rules_part(spark, sf_dir):
    d = built(spark, sf_dir, "NAME,x", "NAME,x")
    d = d.withColumn("new", F.replace("new", F.lit("\n"), F.lit("\r\n")))
    rules = {"exact": lines.LineOptions(), "any": lines.LineOptions(ignore_eol=True), "case": lines.LineOptions(ignore_eol=True, rules=Rules(ignore_case=True))}
    out = None
    for name, o in rules.items():
        side = d.withColumn("new", F.upper("new")) if name == "case" else d
        one = lines.diff_documents(side, o).select("p_partkey", F.lit(name).alias("rule"), "modified")
        out = one if out is None else out.unionByName(one)
    return out


@query("select p_partkey, 5 as added, 0 as modified, 0 as deleted from part")
def sync_points_part(spark, sf_dir):
    d = built(spark, sf_dir, "NAME,anchor,z", "NAME,1,2,3,4,5,anchor,z")
    return lines.diff_documents(d, lines.LineOptions(window=2, sync=((1, 6),))).select("p_partkey", "added", "modified", "deleted")


@query("select p_partkey, 1 as moved_blocks, 3 as moved_lines, 0 as added, 0 as deleted from part")
def moved_blocks_part(spark, sf_dir):
    d = built(spark, sf_dir, "NAME,k1,k2,a,b,c", "a,b,c,NAME,k1,k2")
    return lines.diff_documents(d, lines.LineOptions(moves=True)).select("p_partkey", "moved_blocks", "moved_lines", "added", "deleted")


@query("select p_partkey, 1 as modified, 1 as hunk_count from part")
def ignored_hunks_part(spark, sf_dir):
    r = lines.diff_documents(built(spark, sf_dir, "a,b,NAME,c", "A1,b,NAME,C1"))
    return lines.ignore_hunks(r, F.array(F.lit(0))).select("p_partkey", "modified", "hunk_count")


@query("select p_partkey, 2 as next_hunk from part")
def jump_to_kind_part(spark, sf_dir):
    r = lines.diff_documents(built(spark, sf_dir, "a,b,NAME,c,d", "A1,b,NAME,x,c,D1"))
    return lines.jump(r, "replace", 0).select("p_partkey", "next_hunk")


@query("select p_partkey, unnest([0, 1, 2, 3]) as pixel, unnest([0, 2, 2, 2]) as hunk from part")
def minimap_part(spark, sf_dir):
    # units: a replaced line 2, an inserted one 2, four inserted lines 5; of nine units each pixel shows the greater rank
    r = lines.diff_documents(built(spark, sf_dir, "a,NAME,b,c", "A1,NAME,x,b,c,1,2,3,4"))
    cells = lines.minimap(r, ["p_partkey"], 4, F.when(F.col("kind") == "replace", 2).otherwise(F.col("hunk")))
    return cells.select("p_partkey", "pixel", "hunk")


@query("select p_partkey, case when p_partkey % 2 = 0 then 'A1' else 'a' end || chr(10) || p_name || chr(10) || 'x' || chr(10) || 'b' || chr(10) as merged from part")
def merge_documents_part(spark, sf_dir):
    d = built(spark, sf_dir, "a,NAME,b", "A1,NAME,x,b").withColumn("choice", F.expr("map(0, if(p_partkey % 2 = 0, 'right', 'left'))"))
    return lines.merge_documents(d, "choice", default="right")


@query("select p_partkey, 0 as hunk_count from part")
def sorted_comparison_part(spark, sf_dir):
    return lines.diff_sorted(built(spark, sf_dir, "b,NAME,a", "NAME,a,b")).select("p_partkey", "hunk_count")


@query("select doc_id, array_to_string(list_sort(case when ends_with(text, chr(10)) then string_split(text, chr(10))[:-2] else string_split(text, chr(10)) end), chr(10)) as text from documents")
def sorted_lines_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", lines.sorted_text(F.col("text")).alias("text"))


@query("select p_partkey, 0 as conflicts, 1 as left_only, 1 as right_only, 0 as same, 'L' || chr(10) || p_name || chr(10) || 'R' as merged from part")
def three_way_merge_lines_part(spark, sf_dir):
    d = built(spark, sf_dir, "l,NAME,r", "L,NAME,r").select("p_partkey", F.col("old").alias("base"), F.col("new").alias("left"), F.concat(F.lit("l\n"), F.split("old", "\n")[1], F.lit("\nR\n")).alias("right"))
    merged = threeway.merge_lines(d).select("p_partkey", F.array_join("merged", "\n").alias("merged"))
    return threeway.compare_lines(d).drop("events").join(merged, "p_partkey")


@query("select p_partkey, '@@ BASE 2,1 conflict #0 @@' || chr(10) || '<<<<<<< LEFT' || chr(10) || 'L' || chr(10) || '||||||| BASE' || chr(10) || p_name || chr(10) || '=======' || chr(10) || 'R' || chr(10) || '>>>>>>> RIGHT' || chr(10) as text from part")
def three_way_text_part(spark, sf_dir):
    d = built(spark, sf_dir, "a,NAME,b", "a,L,b").select("p_partkey", F.col("old").alias("base"), F.col("new").alias("left"), F.lit("a\nR\nb\n").alias("right"))
    return render.render_three_way(threeway.compare_lines(d)).select("p_partkey", "text")


# bytes


BYTES_SQL = TREE_SQL + ", b as (select * from s where status <> 'added') select path, status = 'same' as equal, case status when 'same' then 0 when 'removed' then old_size else 8 end as diff_bytes, old_size, greatest(new_size, 0) as new_size, status = 'removed' and old_size > 256 * 32 as truncated from b"


@query(BYTES_SQL)
def byte_diff_pages(spark, sf_dir):
    old, new = page_trees(spark, sf_dir)
    return binary.diff_binary(trees.entry_pairs(old.select("path"), old, new)).drop("regions")


@query("select p_partkey, '@ 0x00000000' || chr(10) || '  - ' || lower(hex(p_name[1:1])) || chr(10) || '  + 21 3f' || chr(10) || 'files differ: 1 region(s), 2 byte(s); sizes 1 / 2' || chr(10) as text from part")
def hex_dump_part(spark, sf_dir):
    return render.render_bytes(part(spark, sf_dir).select("p_partkey", F.encode(F.substring("p_name", 1, 1), "UTF-8").alias("old"), F.encode(F.lit("!?"), "UTF-8").alias("new")))


# encodings


def coded(spark, sf_dir) -> DataFrame:
    """Documents as bytes: plain UTF-8, with a byte order mark, or UTF-16 without one."""
    utf8 = F.encode("text", "UTF-8")
    data = F.when(F.col("doc_id") % 3 == 0, utf8).when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).otherwise(F.encode("text", "UTF-16LE"))
    return table(spark, sf_dir, "documents").select("doc_id", data.alias("content"))


@query("select doc_id, case when doc_id % 3 = 2 then 'utf-16le' else 'utf-8' end as encoding, text from documents")
def decoded_documents(spark, sf_dir):
    return coded(spark, sf_dir).select("doc_id", encoding.detect_column(F.col("content")).alias("encoding"), encoding.decode_column(F.col("content")).alias("text"))


@query("select doc_id, case when doc_id % 5 <> 0 then text end as text from documents")
def binary_guard_documents(spark, sf_dir):
    data = F.when(F.col("doc_id") % 5 != 0, F.encode("text", "UTF-8")).otherwise(F.concat(F.unhex(F.lit("00")), F.encode("text", "UTF-8")))
    return table(spark, sf_dir, "documents").select("doc_id", encoding.decode_column(data).alias("text"))


# folders


@query("select 'f/' || (page_id % 5) || '/' || page_id || '.html' as path, octet_length(encode(html)) as size, sha256(html) as digest from pages")
def folder_walk_pages(spark, sf_dir):
    """Pages written as files, and read again as a tree."""
    at = scratch.path(spark, "tree")
    p = table(spark, sf_dir, "pages").select(F.expr("concat('f/', page_id % 5, '/', page_id, '.html')").alias("path"), F.encode("html", "UTF-8").alias("content"))
    files.write_tree(p, at)
    return files.read_tree(spark, at).select("path", "size", F.sha2("content", 256).alias("digest"))


@query(TREE_SQL + " select count(*) filter (status = 'added') as added, count(*) filter (status = 'removed') as removed, count(*) filter (status = 'changed') as changed, count(*) filter (status = 'same') as same from s")
def tree_counts_pages(spark, sf_dir):
    return trees.counts(trees.compare_trees(*page_trees(spark, sf_dir)))


METHOD_STATUS = "case when status in ('added', 'removed') then status when method = 'date' or old_size = new_size then 'same' else 'changed' end"


@query(TREE_SQL + f" select method, path, {METHOD_STATUS} as status from s, (select unnest(['size', 'date', 'quick']) as method)")
def tree_methods_pages(spark, sf_dir):
    out = None
    for m in ("size", "date", "quick"):
        one = trees.compare_trees(*page_trees(spark, sf_dir), method=m).select(F.lit(m).alias("method"), "path", "status")
        out = one if out is None else out.unionByName(one)
    return out


@query(TREE_SQL + " select path, case status when 'added' then '+' when 'removed' then '−' else '~' end || ' ' || path || ' ' || case when old_size < 0 then '—' else old_size || ' B' end || ' ' || case when new_size < 0 then '—' else new_size || ' B' end as line from s where status <> 'same'")
def folder_report_pages(spark, sf_dir):
    return render.folder_lines(trees.compare_trees(*page_trees(spark, sf_dir)))


@query(TREE_SQL + " select status, path, old_size, new_size, case when old_size < 0 then '' else '1970-01-01T00:00:00.000000Z' end as old_mtime, case when new_size < 0 then '' else '1970-01-01T00:00:00.000000Z' end as new_mtime from s")
def folder_table_pages(spark, sf_dir):
    return render.folder_table(trees.compare_trees(*page_trees(spark, sf_dir)), show_same=True)


@query(TREE_SQL + " select count(*) filter (status <> 'added') as n_old, count(*) filter (status <> 'removed') as n_new, count(*) as n_union, array_to_string((list(path order by path))[1:20], ',') as names from s")
def tree_preview_pages(spark, sf_dir):
    p = trees.preview(*page_trees(spark, sf_dir))
    return spark.createDataFrame([(p["old"], p["new"], p["union"], ",".join(p["names"]))], "n_old long, n_new long, n_union long, names string")


@query(TREE_SQL + " select path, old_size, greatest(new_size, 0) as new_size from s where status = 'changed'")
def opened_entries_pages(spark, sf_dir):
    old, new = page_trees(spark, sf_dir)
    changed = trees.select_entries(trees.compare_trees(old, new), "changed")
    size = lambda c: F.octet_length(c).cast("long").alias(f"{c}_size")
    return trees.entry_pairs(changed, old, new).select("path", size("old"), size("new"))


@query("select page_id from pages where page_id % 4 <> 0 and page_id % 7 <> 0")
def filter_sets_pages(spark, sf_dir):
    at = F.expr("concat(case when page_id % 4 = 0 then 'node_modules/' when page_id % 7 = 0 then 'target/x/' else 'src/' end, page_id, '.js')")
    p = table(spark, sf_dir, "pages").select("page_id", at.alias("path"))
    return p.filter(paths.PathFilter(sets=("node", "rust")).column()).select("page_id")


@query("select page_id, case when page_id % 2 = 0 then '.TXT' else '.txt' end as ext, 2 as depth, page_id || case when page_id % 2 = 0 then '.TXT' else '.txt' end as base from pages where page_id % 2 = 0 or page_id % 3 = 0")
def path_parts_pages(spark, sf_dir):
    at = F.expr("concat('a/b/', page_id, if(page_id % 2 = 0, '.TXT', '.txt'))")
    p = table(spark, sf_dir, "pages").select("page_id", at.alias("path"), F.lit(0).alias("size"), F.lit(0).cast("timestamp").alias("mtime"))
    p = p.filter(paths.expression("ext == '.TXT'") | (F.col("page_id") % 3 == 0))
    return p.select("page_id", paths.extension(F.col("path")).alias("ext"), paths.depth(F.col("path")).alias("depth"), paths.base(F.col("path")).alias("base"))


@query("select page_id from pages where url[1:1] not in ('!', 'x') and page_id % 2 = 0")
def glob_classes_pages(spark, sf_dir):
    at = F.expr("concat(if(page_id % 2 = 0, 'b', '!'), page_id)")
    return table(spark, sf_dir, "pages").select("page_id", at.alias("path")).filter(paths.matches_glob(F.col("path"), "[^!a]*") & ~paths.matches_glob(F.col("path"), "[!a]*")).select("page_id")


# display


@query("select p_partkey, length(p_name) as cells, case when length(p_name) <= 12 then p_name else p_name[1:9] || '...' end as short from part")
def display_width_parts(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", display.width_column(F.col("p_name")).alias("cells"), display.truncate_column(F.col("p_name"), 12).alias("short"))


@query("select doc_id, replace(replace(replace(text, chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') as line from documents")
def inline_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", display.inline_column(F.col("text")).alias("line"))


@query("select o_orderkey, trim(format('{:,}', o_orderkey * 7919)) as grouped, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as stamp from orders", raw=True)
def grouped_numbers_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", display.grouped(F.col("o_orderkey") * 7919).alias("grouped"), display.timestamp(F.col("o_orderdate")).alias("stamp"))


@query("select p_partkey, case when b < 1024 then b || ' B' when b < 1048576 then printf('%.1f KiB', b / 1024.0) when b < 1073741824 then printf('%.1f MiB', b / 1048576.0) else printf('%.1f GiB', b / 1073741824.0) end as size from (select p_partkey, (1::bigint << (p_partkey % 32)::int) + 0 as b from part)")
def human_sizes_part(spark, sf_dir):
    size = F.expr("shiftleft(cast(1 as bigint), cast(p_partkey % 32 as int))")
    return part(spark, sf_dir).select("p_partkey", display.human_bytes(size).alias("size"))


@query("select page_id from pages where page_id % 3 = 1")
def time_filter_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.lit("x").alias("path"), F.lit(0).alias("size"), F.expr("timestamp_seconds(1700000000 + page_id % 3 * 86400)").alias("mtime"))
    return p.filter(paths.expression("mtime >= '2023-11-15T00:00:00Z' and mtime < 2023-11-16")).select("page_id")


@query("select doc_id, 0 as hunk_count from documents")
def prepared_documents(spark, sf_dir):
    """A callable that prepares the rows of each input, as a plan."""
    pre = lambda d: d.withColumn("text", F.lower("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    old, new = d.transform(pre), d.withColumn("text", F.upper("text")).transform(pre)
    both = old.withColumnRenamed("text", "old").join(new.withColumnRenamed("text", "new"), "doc_id")
    return lines.diff_documents(both.withColumn("old", F.lower("old"))).select("doc_id", "hunk_count")


# limits, listings, archives, pages, streams


@query("select 3 as old_lines, 3 as new_lines, 1 as hunk_count, 1 as modified")
def inline_texts(spark, sf_dir):
    d = files.inline(spark, "a\nb\nc\n", "A\nB\nC\n", lambda t: t.replace("A", "a").replace("C", "c"))
    return lines.diff_documents(d).select("old_lines", "new_lines", "hunk_count", "modified")


@query("select p_partkey, 3 as hunk_count, 2 as omitted, 3 as modified, 1 as stored from part")
def hunk_limit_part(spark, sf_dir):
    r = lines.diff_documents(built(spark, sf_dir, "a,NAME,b,x,c", "A1,NAME,B1,x,C1"), lines.LineOptions(max_hunks=1))
    return r.select("p_partkey", "hunk_count", "omitted", "modified", F.size("hunks").alias("stored"))


@query("select p_partkey, 'far' as gap, 2 as groups from part union all select p_partkey, 'near', 1 from part")
def patch_groups_part(spark, sf_dir):
    out = None
    for name, n in (("far", 7), ("near", 6)):
        between = ",".join(f"l{i}" for i in range(n))
        text = render.render_documents(built(spark, sf_dir, f"a,{between},b", f"NAME,{between},B1"), "patch")
        one = text.select("p_partkey", F.lit(name).alias("gap"), F.regexp_count("text", F.lit("(?m)^@@ -")).alias("groups"))
        out = one if out is None else out.unionByName(one)
    return out


def flat(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.expr("concat('p', page_id, '.html')").alias("path"), F.encode("html", "UTF-8").alias("content"))


@query("select 'p' || page_id || '.html' as name, false as directory, octet_length(encode(html)) as size from pages order by name limit 20")
def folder_listing_pages(spark, sf_dir):
    at = scratch.path(spark, "tree")
    files.write_tree(flat(spark, sf_dir), at)
    return files.list_folder(spark, at, 20).select("name", "directory", "size")


@query("select 'p' || page_id || '.html' as path, octet_length(encode(html)) as size, sha256(html) as digest from pages")
def archive_walk_pages(spark, sf_dir):
    at = scratch.path(spark, "pages.zip")
    files.write_archive(flat(spark, sf_dir), at)
    return files.read_tree(spark, at, archive_bytes=1 << 50).select("path", "size", F.sha2("content", 256).alias("digest"))


@query("select true as refused, (select count(*) from pages) as entries")
def entry_budget_pages(spark, sf_dir):
    d = flat(spark, sf_dir).withColumns({"size": F.lit(0).cast("long"), "mtime": F.lit(0).cast("timestamp")})
    n = d.count()
    whole = trees.compare_trees(d, d, method="size", max_entries=n).count()
    try:
        trees.compare_trees(d, d, method="size", max_entries=n - 1)
        refused = False
    except CompareError:
        refused = True
    return spark.createDataFrame([(refused, whole)], "refused boolean, entries long")


@query("select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;') as text from pages")
def html_escape_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", display.html_escape(F.col("html")).alias("text"))


@query(PAIRS_SQL + " select p_partkey, d as has_hunk, case when d then o end as removed, case when d then n end as added from q")
def html_report_part(spark, sf_dir):
    r = render.render_documents(line_pairs(spark, sf_dir), "html")
    plain = lambda tag: F.regexp_replace(F.regexp_extract("text", f'<span class="{tag}">.(.*)</span>', 1), "</?(?:del|ins)>", "")
    text = lambda tag: F.when(F.col("has_hunk"), plain(tag))
    return r.withColumn("has_hunk", F.col("text").contains("<h2>@@")).select("p_partkey", "has_hunk", text("del").alias("removed"), text("ins").alias("added"))


@query("select count(*) as rows from orders")
def recompared_stream_orders(spark, sf_dir):
    """Every batch of files that appears is compared; here each batch's rows are counted."""
    at, out = scratch.path(spark, "orders"), scratch.path(spark, "batches")
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    rows.write.parquet(at)
    count = lambda batch, n: batch.agg(F.count("*").alias("n")).write.mode("append").parquet(out)
    watch.recompare(spark, at, rows.schema, count, scratch.path(spark, "offsets"), available_now=True).awaitTermination()
    return spark.read.parquet(out).agg(F.sum("n").alias("rows"))
