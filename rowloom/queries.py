"""The registered queries of the comparison engine, and DuckDB SQL that gives the same rows.

The right side of a comparison is the table itself, changed by arithmetic on its keys (SQL that both engines read).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import encode, paths
from rowloom.operators import lines, threeway, trees, words
from rowloom.operators.reconcile import reconcile
from rowloom.operators.tables import compare_tables
from rowloom.plans.options import Rules
from rowloom.sources import render, scratch, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, raw: bool = False, name: str = ""):
    """Register a query and its SQL, in which braces mark tables (unless ``raw``)."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql if raw else sql.replace("{", "").replace("}", "")
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over ``{table}`` names."""
    import re

    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", sql))})


ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORDERS_RIGHT = """
    select o_orderkey, o_custkey, o_orderstatus,
           case when o_orderkey % 13 = 0 then o_totalprice + 1 when o_orderkey % 19 = 0 then o_totalprice + 0.25 else o_totalprice end as o_totalprice,
           o_orderdate, case when o_orderkey % 17 = 0 then upper(o_orderstatus || '-' || o_orderpriority) else o_orderpriority end as o_orderpriority
    from {orders} where o_orderkey % 97 <> 0
    union all
    select o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from {orders} where o_orderkey % 101 = 0
"""
LINEITEM = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag"]
LINEITEM_LEFT = "select l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag from {lineitem}"
LINEITEM_RIGHT = """
    select l_orderkey, l_linenumber, l_partkey, case when l_partkey % 19 = 0 then l_quantity + 0.25 else l_quantity end as l_quantity,
           case when l_partkey % 13 = 0 then lower(l_returnflag) else l_returnflag end as l_returnflag
    from {lineitem} where l_orderkey % 97 <> 0
    union all select l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag from {lineitem} where l_partkey % 23 = 0 and l_orderkey % 97 <> 0
    union all select l_orderkey + 10000000, l_linenumber, l_partkey, l_quantity, l_returnflag from {lineitem} where l_orderkey % 101 = 0
"""
CUSTOMER = ["id", "name", "segment"]
CUSTOMER_LEFT = "select cast(c_custkey as varchar(20)) as id, c_name as name, c_mktsegment as segment from {customer}"
CUSTOMER_RIGHT = """
    select cast(c_custkey as varchar(20)) as id, case when c_custkey % 17 = 0 then upper(c_name) else c_name end as name,
           case when c_custkey % 13 = 0 then c_mktsegment || ' NEW' else c_mktsegment end as segment
    from {customer} where c_custkey % 97 <> 0
    union all select cast(c_custkey + 10000000 as varchar(20)), c_name, c_mktsegment from {customer} where c_custkey % 101 = 0
"""
CUSTOMER_OTHER = """
    select cast(c_custkey as varchar(20)) as id, case when c_custkey % 17 = 0 then upper(c_name) when c_custkey % 7 = 0 then lower(c_name) else c_name end as name,
           case when c_custkey % 29 = 0 then 'MOVED' else c_mktsegment end as segment
    from {customer} where c_custkey % 89 <> 0
"""
PART_RIGHT = """
    select p_partkey, case when p_partkey % 17 = 0 then upper(p_name) when p_partkey % 19 = 0 then replace(p_name, ' ', '  ') else p_name end as p_name, p_brand,
           case when p_partkey % 13 = 0 then p_size + 1 else p_size end as p_size
    from {part} where p_partkey % 97 <> 0
"""
PART_LEFT = "select p_partkey, p_name, p_brand, p_size from {part}"


def multiset_sql(left: str, right: str, cols: list[str], key: list[str], tail: str = "rows") -> str:
    c, k = ", ".join(cols), ", ".join(key)
    return f"""
    with u as (select {c}, 1 as l, 0 as r from ({left}) union all select {c}, 0, 1 from ({right})),
    g as (select {c}, sum(l) as l, sum(r) as r from u group by {c}),
    p as (select *, max(l) over (partition by {k}) > 0 as on_l, max(r) over (partition by {k}) > 0 as on_r from g),
    d as (select case when on_r then 'CHANGED' else 'LEFT_ONLY' end as _diff, 'left' as _side, {c}, unnest(range(cast(l - least(l, r) as bigint))) as n from p where l > r
          union all
          select case when on_l then 'CHANGED' else 'RIGHT_ONLY' end, 'right', {c}, unnest(range(cast(r - least(l, r) as bigint))) from p where r > l)
    """ + (f"select _diff, _side, {c} from d" if tail == "rows" else tail)


def unique_sql(left: str, right: str, cols: list[str], key: str, differs: str, tail: str = "") -> str:
    """By an outer join, for keys that are unique on both sides; ``differs`` compares aliases l and r."""
    row = lambda s: ", ".join(f"{s}.{c}" for c in cols)
    return f"""
    with l as ({left}), r as ({right}), j as (select l.{key} as lk, r.{key} as rk, {differs} as differs from l full join r on l.{key} = r.{key}),
    d as (select case when rk is null then 'LEFT_ONLY' else 'CHANGED' end as _diff, 'left' as _side, {row('l')} from j join l on l.{key} = j.lk where rk is null or differs
          union all select case when lk is null then 'RIGHT_ONLY' else 'CHANGED' end, 'right', {row('r')} from j join r on r.{key} = j.rk where lk is null or differs)
    """ + (tail or f"select _diff, _side, {', '.join(cols)} from d")


def any_differs(cols: list[str]) -> str:
    return "(" + " or ".join(f"l.{c} is distinct from r.{c}" for c in cols) + ")"


def orders_diff(spark: SparkSession, sf_dir: str, **options):
    return compare_tables(table(spark, sf_dir, "orders").select(*ORDERS), derived(spark, sf_dir, ORDERS_RIGHT).select(*reversed(ORDERS)), keys=["o_orderkey"], **options)


def lineitem_diff(spark: SparkSession, sf_dir: str, **options):
    return compare_tables(derived(spark, sf_dir, LINEITEM_LEFT), derived(spark, sf_dir, LINEITEM_RIGHT), keys=["l_orderkey", "l_linenumber"], **options)


def customer_diff(spark: SparkSession, sf_dir: str, **options):
    return compare_tables(derived(spark, sf_dir, CUSTOMER_LEFT), derived(spark, sf_dir, CUSTOMER_RIGHT), **options)


@query(unique_sql("select * from orders", ORDERS_RIGHT, ORDERS, "o_orderkey", any_differs(ORDERS)))
def keyed_diff_orders(spark, sf_dir):
    return orders_diff(spark, sf_dir).rows()


SUMMARY = """select (select sum(l) from u) as left_rows, (select sum(r) from u) as right_rows, (select sum(least(l, r)) from p) as equal_rows,
    count(*) filter (_diff = 'LEFT_ONLY') as left_only, count(*) filter (_diff = 'RIGHT_ONLY') as right_only,
    count(*) filter (_diff = 'CHANGED' and _side = 'left') as changed_left, count(*) filter (_diff = 'CHANGED' and _side = 'right') as changed_right, count(*) as diff_rows from d"""


@query(multiset_sql(LINEITEM_LEFT, LINEITEM_RIGHT, LINEITEM, LINEITEM[:2]))
def multiset_diff_lineitem(spark, sf_dir):
    return lineitem_diff(spark, sf_dir).rows()


@query(multiset_sql(LINEITEM_LEFT, LINEITEM_RIGHT, LINEITEM, LINEITEM[:2], SUMMARY))
def diff_summary_lineitem(spark, sf_dir):
    return lineitem_diff(spark, sf_dir).summary()


@query(multiset_sql(LINEITEM_LEFT, LINEITEM_RIGHT, LINEITEM, LINEITEM[:2]))
def multiset_diff_one_exchange(spark, sf_dir):
    return lineitem_diff(spark, sf_dir, skew_safe=False).rows()


@query(multiset_sql(LINEITEM_LEFT, LINEITEM_RIGHT, LINEITEM, LINEITEM[:2]))
def multiset_diff_skew_safe(spark, sf_dir):
    return lineitem_diff(spark, sf_dir, skew_safe=True).rows()


@query(multiset_sql(CUSTOMER_LEFT, CUSTOMER_RIGHT, CUSTOMER, CUSTOMER))
def all_column_diff_customer(spark, sf_dir):
    return customer_diff(spark, sf_dir).rows()


@query(multiset_sql(PART_LEFT, PART_RIGHT, ["p_partkey", "p_name", "p_brand", "p_size"], ["p_partkey", "p_name", "p_brand"]))
def exclude_key_diff_part(spark, sf_dir):
    return compare_tables(derived(spark, sf_dir, PART_LEFT), derived(spark, sf_dir, PART_RIGHT), exclude_keys=["p_size"]).rows()


@query(unique_sql(PART_LEFT, PART_RIGHT, ["p_partkey", "p_name", "p_brand", "p_size"], "p_partkey", any_differs(["p_name", "p_brand"])))
def ignore_column_diff_part(spark, sf_dir):
    return compare_tables(derived(spark, sf_dir, PART_LEFT), derived(spark, sf_dir, PART_RIGHT), keys=["p_partkey"], ignore=["p_size"]).rows()


@query(unique_sql(PART_LEFT, PART_RIGHT, ["p_partkey", "p_name", "p_brand", "p_size"], "p_partkey", "(lower(regexp_replace(l.p_name, '\\s+', ' ', 'g')) <> lower(regexp_replace(r.p_name, '\\s+', ' ', 'g')) or l.p_size <> r.p_size)"))
def normalized_diff_part(spark, sf_dir):
    rules = Rules(ignore_case=True, whitespace="change")
    return compare_tables(derived(spark, sf_dir, PART_LEFT), derived(spark, sf_dir, PART_RIGHT), keys=["p_partkey"], rules=rules).rows()


# rows cancel by signature: the smallest left against the largest right rows of a key and signature
@query(f"""
    with u as (select {', '.join(LINEITEM)}, 'left' as s from ({LINEITEM_LEFT}) union all select {', '.join(LINEITEM)}, 'right' from ({LINEITEM_RIGHT})),
    n as (select *, lower(l_returnflag) as f, row_number() over (partition by s, l_orderkey, l_linenumber, l_partkey, l_quantity, lower(l_returnflag)
          order by case when s = 'left' then l_returnflag end, case when s = 'right' then l_returnflag end desc) as n from u),
    m as (select *, count(*) over (partition by l_orderkey, l_linenumber, l_partkey, l_quantity, f, n) as met,
          count(*) filter (s = 'left') over (partition by l_orderkey, l_linenumber) as nl, count(*) filter (s = 'right') over (partition by l_orderkey, l_linenumber) as nr from n)
    select case when nl > 0 and nr > 0 then 'CHANGED' when s = 'left' then 'LEFT_ONLY' else 'RIGHT_ONLY' end as _diff, s as _side, {', '.join(LINEITEM)} from m where met = 1
""")
def signature_diff_lineitem(spark, sf_dir):
    return lineitem_diff(spark, sf_dir, rules=Rules(ignore_case=True)).rows()


@query(unique_sql("select * from orders", ORDERS_RIGHT, ORDERS, "o_orderkey", f"({any_differs([c for c in ORDERS if c != 'o_totalprice'])} or abs(l.o_totalprice - r.o_totalprice) > 0.5)"))
def tolerance_diff_orders(spark, sf_dir):
    return orders_diff(spark, sf_dir, tolerances={"o_totalprice": 0.5}).rows()


CELLS = [c for c in ORDERS if c != "o_orderkey"]
CHANGED = "concat_ws(',', " + ", ".join(f"case when l.{c} is distinct from r.{c} then '{c}' end" for c in CELLS) + ")"


@query(f"""
    with l as (select * from orders), r as ({ORDERS_RIGHT}), j as (select l.o_orderkey as lk, r.o_orderkey as rk, {CHANGED} as c from l full join r on l.o_orderkey = r.o_orderkey)
    select case when rk is null then 'LEFT_ONLY' else 'CHANGED' end as _diff, 'left' as _side, case when rk is null then '' else c end as _changed_cols, l.* from j join l on l.o_orderkey = lk where rk is null or c <> ''
    union all select case when lk is null then 'RIGHT_ONLY' else 'CHANGED' end, 'right', case when lk is null then '' else c end, r.* from j join r on r.o_orderkey = rk where lk is null or c <> ''
""")
def cell_diff_orders(spark, sf_dir):
    return orders_diff(spark, sf_dir, cell_diff=True).rows()


@query("with l as (select * from orders), r as (" + ORDERS_RIGHT + "), c as (" + " union all ".join(f"select {i + 1} as index, '{c}' as name from l join r using (o_orderkey) where l.{c} is distinct from r.{c}" for i, c in enumerate(CELLS)) + ") select index, name, count(*) as changes from c group by all")
def column_change_ranking_orders(spark, sf_dir):
    return orders_diff(spark, sf_dir, cell_diff=True).column_changes()


@query()
def similarity_pairing_lineitem(spark, sf_dir):
    return lineitem_diff(spark, sf_dir, cell_diff=True).column_changes()


def _enc(cols: list[str]) -> str:
    return " || ".join(f"unhex(printf('%08x', octet_length(encode({c})))) || encode({c})" for c in cols)


def ids_sql(tail: str) -> str:
    one = lambda s, mark: f"unhex('{mark}') || {_enc([f'{s}.id'])} || unhex('00') || {_enc([f'{s}.{c}' for c in CUSTOMER])}"
    return f"""
    with l as ({CUSTOMER_LEFT}), r as ({CUSTOMER_RIGHT}), d as (
    select substr(sha256(encode('CHANGED') || {one('l', '00')} || {one('r', '01')}), 1, 32) as id, 'CHANGED' as kind, l.id as key from l join r using (id) where {any_differs(CUSTOMER)}
    union all select substr(sha256(encode('LEFT_ONLY') || {one('l', '00')}), 1, 32), 'LEFT_ONLY', l.id from l where id not in (select id from r)
    union all select substr(sha256(encode('RIGHT_ONLY') || {one('r', '01')}), 1, 32), 'RIGHT_ONLY', r.id from r where id not in (select id from l))
    {tail}"""


@query(ids_sql("select id, kind, key from d"))
def difference_ids_customer(spark, sf_dir):
    d = customer_diff(spark, sf_dir, keys=["id"], cell_diff=True)
    return d.records().select("id", "kind", F.coalesce(F.col("old")[0], F.col("new")[0]).alias("key"))


@query(ids_sql("select count(distinct id) as differences from d"))
def distinct_differences_customer(spark, sf_dir):
    return customer_diff(spark, sf_dir, keys=["id"], cell_diff=True).distinct_differences()


@query(f"with l as ({CUSTOMER_LEFT}), r as ({CUSTOMER_RIGHT}) select * from l")
def reconcile_left_customer(spark, sf_dir):
    return reconcile(customer_diff(spark, sf_dir, keys=["id"], cell_diff=True), default="left")


@query(f"with l as ({CUSTOMER_LEFT}), r as ({CUSTOMER_RIGHT}) select * from r")
def reconcile_right_customer(spark, sf_dir):
    return reconcile(customer_diff(spark, sf_dir, keys=["id"], cell_diff=True), default="right")


@query(f"with l as ({CUSTOMER_LEFT}), r as ({CUSTOMER_RIGHT}) select case when l.id is null or (r.id is not null and cast(coalesce(l.id, r.id) as bigint) % 2 = 0) then r.id else l.id end as id, case when l.id is null or (r.id is not null and cast(l.id as bigint) % 2 = 0) then r.name else l.name end as name, case when l.id is null or (r.id is not null and cast(l.id as bigint) % 2 = 0) then r.segment else l.segment end as segment from l full join r on l.id = r.id where r.id is null or l.id is not null")
def reconcile_choices_customer(spark, sf_dir):
    d = customer_diff(spark, sf_dir, keys=["id"], cell_diff=True)
    key = F.coalesce(F.col("old")[0], F.col("new")[0]).cast("long")
    choices = d.records().filter("kind = 'CHANGED'").select("id", F.when(key % 2 == 0, "right").otherwise("left").alias("choice"))
    return reconcile(d, choices, allow_unresolved=True)


def three_way(spark, sf_dir):
    return threeway.compare_tables_three_way(derived(spark, sf_dir, CUSTOMER_LEFT), derived(spark, sf_dir, CUSTOMER_RIGHT), derived(spark, sf_dir, CUSTOMER_OTHER), keys=["id"])


def three_way_sql(tail: str) -> str:
    same = lambda a, b: f"({a}.id is not distinct from {b}.id and {a}.name is not distinct from {b}.name and {a}.segment is not distinct from {b}.segment)"
    return f"""
    with b as ({CUSTOMER_LEFT}), l as ({CUSTOMER_RIGHT}), r as ({CUSTOMER_OTHER}), k as (select id from b union select id from l union select id from r),
    e as (select k.id as key, b.id as bid, l.id as lid, r.id as rid, b.name as bn, b.segment as bs, l.name as ln, l.segment as ls, r.name as rn, r.segment as rs,
          case when {same('l', 'b')} and {same('r', 'b')} then 'none' when {same('r', 'b')} then 'left_only' when {same('l', 'b')} then 'right_only' when {same('l', 'r')} then 'same' else 'conflict' end as kind
          from k left join b on b.id = k.id left join l on l.id = k.id left join r on r.id = k.id)
    {tail}"""


@query(three_way_sql("""select substr(sha256('["' || key || '"]'), 1, 32) as id, kind, key from e where kind <> 'none'"""))
def three_way_events_customer(spark, sf_dir):
    return three_way(spark, sf_dir).events().select("id", "kind", F.col("key")[0].alias("key"))


@query(three_way_sql("select kind, count(*) as events from e where kind <> 'none' group by kind"))
def three_way_counts_customer(spark, sf_dir):
    return three_way(spark, sf_dir).counts()


@query(three_way_sql("""select * from (select case when kind = 'right_only' then rid when kind in ('left_only', 'same') then lid else bid end as id,
    case when kind = 'right_only' then rn when kind in ('left_only', 'same') then ln else bn end as name, case when kind = 'right_only' then rs when kind in ('left_only', 'same') then ls else bs end as segment from e) where id is not null"""))
def three_way_merge_customer(spark, sf_dir):
    return three_way(spark, sf_dir).merge(allow_unresolved=True)


def document_pairs(spark, sf_dir):
    """Each document against itself without every seventh line, every fifth in capitals, and a line more."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("old"))
    kept = F.expr("filter(transform(split(old, '\n'), (x, i) -> if(i % 5 = 0, upper(x), x)), (x, i) -> i % 7 <> 3)")
    return d.withColumn("new", F.concat(F.array_join(kept, "\n"), F.lit("\nthe end")))


@query()
def line_diff_documents(spark, sf_dir):
    return lines.hunk_rows(lines.diff_documents(document_pairs(spark, sf_dir), lines.LineOptions(max_hunks=1 << 40)), "doc_id")


@query()
def line_diff_ignore_case_documents(spark, sf_dir):
    o = lines.LineOptions(rules=Rules(ignore_case=True, whitespace="change"), moves=True, ignore_trailing_eol=True)
    return lines.diff_documents(document_pairs(spark, sf_dir), o).drop("hunks")


@query()
def unified_patch_documents(spark, sf_dir):
    return render.render_documents(document_pairs(spark, sf_dir), "patch", lines.LineOptions(max_hunks=1 << 40))


@query()
def word_diff_parts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("old"), F.regexp_replace("p_name", "e", "E").alias("new"))
    d = words.diff_words(p).filter("old_segments is not null")
    return d.select("p_partkey", render.word_marks(F.col("old_segments"), "[-", "-]").alias("old_marked"), render.word_marks(F.col("new_segments"), "{+", "+}").alias("new_marked"))


LINES_SQL = "select doc_id, unnest(range(cast(len(a) as bigint))) as line_no, unnest(a) as line from (select doc_id, case when ends_with(text, chr(10)) or text = '' then string_split(text, chr(10))[:-2] else string_split(text, chr(10)) end as a from documents)"


@query(f"select doc_id, cast(line_no as integer) as line_no, line from ({LINES_SQL})")
def document_lines(spark, sf_dir):
    return lines.explode_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("with o as (select unnest(string_split(text, chr(10))) as line from documents where doc_id % 2 = 0), n as (select unnest(string_split(text, chr(10))) as line from documents where doc_id % 3 = 0), g as (select line, sum(d) as d from (select line, 1 as d from o union all select line, -1 from n) group by line) select line, cast(greatest(d, 0) as bigint) as only_old, cast(greatest(-d, 0) as bigint) as only_new from g where d <> 0 and line <> ''")
def sorted_multiset_lines(spark, sf_dir):
    d = lines.explode_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lines.multiset_lines(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 3 = 0")).filter("line <> ''")


@query("select cast(o_orderkey as varchar) as line, row_number() over (order by o_orderkey) as place from orders")
def numeric_line_sort(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("line"))
    return scratch.numbered(rows, lines.sort_keys(F.col("line"), numeric=True), "place").select("line", (F.col("place") + 1).alias("place"))


PAGE_OLD = "select 'site/' || (page_id % 7) || '/' || (page_id % 3) || '/' || page_id || '.html' as path, html from pages where page_id % 97 <> 5"
PAGE_NEW = "select 'site/' || (page_id % 7) || '/' || (page_id % 3) || '/' || page_id || '.html' as path, case when page_id % 13 = 0 then html || '<!-- -->' else html end as html from pages where page_id % 89 <> 3"


def page_trees(spark, sf_dir):
    """Pages as two file trees."""
    out = []
    for sql in (PAGE_OLD, PAGE_NEW):
        d = derived(spark, sf_dir, sql.replace("from pages", "from {pages}"))
        out.append(d.select("path", F.octet_length("html").cast("long").alias("size"), F.lit(0).cast("timestamp").alias("mtime"), F.encode("html", "UTF-8").alias("content")))
    return out


TREE_SQL = f"with o as ({PAGE_OLD}), n as ({PAGE_NEW}), s as (select coalesce(o.path, n.path) as path, case when o.path is null then 'added' when n.path is null then 'removed' when o.html = n.html then 'same' else 'changed' end as status, coalesce(octet_length(encode(o.html)), -1) as old_size, coalesce(octet_length(encode(n.html)), -1) as new_size from o full join n on o.path = n.path)"


@query(TREE_SQL + " select * from s")
def tree_compare_pages(spark, sf_dir):
    return trees.compare_trees(*page_trees(spark, sf_dir)).drop("old_mtime", "new_mtime")


@query(TREE_SQL + ", f as (select unnest(['', 'site', 'site/' || split_part(path, '/', 2), 'site/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3)]) as folder, status from s) select folder, count(*) as total, count(*) filter (status = 'added') as added, count(*) filter (status = 'removed') as removed, count(*) filter (status = 'changed') as changed, count(*) filter (status = 'same') as same from f group by folder")
def tree_rollup_pages(spark, sf_dir):
    return trees.rollup(trees.compare_trees(*page_trees(spark, sf_dir), method="hash"))


@query(TREE_SQL + " select status, path from s where status <> 'same' and path like '%/1/%'")
def tree_select_pages(spark, sf_dir):
    return trees.select_entries(trees.compare_trees(*page_trees(spark, sf_dir)), "different", "/1/").select("status", "path")


@query("select page_id, url from pages where (octet_length(encode(html)) >= 2048 and regexp_matches(url, '/en/')) or (not starts_with(url, 'https') and octet_length(encode(html)) < 1500)")
def filter_expression_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumns({"size": F.octet_length("html"), "mtime": F.lit(0).cast("timestamp")})
    return p.filter(paths.expression("size >= 2KiB and path =~ '/en/' or not path =~ '^https' and size < 1500", path="url")).select("page_id", "url")


@query("select page_id from pages where not regexp_matches(url, '(^|/)[.]') and ends_with(url, '.html')")
def glob_filter_pages(spark, sf_dir):
    f = paths.PathFilter(include=("**/*.html",), hidden=False)
    return table(spark, sf_dir, "pages").filter(f.column("url")).select("page_id")


@query("select p_partkey, sha256(" + _enc(["p_name", "p_brand"]) + ") as digest from part")
def encoded_rows_part(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.sha2(encode.row([F.col("p_name"), F.col("p_brand")]), 256).alias("digest"))


@query("with l as (" + CUSTOMER_LEFT + "), r as (" + CUSTOMER_RIGHT + ") select 'CHANGED' as _diff, 'right' as _side, r.id, r.name, r.segment, len(regexp_extract_all(r.segment, ' NEW')) + len(regexp_extract_all(r.name, ' NEW')) as hits from l join r using (id) where " + any_differs(CUSTOMER) + " and (r.segment like '% NEW%' or r.name like '% NEW%')")
def search_customer(spark, sf_dir):
    d = customer_diff(spark, sf_dir, keys=["id"]).rows().filter("_diff = 'CHANGED'")
    return sinks.search(d, " NEW", case=True, columns=["name", "segment"], most=1_000_000_000)


@query()
def three_way_lines_documents(spark, sf_dir):
    d = document_pairs(spark, sf_dir).withColumn("right", F.expr("array_join(filter(split(old, '\n'), (x, i) -> i % 11 <> 2), '\n')"))
    return threeway.compare_lines(d.select("doc_id", F.col("old").alias("base"), F.col("new").alias("left"), "right")).drop("events")


@query()
def sorted_diff_documents(spark, sf_dir):
    return lines.diff_sorted(document_pairs(spark, sf_dir)).drop("hunks")
