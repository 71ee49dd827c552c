"""One query for each operator over the workbook view of the tables, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.formula import REFERENCE, clean_sheet
from gridspark.functions.text import HINT_TOKENS, hints, location
from gridspark.operators import classify, confirm, coverage, graph, package
from gridspark.operators.inventory import destinations
from gridspark.operators.levels import node_levels
from gridspark.plans import tableview as view
from gridspark.sinks.store import checksums, merge_index
from gridspark.sources.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------------------------------------ SQL of the view


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _formula_sql(key: str, row: str) -> str:
    cases = " ".join(f"when {k} then {' || '.join(_quoted(p) if i % 2 == 0 else row for i, p in enumerate(_split(f)))}" for k, f in enumerate(view.FORMULAS))
    return f"case {key} % 8 {cases} end"


def _split(pattern: str) -> list[str]:
    pieces = pattern.split("{r}")
    return [x for p in pieces for x in (p, "{r}")][:-1]


def _sheet_sql(index: int) -> str:
    name, key, columns = view.SHEETS[index]
    row, book = f"({key} % {view.BOOK_ROWS} + 2)::bigint", f"'view-' || ({key} // {view.BOOK_ROWS})::bigint"
    out = []
    for i, c in enumerate(columns, 1):
        text = c in view.TEXT_COLUMNS
        dated, real = c.endswith("date"), c in ("o_totalprice", "c_acctbal", "p_retailprice", "s_acctbal")
        kind = "string" if text or dated else "double" if real else "long"
        value = c if text else f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if dated else f"{c}::decimal(18, 2)::varchar" if real else f"{c}::varchar"
        out.append(f"select {book} as book, '{name}' as sheet, {index}::bigint as idx, {row} as r, {i}::bigint as c, {value} as value, '{kind}' as value_type, '{view.FORMATTED.get(c, 'General')}' as fmt, null::varchar as formula from {name} where {c} is not null")
    out.append(f"select {book}, '{name}', {index}::bigint, {row}, {len(columns) + 1}::bigint, null, null, 'General', {_formula_sql(key, f'{row}::varchar')} from {name} where {key} is not null")
    for i, c in enumerate((*columns, "calc"), 1):
        out.append(f"select '{view.VIEW}', '{name}', {index}::bigint, 1::bigint, {i}::bigint, '{c}', 'string', 'General', null")
    return " union all ".join(out)


CELLS = f"""cells as (
  select *, chr((64 + c)::int) || r as address, case when formula is null then 'value' else 'formula' end as kind from ({' union all '.join(_sheet_sql(i) for i in range(len(view.SHEETS)))})
)"""
GRAPH = rf"""{CELLS}, f as (
  select book, sheet, idx, r, c, formula, sheet || '!' || address as own, 'cell:' || sheet || '!' || address as source,
         regexp_extract_all(formula, {_quoted(REFERENCE)}, 1) as pre, regexp_extract_all(formula, {_quoted(REFERENCE)}, 2) as ref
  from cells where formula <> ''
), m as (
  select *, unnest(range(1, len(ref) + 1)) as k from f
), t as (
  select book, source, formula, idx, r, c, k + 2 as step, replace(ref[k], '$', '') as ref,
         case when coalesce(pre[k], '') = '' then sheet else trim(left(pre[k], length(pre[k]) - 1), '''') end as target_sheet from m
), e as (
  select book, source, idx, r, c, 1 as step, 'external' as kind, formula as id_label, formula as label from f where regexp_matches(formula, '\[[^\]]+\]')
  union all select book, source, idx, r, c, 2, 'unsupported', own, formula from f where len(ref) = 0 and regexp_matches(formula, '\pL')
  union all select book, source, idx, r, c, step, case when contains(ref, ':') then 'range' else 'cell' end, case when target_sheet = '' then ref else target_sheet || '!' || ref end,
         case when target_sheet = '' then ref else target_sheet || '!' || ref end from t
), emitted as (
  select book, source, idx, r, c, 0 as step, 'cell' as kind, own as id_label, own as label from f union all select * from e
)"""
_LOOKUP = "regexp_matches(upper(formula), 'VLOOKUP|XLOOKUP|HLOOKUP|INDEX|MATCH')"
ITEMS = f"""{GRAPH}, rng as ({{ranges}}), cls as (
  select book, 'cell:' || sheet || '!' || address as id,
         case when formula <> '' and {_LOOKUP} then 'lookup_block' when formula <> '' then 'formula_block' when fmt <> 'General' then 'input' when value_type = 'string' then 'presentation' else 'input' end as category,
         case when formula <> '' and {_LOOKUP} then 0.8 when formula <> '' then 0.75 when fmt <> 'General' then 0.55 when value_type = 'string' then 0.6 else 0.5 end::double as confidence,
         case when formula <> '' and {_LOOKUP} then 'formula uses lookup function' when formula <> '' then 'cell contains formula; dependencies parsed separately'
              when fmt <> 'General' then 'literal cell with explicit number format' when value_type = 'string' then 'text label or presentation content' else 'literal value cell' end as reason
  from cells
)"""
_KINDS = ("merged_range", "table", "row_layout", "column_layout", "freeze_panes", "data_validation", "conditional_formatting", "comment", "hyperlink", "sheet_protection", "merged_range")
RANGES = f"""
  select 'view-0' as book, kind, case when kind = 'defined_name' then kind || ':' || case when name <> '' then name else address end else kind || ':orders!' || address end as id,
         case when kind = 'table' then 'data_table' when kind in ('merged_range', 'row_layout', 'column_layout', 'freeze_panes', 'conditional_formatting') then 'presentation' when kind = 'data_validation' then 'input' else 'other' end as category,
         case when kind = 'table' then 0.85 when kind in ('merged_range', 'row_layout', 'column_layout', 'freeze_panes', 'conditional_formatting') then 0.6 when kind = 'data_validation' then 0.65 else 0.4 end::double as confidence
  from (select ([{', '.join(map(_quoted, _KINDS))}])[(n_nationkey % 11 + 1)::int] as kind, n_name as name, 'A' || (n_nationkey + 1) as address from nation
        union all select 'defined_name', case when r_regionkey % 2 = 0 then r_name else '' end, '$B$' || (r_regionkey + 2) from region)"""
ITEMS = ITEMS.replace("{ranges}", RANGES)
_NAMES = " ".join(f"when {k} then {' || '.join(_quoted(x) if i % 2 == 0 else 'p_partkey::varchar' for i, x in enumerate(_split(p.replace('{k}', '{r}'))))}" for k, p in enumerate(view.PART_NAMES))
_MARKERS = " ".join(f"when contains(name, {_quoted(t)}) then {_quoted(d)}" for t, d in package.OPAQUE)
PARTS = f"parts as (select *, case {_MARKERS} end as marker from (select p_partkey, case p_partkey % 11 {_NAMES} end as name from part))"
UNSUPPORTED = f"""{ITEMS}, {PARTS}, u as (
  select 'view-' || (p_partkey // {view.BOOK_ROWS})::bigint as book, 0 as origin, p_partkey::bigint as s1, 0::bigint as s2, 0::bigint as s3, marker as feature_type, 'Opaque OOXML part recorded: ' || name as description from parts where marker is not null
  union all select book, 1, idx, r, c, 'formula_reference_parse', 'No references parsed from formula ''' || label || '''' from e where kind = 'unsupported'
), ui as (
  select book, 'unsupported:' || (row_number() over (partition by book order by origin, s1, s2, s3) - 1) || ':' || feature_type as id, description from u
)"""


# ------------------------------------------------------------------------------------------------ queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _book() -> Column:
    return F.col("sha256").alias("book")


@query(f"with {CELLS} select book, sheet as name, idx, max(r) as max_row, max(c) as max_column from cells group by all")
def sheet_manifest(spark, sf_dir):
    cells = view.view_cells(spark, sf_dir)
    return cells.groupBy(_book(), F.col("sheet_name").alias("name"), F.col("sheet_index").alias("idx")).agg(F.max("row").alias("max_row"), F.max("column").alias("max_column"))


@query(f"with {CELLS} select book, sheet, r as row_no, c as col_no, address, kind, value, value_type from cells")
def nonblank_cells(spark, sf_dir):
    return view.view_cells(spark, sf_dir).select(_book(), F.col("sheet_name").alias("sheet"), F.col("row").alias("row_no"), F.col("column").alias("col_no"), "address", "kind", "value", "value_type")


@query(f"with {CELLS} select book, sheet, kind, count(*)::bigint as n from cells group by all")
def cell_kind_counts(spark, sf_dir):
    return coverage.sheet_counts(view.view_cells(spark, sf_dir)).select(_book(), F.col("sheet_name").alias("sheet"), "kind", "n")


@query(f"with {GRAPH} select book, source, (step - 3)::int as step, kind || ':' || id_label as target, kind from e where step >= 3")
def formula_refs(spark, sf_dir):
    rows = graph.emissions(view.view_cells(spark, sf_dir)).where("step >= 3")
    return rows.select(_book(), "source", (F.col("step") - 3).cast("int").alias("step"), F.col("id").alias("target"), "kind")


@query(f"with {GRAPH} select book, source, kind || ':' || id_label as target, 'references' as relationship from e")
def graph_edges(spark, sf_dir):
    return graph.formula_graph(view.view_cells(spark, sf_dir)).edges.select(_book(), "source", "target", "relationship")


@query(f"with {GRAPH} select book, kind || ':' || id_label as id, any_value(kind) as kind, arg_min(label, (idx, r, c, step)) as label, min((idx, r, c, step))[2]::bigint as first_row from emitted group by book, kind || ':' || id_label")
def graph_nodes(spark, sf_dir):
    return graph.formula_graph(view.view_cells(spark, sf_dir)).nodes.select(_book(), "id", "kind", "label", F.col("first_seq")[1].alias("first_row"))


@query(f"with {GRAPH} select book, source, 'external:' || id_label as target from e where kind = 'external'")
def external_refs(spark, sf_dir):
    return graph.formula_graph(view.view_cells(spark, sf_dir)).edges.where(F.col("target").startswith("external:")).select(_book(), "source", "target")


@query(f"with {GRAPH} select book, source, 'formula_reference_parse' as feature_type, 'No references parsed from formula ''' || label || '''' as description from e where kind = 'unsupported'")
def unparsed_formulas(spark, sf_dir):
    found = graph.formula_graph(view.view_cells(spark, sf_dir)).unsupported
    return found.select(_book(), F.concat(F.lit("cell:"), F.col("loc.object_id")).alias("source"), "feature_type", "description")


@query(f"with {GRAPH}, p as (select distinct pre[k] as raw from m) select coalesce(raw, '') as raw, case when coalesce(raw, '') = '' then 'default' else trim(left(raw, length(raw) - 1), '''') end as sheet from p")
def sheet_clean(spark, sf_dir):
    raw = graph.formula_cells(view.view_cells(spark, sf_dir)).select(F.explode(F.regexp_extract_all("formula", F.lit(REFERENCE), F.lit(1))).alias("raw")).distinct()
    return raw.select("raw", clean_sheet(F.col("raw"), F.lit("default")).alias("sheet"))


@query(f"with {ITEMS} select * from cls")
def cell_classes(spark, sf_dir):
    return classify.cell_items(view.view_cells(spark, sf_dir)).select(_book(), "id", "category", "confidence", F.col("reasons")[0].alias("reason"))


@query(f"with rng as ({RANGES}) select id, category, confidence from rng")
def range_classes(spark, sf_dir):
    return classify.range_items(view.view_ranges(spark, sf_dir)).select("id", "category", "confidence")


_HINTS = ", ".join(f"case when regexp_matches(lower(text), '{'|'.join(tokens)}') then '{hint}' end" for hint, tokens in HINT_TOKENS)


@query(f"select doc_id, concat_ws(',', {_HINTS}) as hints from documents")
def text_hints(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.array_join(hints(F.col("text")), ",").alias("hints"))


@query(f"with {UNSUPPORTED} select category, count(*)::bigint as n, round(avg(confidence), 6) as avg_conf from (select category, confidence from cls union all select category, confidence from rng union all select 'unsupported_opaque', 1.0 from ui) group by category")
def class_summary(spark, sf_dir):
    return _items(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("avg_conf"))


def _unsupported(spark, sf_dir):
    return package.opaque_problems(view.view_parts(spark, sf_dir)).unionByName(graph.formula_graph(view.view_cells(spark, sf_dir)).unsupported)


def _items(spark, sf_dir):
    return classify.classify(view.view_books(spark), view.view_cells(spark, sf_dir), view.view_ranges(spark, sf_dir), _unsupported(spark, sf_dir), view.filled_books(spark, sf_dir))


@query(f"with {UNSUPPORTED} select book, id, 'unsupported_opaque' as category from ui")
def unsupported_items(spark, sf_dir):
    return classify.unsupported_items(_unsupported(spark, sf_dir)).select(_book(), "id", "category")


@query("select 'nation-' || n_nationkey as book, 'workbook:empty' as id, 'other' as category, 0.1::double as confidence from nation where n_nationkey not in (select c_nationkey from customer where c_acctbal > 9900 and c_nationkey is not null)")
def empty_workbook_default(spark, sf_dir):
    books = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("sha256"))
    seen = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("sha256"))
    return classify.empty_items(books, seen).select(_book(), "id", "category", "confidence")


@query(f"with {ITEMS} select book, 'confirm:' || id as id, 'category_override' as question_type, category as default_value from (select book, id, category, confidence from cls union all select book, id, category, confidence from rng) where confidence < 0.7")
def confirm_questions(spark, sf_dir):
    asked = confirm.questions(_items(spark, sf_dir).where(F.col("confidence") < confirm.SURE))
    return asked.select(_book(), "id", "question_type", F.col("default").alias("default_value"))


@query(f"with {UNSUPPORTED} select book, 'risk:' || id as id, 'Review unsupported or opaque workbook feature: ' || description as prompt from ui")
def risk_questions(spark, sf_dir):
    return confirm.questions(_items(spark, sf_dir).where("category = 'unsupported_opaque'")).select(_book(), "id", "prompt")


@query(f"with {CELLS}, {PARTS}, n as (select book, count(*) as recognized, 0 as opaque from cells group by book union all select 'view-0', (select count(*) from nation) + (select count(*) from region), 0 union all select 'view-' || (p_partkey // {view.BOOK_ROWS})::bigint, 0, 1 from parts where marker is not null) select book, sum(recognized)::bigint as recognized, sum(opaque)::bigint as opaque, sum(recognized + opaque)::bigint as discovered from n group by book")
def coverage_equation(spark, sf_dir):
    counted = coverage.coverage(view.view_books(spark), view.view_cells(spark, sf_dir), view.view_ranges(spark, sf_dir), package.opaque_problems(view.view_parts(spark, sf_dir)))
    return coverage.holds(counted).select(_book(), "recognized", "opaque", "discovered")


@query(f"with {PARTS} select name, marker from parts where marker is not null")
def opaque_parts(spark, sf_dir):
    return package.opaque_problems(view.view_parts(spark, sf_dir)).select(F.col("loc.ooxml_part").alias("name"), F.col("feature_type").alias("marker"))


_TYPES = (("xml", "application/xml"), ("png", "image/png"))


@query(f"with {PARTS} select name, case when p_partkey % 5 = 0 and not contains(name, 'connections') and name not in ('xl/vbaProject.bin', 'docProps/app') then 'override/' || p_partkey when name like '%.xml' then 'application/xml' when name like '%.png' then 'image/png' else '' end as content_type from parts")
def content_types(spark, sf_dir):
    parts = view.view_parts(spark, sf_dir)
    unique = (F.col("part_seq") % 5 == 0) & ~F.col("name").contains("connections") & ~F.col("name").isin("xl/vbaProject.bin", "docProps/app")
    overrides = parts.where(unique).select("sha256", F.concat(F.lit("/"), F.col("name")).alias("name"), F.concat(F.lit("override/"), F.col("part_seq").cast("string")).alias("content_type"))
    types = spark.createDataFrame(_TYPES, "extension string, content_type string")
    defaults = parts.select("sha256").distinct().crossJoin(F.broadcast(types))  # each workbook has its own
    return package.with_content_types(parts, overrides, defaults).select("name", "content_type")


@query(
    "with d as (select n_name as name, unnest(case n_nationkey % 4 when 0 then [('orders', '$A$1'), ('customer', '$B$' || (n_nationkey + 2))] when 1 then [('My Sheet', '$C$3:$D$' || (n_nationkey + 3))] "
    "when 2 then [('part', 'F' || (n_nationkey + 1))] else [(null::varchar, n_nationkey::varchar)] end) as x from nation) "
    "select name, x[1] as sheet_name, case x[1] when 'orders' then 0 when 'customer' then 1 when 'part' then 2 when 'supplier' then 3 else -1 end::bigint as sheet_idx, x[2] as address from d"
)
def defined_name_dest(spark, sf_dir):
    k = F.col("n_nationkey")
    number = lambda plus: (k + plus).cast("string")
    says = (
        F.when(k % 4 == 0, F.concat(F.lit("orders!$A$1,customer!$B$"), number(2))).when(k % 4 == 1, F.concat(F.lit("'My Sheet'!$C$3:$D$"), number(3)))
        .when(k % 4 == 2, F.concat(F.lit("part!F"), number(1))).otherwise(number(0))
    )
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), says.alias("says")).select("*", F.explode_outer(destinations(F.col("says"))).alias("d"))
    sheets = spark.createDataFrame([(name, i) for i, (name, _, _) in enumerate(view.SHEETS)], "sheet_name string, sheet_idx long")
    return names.select("name", F.col("d.sheet").alias("sheet_name"), F.coalesce("d.address", "says").alias("address")).join(sheets, "sheet_name", "left").select("name", "sheet_name", F.coalesce("sheet_idx", F.lit(-1)).cast("long").alias("sheet_idx"), "address")


@query("select path, coalesce(regexp_matches(lower(path), '[^/]\\.xls[xm]$'), false) as ok from (select 'in/' || s_name || ([ '.xlsx', '.XLSM', '.xls', '', '.tar.xlsx' ])[(s_suppkey % 5 + 1)::int] as path from supplier)")
def file_type_gate(spark, sf_dir):
    ends = F.element_at(F.array(*map(F.lit, (".xlsx", ".XLSM", ".xls", "", ".tar.xlsx"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    paths = table(spark, sf_dir, "supplier").select(F.concat(F.lit("in/"), "s_name", ends).alias("path"))
    return paths.select("path", package.is_workbook(F.col("path")).alias("ok"))


@query("select doc_id, sha256(coalesce(text, '')) as sha256 from documents")
def doc_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


@query("select 'doc-' || doc_id as name, doc_id % 7 <> 0 as ok from documents where text is not null")
def verify_checksums(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    kept = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return checksums(docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.sha2("text", 256).alias("sha256"), F.sha2(kept, 256).alias("found")))


@query(
    "with r as (select o_custkey::varchar as book, 'run-' || (o_orderkey % 4) as run_id, o_orderkey as completed_at, o_orderkey % 8 >= 4 as new from orders), "
    "m as (select * from r where new union all select * from r a where not new and not exists (select 1 from r b where b.new and b.book = a.book and b.run_id = a.run_id)) "
    "select book, run_id, completed_at::bigint as completed_at, row_number() over (partition by book order by completed_at desc, run_id desc) = 1 as is_latest from m"
)
def run_index_merge(spark, sf_dir):
    key = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("sha256"), F.concat(F.lit("run-"), (key % 4).cast("string")).alias("run_id"), key.cast("long").alias("completed_at"), (key % 8 >= 4).alias("new"))
    return merge_index(runs.where("not new"), runs.where("new")).select(_book(), "run_id", "completed_at", "is_latest")


@query("select c_custkey as id, case c_custkey % 4 when 1 then 'no sheet, part or workbook' when 2 then 'address without sheet' else 'negative sheet index' end as problem from customer where c_custkey % 4 <> 0")
def invalid_locations(spark, sf_dir):
    k = F.col("c_custkey") % 4
    loc = location(
        path=F.when(k != 1, "b.xlsx"), object_type="cell", sheet=F.when(k.isin(0, 3), F.col("c_name")), index=F.when(k == 3, -1).otherwise(0), address=F.when(k != 1, "A1"), object_id=F.col("c_name"),
    )
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), coverage.location_problem(loc).alias("problem")).where("problem is not null")


@query(f"with {ITEMS} select book, id, case when confidence < 0.7 and (length(id) % 3) = 0 then 'other' else category end as category from cls")
def decision_override(spark, sf_dir):
    items = classify.cell_items(view.view_cells(spark, sf_dir))
    asked = confirm.questions(items).where((F.col("question_type") == "category_override") & ((F.length("id") - 8) % 3 == 0))
    decisions = asked.select("sha256", F.col("id").alias("question_id"), F.explode(F.array(F.struct(F.lit("input").alias("decision"), F.lit(1).alias("timestamp")), F.struct(F.lit("other").alias("decision"), F.lit(2).alias("timestamp")), F.struct(F.lit("nonsense").alias("decision"), F.lit(3).alias("timestamp")))).alias("d")).select("sha256", "question_id", "d.decision", "d.timestamp")
    return confirm.apply_decisions(items, decisions).select(_book(), "id", "category")


#: Each order is a running total of its customer: it refers to the customer's order before, and to one rate that all refer to. The first order of every fiftieth customer refers to the last: a circle.
_CHAIN = "select o_orderkey as k, o_custkey as c, row_number() over (partition by o_custkey order by o_orderkey) as i, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as before, max(o_orderkey) over (partition by o_custkey) as last from orders where o_custkey is not null and o_orderkey is not null"


@query(f"with o as ({_CHAIN}) select 'cell:orders!T' || k as id, case when c % 50 = 0 then null else i end::bigint as level, c % 50 = 0 as cyclic from o union all select 'cell:rates!A1', 0, false where exists (select 1 from o)")
def formula_levels(spark, sf_dir):
    chain = spark.sql(_CHAIN.replace("from orders", "from {orders}"), orders=table(spark, sf_dir, "orders"))
    refs = "array_compact(array(before, if(i = 1 and c % 50 = 0, last, null)))"
    edges = chain.selectExpr("'view-0' as sha256", "concat('cell:orders!T', k) as source", f"explode(concat(array('cell:rates!A1'), transform({refs}, x -> concat('cell:orders!T', x)))) as target")
    return node_levels(edges).select("id", "level", "cyclic")
