"""Registered queries over printed manuals and workbooks made of parts, each with SQL that works out from the parts what the parsers must find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_queries as Q
from .operators import audit
from .plans import printed
from .sources import annexes, sheets
from .sources.baskets import FILE_COLUMNS

_query = Q._query


def _carried(value: str) -> str:
    return f"coalesce(last_value({value} ignore nulls) over (partition by documento order by k rows unbounded preceding), '')"


def _manual_sql(version: int) -> str:
    """Headings are carried down the parts of a document in order of their keys; a part's own headings stand above it."""
    columns = {c: "''" for c in FILE_COLUMNS}
    columns |= {"generico": "p_name || ' ' || k || ' pieza'", "ponderador": "w", "CCIF division": _carried("d"), "CCIF grupo": _carried("coalesce(g, case when d is not null then '' end)"), "CCIF clase": _carried("coalesce(c, case when coalesce(g, d) is not null then '' end)")}
    has_cog, has_scian = "k % 5 <> 0", "k % 5 <> 1"
    sector, branch = "", ""
    if version == 2010:
        columns["COG"] = f"case when {has_cog} then {_carried('cog')} else '' end"
    if version == 2013:
        columns["encadenamiento"] = "(k % 7) || '.5'"
        sector, branch = f"substr({_carried('r')}, 1, 2) || ' ' || {_carried('s')}", f"{_carried('r')} || ' ' || {_carried('b')}"
    if version in (2018, 2024):
        columns["durabilidad"] = "coalesce(['no duradero', 'duradero', 'semiduradero', 'servicio'][k % 5 + 1], '')"
        more = {2018: ("case when k % 2 = 0 then ' y sus servicios' else '' end", "case when k % 3 = 0 then ' y otras' else '' end"), 2024: ("' y otros comestibles'", "''")}[version]
        blank = lambda x: f"coalesce(nullif({x}, ''), ' ')"
        sector, branch = blank(_carried(f"d || {more[0]}")), blank(_carried(f"case when g is not null then r || ' ' || b || {more[1]} end"))
    if version == 2018:
        columns["COG"] = f"case when {has_cog} then {_carried('case when d is not null then t end')} else '' end"
    if sector:
        columns |= {"SCIAN sector": f"case when {has_scian} then {sector} else '' end", "SCIAN rama": f"case when {has_scian} then {branch} else '' end"}
    cog = ", ".join(f"'{x}'" for x in annexes.COG_2010)
    return f"""
with p as (
  select p_partkey as k, 'manual ' || (p_partkey % 4) as documento, p_name, lower(p_type) as t, printf('%.2f', p_retailprice) as w,
    case when p_partkey % 24 < 4 then (p_partkey % 90 + 10) || ' ' || lower(p_type) end as d, case when p_partkey % 12 < 4 then (p_partkey % 90 + 10) || '.' || (p_partkey % 9 + 1) || ' grupo ' || lower(p_type) end as g,
    case when p_partkey % 8 < 4 then (p_partkey % 90 + 10) || '.' || (p_partkey % 9 + 1) || '.' || (p_partkey % 7 + 1) || ' clase ' || lower(p_type) end as c,
    case when p_partkey % 24 < 4 then [{cog}][p_partkey % 8 + 1] end as cog, case when p_partkey % 24 < 4 then lower(p_type) end as s,
    case when p_partkey % 12 < 4 then (p_partkey % 9000 + 1000)::varchar end as r, case when p_partkey % 12 < 4 then 'rama ' || lower(p_type) end as b
  from part)
select documento, {', '.join(f'{x} as "{c}"' for c, x in columns.items())} from p"""


@_query(_manual_sql(2010))
def manual_2010(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two annexes, told apart by their pages."""
    return annexes.basket_of(annexes.by_page(printed.lines(spark, sf_dir, 2010).drop("anexo"), 2010), 2010)


@_query(_manual_sql(2013))
def manual_2013(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows split over two and three lines, and over pages."""
    return annexes.basket_of(annexes.by_page(printed.lines(spark, sf_dir, 2013).drop("anexo"), 2013), 2013)


@_query(_manual_sql(2018))
def manual_2018(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three annexes; headings that go on in the next line."""
    return annexes.basket_of(annexes.by_page(printed.lines(spark, sf_dir, 2018).drop("anexo"), 2018), 2018)


@_query(_manual_sql(2024))
def manual_2024(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of several lines before their number, words cut at the end of a line."""
    return annexes.basket_of(annexes.by_page(printed.lines(spark, sf_dir, 2024).drop("anexo"), 2024), 2024)


def _book_sql(version: int) -> str:
    layout = sheets.LAYOUTS[version]
    kinds = [f"[{', '.join(repr(m[i]) for m in layout.marcas.values())}][k % {len(layout.marcas)} + 1]" for i in range(3)]
    columns = {c: "''" for c in FILE_COLUMNS} | {
        "generico": "p_name || ' ' || k", "ponderador": "w", "encadenamiento": "(k % 7) || '.125'" if layout.encadenamiento else "''",
        "COG": _carried("case when k % 24 < 4 then t end"), "CCIF division": f"case when k % 5 <> 2 then {_carried('case when k % 12 < 4 then t end')} else '' end" if layout.hoja_ccif else "''",
        "inflacion componente": kinds[0], "inflacion subcomponente": kinds[1], "inflacion agrupacion": kinds[2], "canasta basica": "case when k % 2 = 0 then 'X' else '-' end", "canasta consumo minimo": "case when k % 3 = 0 then 'X' else '-' end" if layout.consumo_minimo else "''",
    }
    return f"""
with p as (select p_partkey as k, 'libro ' || (p_partkey % 4) as documento, p_name, lower(p_type) as t, printf('%.2f', p_retailprice) as w from part)
select * exclude (k) from (select k, documento, {', '.join(f'{x} as "{c}"' for c, x in columns.items())} from p) where k % 11 <> 0"""


@_query(_book_sql(2010))
def libro_2010(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in a column of their own, one sheet."""
    return sheets.basket_of(printed.cells(spark, sf_dir, 2010), 2010)


@_query(_book_sql(2013))
def libro_2013(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with chain factors and a second sheet."""
    return sheets.basket_of(printed.cells(spark, sf_dir, 2013), 2013)


@_query(_book_sql(2018))
def libro_2018(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in the items' column, told by the lack of marks."""
    return sheets.basket_of(printed.cells(spark, sf_dir, 2018), 2018)


@_query(_book_sql(2024))
def libro_2024(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with chain factors and the least basket."""
    return sheets.basket_of(printed.cells(spark, sf_dir, 2024), 2024)


_ITEMS = """
with i as (select p_name as generico, (ascii(p_name) * 3 + ascii(split_part(p_name, ' ', 2)) + length(p_name)) as a, lower(min(p_type)) as t, sum(p_retailprice) / 1000 as w from part group by 1),
e as (
  select generico, case a % 3 when 1 then w::decimal(18, 1)::varchar || '3' else printf('%.2f', w) end as xw, case a % 3 when 0 then printf('%.2f', w) when 1 then w::decimal(18, 1)::varchar else printf('%.2f', w + 1) end as pw,
    case when a % 7 = 0 then '' else t end as xcog, case when a % 4 = 0 then t || ' otra' else t end as pcog,
    case when a % 11 = 0 then '' else t end as xdiv, '0' || (a % 9 + 1) || ' ' || case when a % 5 = 0 then t || ' nueva' else t end as pdiv,
    case when a % 2 = 0 then '0' || (a % 9 + 1) || '.1 grupo ' || t else '' end as pgrp, case when a % 2 = 0 then 'subyacente' else 'no subyacente' end as xcomp, a
  from i)"""


def _item_extracts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One basket, an item a part name, as a workbook and as a manual have it."""
    a = F.ascii("p_name") * 3 + F.ascii(F.split_part("p_name", F.lit(" "), F.lit(2))) + F.length("p_name")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_name").alias("generico"), a.alias("a")).agg(F.lower(F.min("p_type")).alias("t"), (F.sum("p_retailprice") / 1000).alias("w"))
    a, t, w = F.col("a"), F.col("t"), F.col("w")
    two, one = lambda x: F.format_string("%.2f", x), w.cast("decimal(18,1)").cast("string")
    code = F.concat(F.lit("0"), (a % 9 + 1).cast("string"))
    xlsx = rows.select("generico", F.when(a % 3 == 1, F.concat(one, F.lit("3"))).otherwise(two(w)).alias("ponderador"), F.when(a % 7 == 0, "").otherwise(t).alias("COG"), F.when(a % 11 == 0, "").otherwise(t).alias("CCIF division"), F.when(a % 2 == 0, "subyacente").otherwise("no subyacente").alias("inflacion componente"))
    pdf = rows.select(
        "generico", F.when(a % 3 == 0, two(w)).when(a % 3 == 1, one).otherwise(two(w + 1)).alias("ponderador"),
        F.when(a % 4 == 0, F.concat(t, F.lit(" otra"))).otherwise(t).alias("COG"), F.concat(code, F.lit(" "), F.when(a % 5 == 0, F.concat(t, F.lit(" nueva"))).otherwise(t)).alias("CCIF division"),
        F.when(a % 2 == 0, F.concat(code, F.lit(".1 grupo "), t)).otherwise("").alias("CCIF grupo"),
    )
    return xlsx, pdf


#: Every decision of the cross with the workbook preferred.
_RESOLVED = _ITEMS + """,
r as (
  select generico, 'ponderador' as columna, xw as x, pw as p, xw as final,
    case when xw = pw then 'ambas' else 'xlsx' end as origen, case when xw = pw then 'igual' when a % 3 = 1 then 'redondeo' else 'preferido' end as metodo from e
  union all select generico, 'COG', xcog, pcog, case when xcog = pcog then pcog else xcog end, case when xcog = pcog then 'ambas' else 'xlsx' end, case when xcog = pcog then 'igual' else 'preferido' end from e
  union all select generico, 'CCIF division', xdiv, pdiv, case when xdiv = substr(pdiv, 4) then pdiv when xdiv = '' then '' else substr(pdiv, 1, 3) || xdiv end, case when xdiv = substr(pdiv, 4) then 'pdf' when xdiv = '' then 'xlsx' else 'mixto' end, case when xdiv = substr(pdiv, 4) then 'igual' else 'preferido' end from e
  union all select generico, 'CCIF grupo', null, pgrp, pgrp, 'pdf', case when pgrp <> '' then 'directo' end from e
  union all select generico, 'inflacion componente', xcomp, null, xcomp, 'xlsx', 'directo' from e
  union all select generico, c, null, '', '', 'pdf', null from e, (select unnest(['CCIF clase', 'SCIAN sector', 'SCIAN rama', 'durabilidad']) as c)
  union all select generico, c, '', null, '', 'xlsx', null from e, (select unnest(['inflacion subcomponente', 'inflacion agrupacion', 'canasta basica']) as c))"""


@_query(_RESOLVED + " select generico, columna, x as valor_xlsx, p as valor_pdf, final as valor_final, origen, metodo from r")
def cruce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item and column of a workbook and a manual, with where its value comes from and how it was found."""
    return audit.resolutions(*_item_extracts(spark, sf_dir), 2018, "xlsx")


@_query(_RESOLVED + " select generico, " + ", ".join(f"""coalesce(max(case when columna = '{c}' then final end), '') as "{c}" """ for c in FILE_COLUMNS[1:]) + " from r group by 1")
def canasta_cruzada(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.resolved(audit.resolutions(*_item_extracts(spark, sf_dir), 2018, "xlsx"))


_TREE = """,
ev as (select columna, final, case when metodo in ('preferido', 'interactiva') then 'decision' else metodo end as m, case when metodo is not null then origen end as o from r where columna <> 'ponderador'),
f1 as (select columna, final, m, o, count(*) as n from ev group by 1, 2, 3, 4),
f2 as (select columna, final, m, sum(n)::bigint as n, map_from_entries(list({'k': o, 'v': n} order by o) filter (o is not null)) as os from f1 group by 1, 2, 3),
f3 as (
  select columna, final, sum(n)::bigint as n, count(m) as events, coalesce(sum(n) filter (m is not null), 0)::bigint as decided, map_from_entries(list({'k': m, 'v': n} order by m) filter (m is not null)) as metodos,
    any_value(os) filter (m = 'igual') as oi, any_value(os) filter (m = 'decision') as od, any_value(os) filter (m = 'directo') as ox
  from f2 group by 1, 2)
select columna, case when final = '' then 'sin_clasificar' else final end as categoria, case when final <> '' then n else decided end as genericos, coalesce(metodos::json::varchar, '{}') as metodos, oi::json::varchar as origenes_igual, od::json::varchar as origenes_decision, ox::json::varchar as origenes_directo
from f3 where final <> '' or events > 0"""


@_query(_RESOLVED + _TREE)
def metodos_por_categoria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested counts of the audit document, a row a category."""
    tree = audit.method_tree(audit.resolutions(*_item_extracts(spark, sf_dir), 2018, "xlsx"))
    rows = tree.select("columna", F.explode("clasificacion.categorias").alias("categoria", "e"))
    return rows.select("columna", "categoria", "e.genericos", *(F.to_json(f"e.{c}").alias(c) for c in ("metodos", "origenes_igual", "origenes_decision", "origenes_directo")))


_COUNTS = """,
n as (select columna, v, count(*) as n from ({long}) where v <> '' group by 1, 2),
all_ as (select columna, coalesce(sum(n), 0)::bigint as genericos_clasificados, count(v) as categorias_unicas, coalesce(map_from_entries(list({{'k': v, 'v': n}} order by v) filter (v is not null)), map {{}})::json as categorias from (select distinct columna from ({long})) left join n using (columna) group by 1),
tree as (select map_from_entries(list({{'k': columna, 'v': {{'genericos_clasificados': genericos_clasificados, 'categorias_unicas': categorias_unicas, 'categorias': categorias}}}} order by columna))::json as c from all_)"""


@_query(_ITEMS + _COUNTS.format(long="select generico, 'COG' as columna, xcog as v from e union all select generico, 'CCIF division', xdiv from e union all select generico, 'inflacion componente', xcomp from e") + """
select to_json({'tipo': 'xlsx', 'xlsx': 'part', 'version': 2018, 'genericos': (select count(*) from e), 'ponderadores': (select count(*) from e), 'clasificaciones': c, 'genericos_detalle': (select list({'generico': generico, 'ponderador': xw} order by generico, xw) from e)})::varchar as registro from tree""")
def registro_xlsx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit document of a run over a workbook alone."""
    return audit.xlsx_document(_item_extracts(spark, sf_dir)[0], 2018, xlsx="part")


@_query(_RESOLVED + _TREE.replace("select columna, case when final = ''", ", rows_ as (select columna, case when final = ''").rstrip() + """),
tree as (
  select map_from_entries(list({'k': columna, 'v': {'genericos': g, 'categorias_unicas': u, 'categorias': c}} order by columna))::json as c from (
    select columna, coalesce(sum(n) filter (final <> ''), 0)::bigint as g, count(*) filter (final <> '') as u,
      coalesce(map_from_entries(list({'k': case when final = '' then 'sin_clasificar' else final end, 'v': ('{"genericos":' || case when final <> '' then n else decided end || ',"metodos":' || coalesce(metodos::json::varchar, '{}') || coalesce(',"origenes_igual":' || oi::json::varchar, '')
        || coalesce(',"origenes_decision":' || od::json::varchar, '') || coalesce(',"origenes_directo":' || ox::json::varchar, '') || '}')::json} order by case when final = '' then 'sin_clasificar' else final end) filter (final <> '' or events > 0)), map {})::json as c
    from f3 group by 1))
select to_json({'tipo': 'xlsx_pdf', 'preferir': 'xlsx', 'xlsx': 'part', 'pdf': 'part', 'version': 2018, 'genericos': (select count(*) from e), 'ponderadores': (select count(*) from e), 'clasificaciones': c,
  'genericos_detalle': (select list({'generico': generico, 'ponderador': {'valor': final, 'origen': origen, 'metodo': metodo}} order by generico) from r where columna = 'ponderador')})::varchar as registro from tree""")
def registro_cruce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit document of a run over workbook and manual."""
    return audit.cross_document(audit.resolutions(*_item_extracts(spark, sf_dir), 2018, "xlsx"), 2018, "xlsx", xlsx="part", pdf="part")


@_query(_ITEMS + ", s as (select generico, case when a % 3 = 0 then 'sector viejo' else xcomp end as old_s, xcomp as new_s, case when a % 5 = 0 then '' else t2 end as old_r, t2 as new_r from (select *, substr(pdiv, 4) as t2 from e))" + _COUNTS.format(long="select generico, 'SCIAN sector' as columna, new_s as v from s union all select generico, 'SCIAN rama', new_r from s") + """
select to_json({'tipo': 'sincronizacion', 'version_fuente': 2013, 'version_destino': 2010, 'csv_fuente': 'part', 'genericos': (select count(*) from s), 'celdas_actualizadas': (select sum((old_s <> new_s)::int + (old_r <> new_r)::int)::bigint from s), 'clasificaciones': c,
  'genericos_detalle': (select list({'generico': generico, 'SCIAN sector': new_s, 'SCIAN rama': new_r, 'cambio': old_s <> new_s or old_r <> new_r} order by generico) from s)})::varchar as registro from tree""")
def registro_sincronizacion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit document of a basket that gets two columns of the next version's."""
    xlsx, pdf = _item_extracts(spark, sf_dir)
    both = xlsx.select("generico", "inflacion componente").join(pdf.select("generico", F.expr("substr(`CCIF division`, 4)").alias("_r")), "generico")
    a = F.ascii("generico") * 3 + F.ascii(F.split_part("generico", F.lit(" "), F.lit(2))) + F.length("generico")
    source = both.select("generico", F.col("inflacion componente").alias("SCIAN sector"), F.col("_r").alias("SCIAN rama"))
    target = source.select("generico", F.when(a % 3 == 0, "sector viejo").otherwise(F.col("SCIAN sector")).alias("SCIAN sector"), F.when(a % 5 == 0, "").otherwise(F.col("SCIAN rama")).alias("SCIAN rama"))
    return audit.sync_document(audit.synchronised(target, source), csv_fuente="part")
