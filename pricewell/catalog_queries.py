"""The price-index operators as registered queries with their SQL. Values are rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .functions.periods import date_column, text_column
from .operators import charts, consult, convert, extracts, incidence, laspeyres, validate, variation
from .plans import demo
from .scratch import written

Query = Callable[[SparkSession, str], DataFrame]
_REGISTERED: dict[str, tuple[Query, str | None]] = {}
_KEPT: dict[tuple[str, str, str], DataFrame | demo.Inputs] = {}

START3, JUNTA2, JUNTA4, LAST = 47965, 47929, 48005, 48044


def _query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _REGISTERED[f.__name__] = (f, sql)
        return f

    return register


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame | demo.Inputs]) -> DataFrame | demo.Inputs:
    """A table that several queries of one application read."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def _inputs(spark: SparkSession, sf_dir: str) -> demo.Inputs:
    return _once(spark, sf_dir, "inputs", lambda: demo.inputs(spark, sf_dir))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "raw", lambda: written(demo.raw(_inputs(spark, sf_dir)), "raw"))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "linked", lambda: written(convert.linked_history(_raw(spark, sf_dir), _inputs(spark, sf_dir).ranges, _inputs(spark, sf_dir).renames), "linked"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "history", lambda: written(convert.rebase(convert.splice(_linked(spark, sf_dir)), START3, check=False), "history"))


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "months", lambda: written(convert.to_months(_history(spark, sf_dir)), "months"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


_BASE = f"""
with recursive panel as (
  select p_name as generico, (year(l_shipdate) * 24 + (month(l_shipdate) - 1) * 2 + case when day(l_shipdate) > 15 then 1 else 0 end)::int as ord,
    avg(l_extendedprice / l_quantity) as precio, sum(l_extendedprice) as ingreso
  from lineitem join part on l_partkey = p_partkey group by 1, 2),
eras(version, ini, fin, metodo, bloque) as (values (1, 47880, {JUNTA2}, 'directo', 'A'), (2, {JUNTA2}, {START3}, 't1', 'A'), (3, {START3}, {JUNTA4}, 'directo', 'B'), (4, {JUNTA4}, null::int, 't2', 'B')),
by_era as (select * from panel join eras on ord >= ini and (fin is null or ord <= fin)),
firsts as (select b.bloque, generico, arg_min(precio, ord) as precio_base from panel join (values ('A', 47880), ('B', {START3})) b(bloque, desde) on ord >= desde group by 1, 2),
series as (select version, generico, ord, precio / precio_base * 100 as valor from by_era join firsts using (bloque, generico)),
spent as (select version, generico, sum(ingreso) as ingreso from by_era group by 1, 2),
weights as (select version, generico, ingreso * 100 / sum(ingreso) over (partition by version) as ponderador from spent),
grid as (select w.version, w.generico, p.ord, s.valor from weights w join (select distinct version, ord from series) p using (version) left join series s on s.version = w.version and s.generico = w.generico and s.ord = p.ord),
filled as (
  select version, generico, ord, valor as original,
    coalesce(first_value(valor ignore nulls) over (partition by version, generico order by ord rows between current row and unbounded following),
      last_value(valor ignore nulls) over (partition by version, generico order by ord rows between unbounded preceding and current row)) as valor,
    case when valor is null then coalesce(first_value(case when valor is not null then ord end ignore nulls) over (partition by version, generico order by ord rows between current row and unbounded following),
      last_value(case when valor is not null then ord end ignore nulls) over (partition by version, generico order by ord rows between unbounded preceding and current row)) end as fuente_ord
  from grid),
factors as (
  select w.version, w.generico, ponderador, case version when 2 then l.valor / 100 * (1 + (length(w.generico) % 5 - 2) / 100.0) when 4 then l.valor / 100 else 1.0 end as f
  from weights w join eras using (version) left join filled l on l.version = w.version and l.generico = w.generico and l.ord = eras.ini),
classes as (
  select version, generico, unnest(['INPC', 'SUSTANTIVO', 'ADJETIVO', 'RENOMBRE']) as tipo,
    unnest(['INPC', split_part(generico, ' ', 2),
      case when version = 4 and split_part(generico, ' ', 1) = '{demo.MOVED_ITEM}' and split_part(generico, ' ', 2) = '{demo.RENAMED_CLASS}' then 'otro' else split_part(generico, ' ', 1) end,
      case when version = 4 and split_part(generico, ' ', 2) = '{demo.RENAMED_CLASS}' then '{demo.NEW_NAME}' else split_part(generico, ' ', 2) end]) as categoria
  from weights),
native as (
  select version, tipo, categoria as indice, ord,
    case when bool_or(valor is null) then null else sum(ponderador * valor / f) / sum(ponderador) end as j, sum(ponderador * f) / sum(ponderador) as f_grupo,
    case when bool_or(valor is null) then 'sin_datos' when bool_or(original is null) then 'rellenado' else 'ok' end as estado,
    count(*) as esperados, count(valor) as con_indice, sum(ponderador) as w_esperado, coalesce(sum(case when valor is not null then ponderador end), 0) as w_cubierto
  from filled join factors using (version, generico) join classes using (version, generico) group by 1, 2, 3, 4),
raw as (select * replace (case when version = 4 and tipo = 'RENOMBRE' and indice = '{demo.NEW_NAME}' then '{demo.RENAMED_CLASS}' else indice end as indice) from native),
h1 as (select distinct 1 as version, tipo, indice, 1.0::double as h from raw where version = 1),
r2 as (select tipo, indice, j * h as ref from raw join h1 using (version, tipo, indice) where ord = {JUNTA2} and j is not null),
h2 as (select 2 as version, tipo, indice, coalesce(ref / j, 1.0) as h from raw left join r2 using (tipo, indice) where version = 2 and ord = {JUNTA2}),
r3 as (select tipo, indice, j * h as ref from raw join h2 using (version, tipo, indice) where ord = {START3} and j is not null),
h3 as (select 3 as version, tipo, indice, coalesce(ref / j, 1.0) as h from raw left join r3 using (tipo, indice) where version = 3 and ord = {START3}),
r4 as (select tipo, indice, j * h as ref from raw join h3 using (version, tipo, indice) where ord = {JUNTA4} and j is not null),
h4 as (select 4 as version, tipo, indice, coalesce(ref / 100, f_grupo) as h from raw left join r4 using (tipo, indice) where version = 4 and ord = {JUNTA4}),
linked as (select raw.*, j * h as i from raw join (select * from h1 union all select * from h2 union all select * from h3 union all select * from h4) using (version, tipo, indice)),
spliced as (select * from linked qualify row_number() over (partition by tipo, ord, indice order by version) = 1),
hist as (select * replace (i * (100.0 / max(case when ord = {START3} then i end) over (partition by tipo, indice)) as i) from spliced),
hist0 as (select * replace (coalesce(h.i, s.i) as i) from hist h join (select tipo, indice, ord, i from spliced) s using (tipo, indice, ord)),
months as (
  select tipo, indice, (ord // 2)::int as ord, arg_max(version, ord) as version, avg(i) as i, avg(j) as j,
    case when count(i) = 2 then (case when bool_or(estado = 'rellenado') then 'rellenado' else 'ok' end) when count(i) = 1 then 'parcial' else 'sin_datos' end as estado, min(con_indice * 100.0 / esperados) as cobertura
  from hist0 group by 1, 2, 3)
"""


def _sql(select: str) -> str:
    return _BASE + select


def _variation_sql(source: str, join: str, kind: str, where: str = "") -> str:
    return _sql(f"""
select t.tipo, t.ord, t.indice, '{kind}' as clase_variacion, round((t.i / b.i - 1) * 100, 6) as variacion_pp,
  case when t.estado = 'parcial' or b.estado = 'parcial' then 'parcial' else 'ok' end as estado_calculo, t.version as version_t
from {source} t join {source} b on b.tipo = t.tipo and b.indice = t.indice and b.ord = {join} where t.i is not null and b.i is not null {where}""")


@_query(_sql(f"select ord, indice, round(j, 6) as indice_replicado, estado as estado_calculo from native where version = 3 and tipo = 'INPC'"))
def indice_directo(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = laspeyres.link(_raw(spark, sf_dir), _inputs(spark, sf_dir).ranges).where("version = 3 and tipo = 'INPC'")
    return _rounded(out.select("ord", "indice", "indice_replicado", "estado_calculo"), "indice_replicado")


@_query(_sql("select version, tipo, ord, indice, round(j, 6) as indice_incidencia, estado as estado_calculo from native where tipo <> 'INPC'"))
def indice_clase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_raw(spark, sf_dir).where("tipo <> 'INPC'").select("version", "tipo", "ord", "indice", "indice_incidencia", "estado_calculo"), "indice_incidencia")


@_query(_sql("""select version, tipo, ord, indice, esperados as genericos_esperados, con_indice as genericos_con_indice, esperados - con_indice as genericos_sin_indice,
  round(con_indice * 100.0 / esperados, 6) as cobertura_genericos_pct, round(w_esperado, 6) as ponderador_esperado, round(w_cubierto, 6) as ponderador_cubierto from native"""))
def cobertura(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_raw(spark, sf_dir).select("version", "tipo", "ord", "indice", *laspeyres.COVERAGE), "cobertura_genericos_pct", "ponderador_esperado", "ponderador_cubierto")


@_query(_sql("select version, generico, ord, round(original, 6) as original, round(valor, 6) as valor, fuente_ord from filled"))
def relleno(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_filled(spark, sf_dir), "original", "valor")


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _inputs(spark, sf_dir)
    return laspeyres.fill(laspeyres.grid(laspeyres.trim(x.series, x.ranges), x.basket))


@_query(_sql("""select f.version, tipo, ord, generico, 'periodo' as nivel_faltante, case when valor is null then 'indice' else 'relleno' end as tipo_faltante, fuente_ord
from filled f join classes using (version, generico) where original is null"""))
def diagnostico(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laspeyres.diagnostics(_filled(spark, sf_dir), _inputs(spark, sf_dir).classes)


@_query(_sql("select tipo, ord, indice, round(i, 6) as indice_replicado, round(j, 6) as indice_incidencia from linked where version = 2"))
def encadenado_t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_linked(spark, sf_dir).where("version = 2").select("tipo", "ord", "indice", "indice_replicado", "indice_incidencia"), "indice_replicado", "indice_incidencia")


@_query(_sql("select tipo, ord, indice, round(i, 6) as indice_replicado, round(j, 6) as indice_incidencia from linked where version = 4"))
def encadenado_t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_linked(spark, sf_dir).where("version = 4").select("tipo", "ord", "indice", "indice_replicado", "indice_incidencia"), "indice_replicado", "indice_incidencia")


@_query(_sql("select tipo, ord, indice, round(j * f_grupo, 6) as indice_replicado from native where version = 4"))
def t2_sin_referencia(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = laspeyres.link(_raw(spark, sf_dir), _inputs(spark, sf_dir).ranges).where("version = 4")
    return _rounded(out.select("tipo", "ord", "indice", "indice_replicado"), "indice_replicado")


@_query(_sql("select tipo, ord, indice, version, round(i, 6) as indice_replicado from spliced"))
def empalme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(convert.splice(_linked(spark, sf_dir)).select("tipo", "ord", "indice", "version", "indice_replicado"), "indice_replicado")


@_query(_sql("select tipo, ord, indice, version, round(i, 6) as indice_replicado, round(j, 6) as indice_incidencia, estado as estado_calculo from hist0"))
def historia(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_history(spark, sf_dir).select("tipo", "ord", "indice", "version", "indice_replicado", "indice_incidencia", "estado_calculo"), "indice_replicado", "indice_incidencia")


@_query(_sql("select tipo, ord, indice, version, round(i, 6) as indice_replicado, round(j, 6) as indice_incidencia, estado as estado_calculo, round(cobertura, 6) as cobertura_genericos_pct from months"))
def historia_mensual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_months(spark, sf_dir).select("tipo", "ord", "indice", "version", "indice_replicado", "indice_incidencia", "estado_calculo", "cobertura_genericos_pct"), "indice_replicado", "indice_incidencia", "cobertura_genericos_pct")


@_query(_sql(f"""select tipo, ord, indice, version as version_old, case ord when {JUNTA2} then 2 when {START3} then 3 else 4 end as version_new, round(j, 6) as indice_incidencia_old, round(i, 6) as indice_replicado_old
from hist0 where ord in ({JUNTA2}, {START3}, {JUNTA4})"""))
def frontera(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(convert.frontier(_history(spark, sf_dir), _inputs(spark, sf_dir).ranges), "indice_incidencia_old", "indice_replicado_old")


def _variation(rows: DataFrame) -> DataFrame:
    return _rounded(variation.values(rows).drop("periodicidad"), "variacion_pp")


@_query(_variation_sql("hist0", "t.ord - 1", "periodica_quincenal"))
def var_quincenal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variation(variation.periodic(_history(spark, sf_dir), "quincenal", "Q"))


@_query(_variation_sql("hist0", "t.ord - 24", "periodica_anual"))
def var_anual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variation(variation.periodic(_history(spark, sf_dir), "anual", "Q"))


@_query(_variation_sql("months", "t.ord - 1", "periodica_mensual"))
def var_mensual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variation(variation.periodic(_months(spark, sf_dir), "mensual", "M"))


@_query(_variation_sql("hist0", "(t.ord // 24) * 24 - 1", "acumulada_anual"))
def var_acumulada(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variation(variation.year_to_date(_history(spark, sf_dir), "Q"))


@_query(_sql(f"""
select t.tipo, t.ord, t.indice, round((t.i / b.i - 1) * 100, 6) as variacion_pp, t.ord <> {LAST} or b.ord <> {START3} as parcial_de_rango
from (select tipo, indice, min(ord) as a, max(ord) as z from hist0 where i is not null and ord between {START3} and {LAST} group by 1, 2) e
join hist0 t on t.tipo = e.tipo and t.indice = e.indice and t.ord = z join hist0 b on b.tipo = e.tipo and b.indice = e.indice and b.ord = a"""))
def var_desde(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = variation.from_to(_history(spark, sf_dir), START3, LAST).where("computable")
    return _rounded(out.select("tipo", "ord", "indice", "variacion_pp", "parcial_de_rango"), "variacion_pp")


@_query(_sql("""select t.tipo, t.ord, t.indice, case when b.i is null then 'sin_datos' else 'ok' end as estado_calculo, case when b.i is null then 'sin valor replicado en periodo base' end as motivo_error, t.ord - 24 as ord_lag
from hist0 t left join hist0 b on b.tipo = t.tipo and b.indice = t.indice and b.ord = t.ord - 24"""))
def var_reporte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variation.periodic(_history(spark, sf_dir), "anual", "Q").select("tipo", "ord", "indice", "estado_calculo", "motivo_error", "ord_lag")


_ANNUAL = "(select t.tipo, t.ord, t.indice, (t.i / b.i - 1) * 100 as v from hist0 t join hist0 b on b.tipo = t.tipo and b.indice = t.indice and b.ord = t.ord - 24)"


def _annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variation.values(variation.periodic(_history(spark, sf_dir), "anual", "Q"))


@_query(_sql(f"select tipo, indice, round(v, 6) as variacion_pp from {_ANNUAL} where ord = 48000"))
def inflacion_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(consult.at(_annual(spark, sf_dir), "variacion_pp", 48000), "variacion_pp")


@_query(_sql(f"select tipo, indice, round(sum(v), 6) as acumulada from {_ANNUAL} where ord between 47950 and 48000 group by 1, 2"))
def inflacion_acumulada(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(consult.total(_annual(spark, sf_dir), "variacion_pp", 47950, 48000), "acumulada")


@_query(_sql(f"select tipo, indice, round(avg(v), 6) as promedio from {_ANNUAL} group by 1, 2"))
def inflacion_promedio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(consult.mean(_annual(spark, sf_dir), "variacion_pp"), "promedio")


@_query(_sql("select tipo, indice, round((pow(product(1 + v / 100), 24.0 / count(*)) - 1) * 100, 6) as tcac from (select t.tipo, t.ord, t.indice, (t.i / b.i - 1) * 100 as v from hist0 t join hist0 b on b.tipo = t.tipo and b.indice = t.indice and b.ord = t.ord - 1) where ord between 47966 and 48000 group by 1, 2"))
def inflacion_tcac(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = variation.values(variation.periodic(_history(spark, sf_dir), "quincenal", "Q"))
    return _rounded(consult.annual_rate(rows, "Q", 47966, 48000), "tcac")


def _by_class(rows: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A view of one classification, of each of the rows' classifications (a few)."""
    out = None
    for tipo in sorted(r.tipo for r in rows.select("tipo").distinct().collect()):
        one = make(rows.where(F.col("tipo") == tipo))
        one = one if "tipo" in one.columns else one.withColumn("tipo", F.lit(tipo))
        out = one if out is None else out.unionByName(one)
    return out


def _extreme_sql(rows: str, value: str, order: str) -> str:
    return f"select tipo, ord, indice, round(v, 6) as {value} from {rows} where v is not null qualify row_number() over (partition by tipo order by v {order}, ord, indice) = 1"


@_query(_sql(_extreme_sql(_ANNUAL, "variacion_pp", "desc")))
def inflacion_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_by_class(_annual(spark, sf_dir), lambda rows: consult.extreme(rows, "variacion_pp", True)), "variacion_pp")


@_query(_sql(_extreme_sql(_ANNUAL, "variacion_pp", "")))
def inflacion_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_by_class(_annual(spark, sf_dir), lambda rows: consult.extreme(rows, "variacion_pp", False)), "variacion_pp")


_CATEGORY_WEIGHTS = f"""
w as (select version, tipo, case when version = 4 and tipo = 'RENOMBRE' and categoria = '{demo.NEW_NAME}' then '{demo.RENAMED_CLASS}' else categoria end as indice, sum(ponderador) as w from weights join classes using (version, generico) group by 1, 2, 3)"""


def _lagged(lag: str, source: str = "hist0") -> str:
    return f"{source} t join {source} b on b.tipo = t.tipo and b.indice = t.indice and b.ord = {lag}"


def _incidence_rows(pairs: str, kind: str, source: str = "hist0") -> str:
    """CTEs up to `inc`, all contributions of the pairs (t, b); crossing ones by a recursive walk over the link periods between base and t."""
    return (
        _BASE
        + f""", {_CATEGORY_WEIGHTS},
juntas(version, ini) as (values (2, {JUNTA2}), (3, {START3}), (4, {JUNTA4})),
anchors as (select false as junta, tipo, indice, ord, i, j from {source} union all select true, tipo, indice, ord, i, j from hist0 where ord in ({JUNTA2}, {START3}, {JUNTA4})),
pairs as (
  select t.tipo, t.indice, t.ord, t.version as vt, b.version as vb, b.ord as bo, t.i as it, t.j as jt, b.i as ib, b.j as jb, p.i as pib, p.j as pjb,
    t.estado = 'parcial' or b.estado = 'parcial' or p.estado = 'parcial' as parcial, pt.version <> t.version or p.version <> b.version as inpc_otra
  from {pairs}
  join {source} p on p.tipo = 'INPC' and p.ord = b.ord join {source} pt on pt.tipo = 'INPC' and pt.ord = t.ord where t.tipo <> 'INPC'),
walk as (
  select tipo, indice, ord, vt, vb as m, bo as a, false as cut, 0.0::double as total, false as done, pib from pairs where vb <> vt and tipo <> 'ADJETIVO'
  union all
  select k.tipo, k.indice, k.ord, k.vt, k.m + 1, e.ord, true, k.total + (pe.i / pe.j) * w.w * (e.j - case when k.cut then s.i / (e.i / e.j) else s.j end) / k.pib, k.m = k.vt, k.pib
  from walk k left join juntas j on j.version = k.m + 1
  join anchors e on e.junta = (k.m <> k.vt) and e.tipo = k.tipo and e.indice = k.indice and e.ord = case when k.m = k.vt then k.ord else j.ini end
  join anchors pe on pe.junta = e.junta and pe.tipo = 'INPC' and pe.ord = e.ord join anchors s on s.junta = k.cut and s.tipo = k.tipo and s.indice = k.indice and s.ord = k.a
  join w on w.version = k.m and w.tipo = k.tipo and w.indice = k.indice
  where k.m <= k.vt),
inc as (
  select p.tipo, p.ord, p.indice, '{kind}' as clase_incidencia,
    case when p.vb = p.vt and not inpc_otra then w.w * (jt - jb) / pjb when p.vb <> p.vt and p.tipo <> 'ADJETIVO' then k.total else w.w * (it - ib) / p.pib end as v,
    case when p.vb = p.vt and not inpc_otra then 'within' when p.vb <> p.vt and p.tipo <> 'ADJETIVO' then 'cross_segmentado' else 'cross_visible' end as metodo_incidencia, p.vt as version_t,
    case when parcial then 'parcial' else 'ok' end as estado
  from pairs p join w on w.version = vb and w.tipo = p.tipo and w.indice = p.indice left join walk k on k.done and k.tipo = p.tipo and k.indice = p.indice and k.ord = p.ord)
"""
    )


def _incidence_sql(pairs: str, kind: str, source: str = "hist0") -> str:
    return _incidence_rows(pairs, kind, source) + "select tipo, ord, indice, clase_incidencia, round(v, 6) as incidencia_pp, metodo_incidencia, version_t from inc where v is not null"


def _incidence(spark: SparkSession, sf_dir: str, make: Callable[..., DataFrame], *args: object, **more: object) -> DataFrame:
    x = _inputs(spark, sf_dir)
    return make(_history(spark, sf_dir), demo.category_weights(x), x.ranges, demo.steady(x), *args, **more)


def _values(rows: DataFrame) -> DataFrame:
    return _rounded(rows.where("computable").select("tipo", "ord", "indice", "clase_incidencia", "incidencia_pp", "metodo_incidencia", "version_t"), "incidencia_pp")


@_query(_incidence_sql(_lagged("t.ord - 1"), "periodica_quincenal"))
def inc_quincenal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(_incidence(spark, sf_dir, incidence.periodic, "quincenal", "Q"))


@_query(_incidence_sql(_lagged("t.ord - 24"), "periodica_anual"))
def inc_anual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(_incidence(spark, sf_dir, incidence.periodic, "anual", "Q"))


@_query(_incidence_sql(_lagged("(t.ord // 24) * 24 - 1"), "acumulada_anual"))
def inc_acumulada(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(_incidence(spark, sf_dir, incidence.year_to_date, "Q"))


@_query(_incidence_sql(f"""(select tipo, indice, min(ord) as a, max(ord) as z from hist0 where i is not null and ord between 47900 and {LAST} group by 1, 2) e
  join hist0 t on t.tipo = e.tipo and t.indice = e.indice and t.ord = z join hist0 b on b.tipo = e.tipo and b.indice = e.indice and b.ord = a""", "desde"))
def inc_desde(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(_incidence(spark, sf_dir, incidence.from_to, 47900, LAST, "Q"))


@_query(_incidence_sql(_lagged("t.ord - 12", "months"), "periodica_anual", "months"))
def inc_mensual_frontera(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, h = _inputs(spark, sf_dir), _history(spark, sf_dir)
    return _values(incidence.periodic(_months(spark, sf_dir), demo.category_weights(x), x.ranges, demo.steady(x), "anual", "M", convert.frontier(h, x.ranges)))


@_query(_incidence_rows(_lagged("t.ord - 24"), "periodica_anual") + """select t.ord, s.tipo, round((t.i / b.i - 1) * 100 - s.v, 6) + 0.0 as residuo
from hist0 t join hist0 b on b.tipo = 'INPC' and b.ord = t.ord - 24 join (select tipo, ord, sum(v) as v from inc where tipo <> 'ADJETIVO' group by 1, 2) s on s.ord = t.ord where t.tipo = 'INPC'""")
def inc_aditividad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline variation less the sum of contributions: nothing, across baskets too."""
    parts = _incidence(spark, sf_dir, incidence.periodic, "anual", "Q").where("computable and tipo <> 'ADJETIVO'").groupBy("tipo", "ord").agg(F.sum("incidencia_pp").alias("s"))
    head = _annual(spark, sf_dir).where("tipo = 'INPC'").select("ord", "variacion_pp")
    return parts.join(head, "ord").select("ord", "tipo", (F.round(F.col("variacion_pp") - F.col("s"), 6) + 0.0).alias("residuo"))


_OFFICIAL = "(select tipo, indice, ord, case when ord % 7 = 3 then null else i + (case when ord % 5 = 0 then 0.5 else 0 end) end as oficial from hist0 where ord % 11 <> 4)"


def _official(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures with periods left out, gaps and differences."""
    off = F.when(F.col("ord") % 5 == 0, 0.5).otherwise(0.0)
    return _history(spark, sf_dir).where("ord % 11 <> 4").select("tipo", "indice", "ord", F.when(F.col("ord") % 7 != 3, F.col("indice_replicado") + off).alias("oficial"))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.compare(_history(spark, sf_dir), _official(spark, sf_dir), "indice_replicado", validate.INDEX_TOLERANCE)


_STATE = "case when o.tipo is null then 'fuera_rango_inegi' when o.oficial is null then 'no_disponible' when abs(t.i - o.oficial) <= 0.0009 then 'ok' when t.estado = 'parcial' then 'diferencia_por_parcial' else 'diferencia_detectada' end"


@_query(_sql(f"select t.tipo, t.ord, t.indice, t.version, {_STATE} as estado_validacion, round(abs(t.i - o.oficial), 6) as error from hist0 t left join {_OFFICIAL} o on o.tipo = t.tipo and o.indice = t.indice and o.ord = t.ord"))
def val_indice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_compared(spark, sf_dir).select("tipo", "ord", "indice", "version", "estado_validacion", "error"), "error")


@_query(_sql(f"""select version, tipo, count(*) as n_filas, count(err) as n_comparables, count(*) filter (s = 'ok') as n_ok, count(*) filter (s = 'diferencia_detectada') as n_diferencia_detectada,
  count(*) filter (s = 'fuera_rango_inegi') as n_fuera_rango_inegi, round(max(err), 6) as error_maximo,
  case when count(*) filter (s = 'diferencia_detectada') > 0 then 'diferencia_detectada' when count(*) filter (s = 'diferencia_por_parcial') > 0 then 'diferencia_por_parcial' when count(*) filter (s = 'sin_calculo') > 0 then 'sin_calculo'
    when count(*) filter (s = 'ok') = 0 then 'no_disponible' else 'ok' end as estado_global
from (select t.version, t.tipo, {_STATE} as s, abs(t.i - o.oficial) as err from hist0 t left join {_OFFICIAL} o on o.tipo = t.tipo and o.indice = t.indice and o.ord = t.ord) group by 1, 2"""))
def val_resumen(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate.summary(_compared(spark, sf_dir), "version", "tipo")
    return _rounded(out.select("version", "tipo", "n_filas", "n_comparables", "n_ok", "n_diferencia_detectada", "n_fuera_rango_inegi", "error_maximo", "estado_global"), "error_maximo")


@_query(_sql("select version, tipo, min(ord)::int as desde, max(ord)::int as hasta, count(*) as filas, case when bool_or(estado = 'rellenado') then 'rellenado' else 'ok' end as estado_peor from hist0 group by 1, 2"))
def resumen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.summary(_history(spark, sf_dir))


@_query("""select distinct p_name || ' ' || upper(substr(p_name, 1, 1)) || 'Áñ-' || p_size as texto,
  lower(trim(regexp_replace(regexp_replace(translate(p_name || ' ' || upper(substr(p_name, 1, 1)) || 'Áñ-' || p_size, 'áéíóúüÁÉÍÓÚÜ', 'aeiouuAEIOUU'), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g'))) as normal from part""")
def normalizar(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" "), F.upper(F.substring("p_name", 1, 1)), F.lit("Áñ-"), "p_size")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(name.alias("texto")).distinct().select("texto", text.normalized(F.col("texto")).alias("normal"))


@_query(_sql("""select distinct ord, (ord % 2 + 1) || 'Q ' || ['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic'][(ord % 24) // 2 + 1] || ' ' || ord // 24 as periodo,
  case when ord % 2 = 0 then make_date(ord // 24, (ord % 24) // 2 + 1, 15) else last_day(make_date(ord // 24, (ord % 24) // 2 + 1, 15)) end as fecha from panel"""))
def periodos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _history(spark, sf_dir).select("ord", "periodicidad").distinct()
    return rows.select("ord", text_column(F.col("ord"), F.col("periodicidad")).alias("periodo"), date_column(F.col("ord"), F.col("periodicidad")).alias("fecha"))


@_query(_sql("""select tipo, indice, case when indice = 'INPC' then null when r < more * (q + 1) then r // (q + 1) else more + (r - more * (q + 1)) // q end as panel
from (select *, n // k as q, n % k as more from (select tipo, indice, row_number() over (partition by tipo order by indice) - 1 as r, count(*) over (partition by tipo) as n, ceil(count(*) over (partition by tipo) / 8.0)::bigint as k from (select distinct tipo, indice from hist0)))"""))
def paneles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panels of every classification."""
    return _by_class(_history(spark, sf_dir), charts.panels).select("tipo", "indice", F.col("panel").cast("long").alias("panel"))


@_query(_sql("""select tipo, ord, 'resto ' || case when v >= 0 then 'positivo' else 'negativo' end as indice, round(sum(v), 6) as valor from (select tipo, ord, round(i - 100, 9) + 0.0 as v from hist0 where i is not null) group by 1, 2, 3"""))
def apilado(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _history(spark, sf_dir).select("tipo", "ord", "indice", (F.round(F.col("indice_replicado") - 100, 9) + 0.0).alias("valor"))
    return _rounded(_by_class(rows, lambda own: charts.remainders(own, "valor")), "valor")


@_query("""select generico, case when x = p then 'igual' when round(x::double, 1) = p::double and length(p) < length(x) then 'redondeo' else 'preferido' end as metodo
from (select p_partkey::varchar as generico, printf('%.2f', p_retailprice) as x,
  case p_partkey % 3 when 0 then printf('%.2f', p_retailprice) when 1 then printf('%.1f', round(p_retailprice, 1)) else printf('%.2f', p_retailprice + 1) end as p from part)""")
def match_fila(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    one = part.select(F.col("p_partkey").cast("string").alias("generico"), F.format_string("%.2f", "p_retailprice").alias("ponderador"))
    price = F.col("p_retailprice")
    other = F.when(F.col("p_partkey") % 3 == 0, F.format_string("%.2f", price)).when(F.col("p_partkey") % 3 == 1, F.format_string("%.1f", F.round(price, 1))).otherwise(F.format_string("%.2f", price + 1))
    two = part.select(F.col("p_partkey").cast("string").alias("generico"), other.alias("ponderador"))
    return extracts.match_numbers(one, two, "ponderador").select("generico", "metodo")


def forget(*kept: str) -> None:
    """Later queries make their inputs and histories anew, but for those named."""
    for key in [k for k in _KEPT if k[2] not in kept]:
        del _KEPT[key]


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _REGISTERED.items()}


def oracle() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTERED.items() if sql}
