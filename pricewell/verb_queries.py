"""Registered queries through the everyday verbs: two versions of the catalogue whose categories and items change their names, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api, renames
from . import catalog_queries as Q
from .operators import convert, incidence, validate
from .plans import demo
from .results import Result
from .scratch import written
from .sources import baskets

_query, _rounded = Q._query, Q._rounded
INI, JUNTA = 48445, 48589


def _versioned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return Q._once(spark, sf_dir, "versioned", lambda: demo.versioned(spark, sf_dir))


def _verb_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half months under the names of 2024, as the verb gives them."""
    return Q._once(spark, sf_dir, "verb history", lambda: written(api.calcular_historia(*_versioned(spark, sf_dir), mensual=False), "history"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(k: int) -> str:
    return "[" + ", ".join(_quoted(d[k]) for d in demo.DIVISIONS) + "]"


#: items: the baskets; cat: items with their category, under the names of 2024 (nombre) and their own (nativo); hist: the history.
_BASE = f"""
with panel as (
  select p_name as parte, (year(l_shipdate) * 24 + (month(l_shipdate) - 1) * 2 + case when day(l_shipdate) > 15 then 1 else 0 end)::int + {demo.SHIFT} as ord,
    avg(l_extendedprice / l_quantity) as precio, sum(l_extendedprice) as ingreso
  from lineitem join part on l_partkey = p_partkey group by 1, 2),
eras(version, ini, fin) as (values (2018, {INI}, {JUNTA}), (2024, {JUNTA}, null::int)),
by_era as (select * from panel join eras on ord >= ini and (fin is null or ord <= fin)),
base as (select parte, arg_min(precio, ord) as precio_base from panel group by 1),
weights as (select version, parte, sum(ingreso) * 100 / sum(sum(ingreso)) over (partition by version) as w, (ascii(parte) * 3 + ascii(split_part(parte, ' ', 2)) + length(parte)) % 12 as k from by_era group by 1, 2),
grid as (select w.version, w.parte, p.ord, b.precio / precio_base * 100 as valor from weights w join (select distinct version, ord from by_era) p using (version) join base using (parte) left join by_era b on b.version = w.version and b.parte = w.parte and b.ord = p.ord),
filled as (
  select version, parte, ord, valor as original,
    coalesce(first_value(valor ignore nulls) over (partition by version, parte order by ord rows between current row and unbounded following), last_value(valor ignore nulls) over (partition by version, parte order by ord rows between unbounded preceding and current row)) as valor
  from grid),
factors as (select w.*, case version when 2024 then valor / 100 else 1.0 end as f from weights w join eras using (version) join filled l using (version, parte) where l.ord = eras.ini),
cat as (
  select version, parte, k, unnest(['INPC', 'INFLACION COMPONENTE', 'CCIF DIVISION', 'DURABILIDAD']) as tipo,
    unnest(['INPC', case when k < 7 then 'subyacente' else 'no subyacente' end, ({_list(1)})[k + 1],
      case when version = 2024 and parte = '{demo.RENAMED_ITEM}' then 'servicios' else ['duraderos', 'servicios', 'no duraderos'][k % 3 + 1] end]) as nombre,
    unnest(['INPC', case when k < 7 then 'subyacente' else 'no subyacente' end, (case version when 2018 then {_list(0)} else {_list(1)} end)[k + 1],
      case when version = 2024 and parte = '{demo.RENAMED_ITEM}' then 'servicios' else ['duraderos', 'servicios', 'no duraderos'][k % 3 + 1] end]) as nativo
  from weights),
raw as (
  select version, tipo, nombre as indice, ord, sum(w * valor / f) / sum(w) as j, case when bool_or(original is null) then 'rellenado' else 'ok' end as estado
  from filled join factors using (version, parte) join cat using (version, parte) group by 1, 2, 3, 4),
linked as (select a.*, a.j * coalesce(r.j / 100, 1.0) as i from raw a left join raw r on a.version = 2024 and r.version = 2018 and r.ord = {JUNTA} and r.tipo = a.tipo and r.indice = a.indice),
spliced as (select * from linked qualify row_number() over (partition by tipo, ord, indice order by version) = 1),
hist as (select s.* replace (s.i * (100.0 / b.i) as i) from spliced s join spliced b on b.tipo = s.tipo and b.indice = s.indice and b.ord = {INI}),
shares as (select version, tipo, nombre as indice, sum(w) as w from weights join cat using (version, parte) group by 1, 2, 3)"""

#: Contributions of the rows of `pairs` (t, b); DURABILIDAD is not stable, as the renamed item moves.
_INC = """,
inc as (
  select t.tipo, t.ord, t.indice, t.version as version_t,
    case when t.version = b.version then o.w * (t.j - b.j) / pb.j
      when t.tipo <> 'DURABILIDAD' then (pm.i / pm.j * o.w * (m.j - b.j) + pt.i / pt.j * n.w * (t.j - m.i / (t.i / t.j))) / pb.i
      else o.w * (t.i - b.i) / pb.i end as v,
    case when t.version = b.version then 'within' when t.tipo <> 'DURABILIDAD' then 'cross_segmentado' else 'cross_visible' end as metodo
  from hist t join hist b on b.tipo = t.tipo and b.indice = t.indice and b.ord = {base}
  join hist pt on pt.tipo = 'INPC' and pt.ord = t.ord join hist pb on pb.tipo = 'INPC' and pb.ord = b.ord
  join shares o on o.version = b.version and o.tipo = t.tipo and o.indice = t.indice join shares n on n.version = t.version and n.tipo = t.tipo and n.indice = t.indice
  join hist m on m.tipo = t.tipo and m.indice = t.indice and m.ord = {junta} join hist pm on pm.tipo = 'INPC' and pm.ord = m.ord
  where t.tipo <> 'INPC')"""
_ANNUAL = _INC.format(base="t.ord - 24", junta=JUNTA)


@_query(_BASE + " select tipo, ord, indice, version, round(i, 6) as indice_replicado, round(j, 6) as indice_incidencia, estado as estado_calculo from hist")
def historia_verbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _verb_history(spark, sf_dir).select("tipo", "ord", "indice", "version", "indice_replicado", "indice_incidencia", "estado_calculo")
    return _rounded(out, "indice_replicado", "indice_incidencia")


def _contributions(rows: DataFrame) -> DataFrame:
    return _rounded(rows.where("computable").select("tipo", "ord", "indice", "incidencia_pp", F.col("metodo_incidencia").alias("metodo"), "version_t"), "incidencia_pp")


_CONTRIBUTIONS = " select tipo, ord, indice, round(v, 6) as incidencia_pp, metodo, version_t from inc"


@_query(_BASE + _ANNUAL + _CONTRIBUTIONS)
def inc_verbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual contributions; the baskets' names are carried to the history's without being told how."""
    return _contributions(api.incidencia_periodica(_verb_history(spark, sf_dir), _versioned(spark, sf_dir)[0], "anual"))


@_query(_BASE + _INC.format(base="(t.ord // 24) * 24 - 1", junta=JUNTA) + _CONTRIBUTIONS)
def inc_verbo_acumulada(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contributions(api.incidencia_acumulada_anual(_verb_history(spark, sf_dir), _versioned(spark, sf_dir)[0]))


@_query(_BASE + _INC.format(base=INI + 30, junta=JUNTA) + _CONTRIBUTIONS + " where ord = (select max(ord) from hist)")
def inc_verbo_desde(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 1Q Nov 2019 (ten half months and twenty more after the start) to the last period."""
    return _contributions(api.incidencia_desde(_verb_history(spark, sf_dir), _versioned(spark, sf_dir)[0], "2Q Oct 2019"))


@_query(_BASE + _ANNUAL + """ select t.ord, s.tipo, round((t.i / b.i - 1) * 100 - s.v, 6) + 0.0 as residuo
from hist t join hist b on b.tipo = 'INPC' and b.ord = t.ord - 24 join (select tipo, ord, sum(v) as v from inc where tipo <> 'DURABILIDAD' group by 1, 2) s on s.ord = t.ord where t.tipo = 'INPC'""")
def inc_verbo_aditividad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline variation less the contributions of a stable classification: nothing, across the renamed classes too."""
    h = _verb_history(spark, sf_dir)
    parts = api.incidencia_periodica(h, _versioned(spark, sf_dir)[0], "anual").where("computable and tipo <> 'DURABILIDAD'").groupBy("tipo", "ord").agg(F.sum("incidencia_pp").alias("s"))
    head = api.variacion_periodica(h.where("tipo = 'INPC'"), "anual").where("computable").select("ord", "variacion_pp")
    return parts.join(head, "ord").select("ord", "tipo", (F.round(F.col("variacion_pp") - F.col("s"), 6) + 0.0).alias("residuo"))


@_query(_BASE + """, names(nombres_de, col) as (values (2018, 0), (2024, 1)),
used as (select nombres_de, tipo, version, case when nombres_de = 2018 and tipo = 'CCIF DIVISION' then (""" + _list(0) + ")[list_position(" + _list(1) + """, indice)] else indice end as indice from hist, names),
fits as (select nombres_de, u.tipo, u.version, bool_and(c.nativo is not null) as own from used u left join (select distinct version, tipo, nativo from cat) c on c.version = u.version and c.tipo = u.tipo and c.nativo = u.indice group by 1, 2, 3)
select nombres_de, tipo, coalesce(max(case when own then version end), max(version)) as canonica from fits group by 1, 2""")
def canonica(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version whose names a history has, told from its rows: of one named as in 2024, and of one named as in 2018."""
    classes, h = baskets.classes_of(_versioned(spark, sf_dir)[0]), _verb_history(spark, sf_dir)
    older = api.renombrar(h.withColumns({"own": F.col("version"), "version": F.lit(2024)}), 2018).withColumn("version", F.col("own"))
    both = [renames.canonical_versions(rows, classes).select(F.lit(v).alias("nombres_de"), "tipo", "canonica") for v, rows in ((2018, older), (2024, h))]
    return both[0].unionByName(both[1])


@_query(_BASE + """ select tipo, min(n) = 2 and max(moves) = 1 as estable from (select tipo, nombre, count(distinct version) over (partition by tipo, nombre) as n, moves
  from cat join (select tipo, parte, count(distinct nombre) as moves from cat group by 1, 2) using (tipo, parte)) group by 1""".replace("count(distinct version) over (partition by tipo, nombre)", "len(list_distinct(list(version) over (partition by tipo, nombre)))"))
def estabilidad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DURABILIDAD is not stable: an item moves, though each version has it under another name."""
    return incidence.stable(renames.aligned(baskets.classes_of(_versioned(spark, sf_dir)[0])))


@_query(_BASE + f""", items as (select distinct version, case when parte = '{demo.RENAMED_ITEM}' then case version when 2018 then '{demo.ITEM_2018}' else '{demo.ITEM_2024}' end else parte end as generico, parte from weights)
select hasta, version, generico, case when parte = '{demo.RENAMED_ITEM}' then case hasta when 2018 then '{demo.ITEM_2018}' else '{demo.ITEM_2024}' end else parte end as nuevo from items, (values (2018), (2024)) v(hasta)""")
def genericos_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of every basket as 2018 and as 2024 name them: forward and back."""
    items = _versioned(spark, sf_dir)[0].select("version", "generico", F.col("generico").alias("nuevo"))
    both = [renames.items_to_version(items, v, "nuevo").select(F.lit(v).alias("hasta"), "version", "generico", "nuevo") for v in (2018, 2024)]
    return both[0].unionByName(both[1])


@_query(_BASE + ", own as (select distinct version, tipo, nativo, nombre, k from cat) select version, tipo, nativo as indice, 2018 as hasta, case when tipo = 'CCIF DIVISION' then (" + _list(0) + ")[k + 1] else nativo end as nuevo from own union select version, tipo, nativo, 2024, nombre from own")
def nombres_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of every basket as 2018 and as 2024 name them, with the code that changes."""
    own = baskets.classes_of(_versioned(spark, sf_dir)[0]).select("version", "tipo", F.col("categoria").alias("indice"), F.col("categoria").alias("nuevo")).distinct()
    both = [renames.to_version(own, v, "nuevo").select("version", "tipo", "indice", F.lit(v).alias("hasta"), "nuevo") for v in (2018, 2024)]
    return both[0].unionByName(both[1])


def _spans(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Both versions by themselves, the later one linked to the earlier, each under its own names."""
    basket, series = _versioned(spark, sf_dir)
    one = []
    for tipo in ("INPC", "CCIF DIVISION"):
        old = api.calcular_indice(basket.where("version = 2018"), series.where("version = 2018"), tipo)
        at = renames.to_version(old.where(F.col("ord") == JUNTA), 2024).select(F.lit(2024).alias("version"), "tipo", "indice", F.col("indice_replicado").alias("referencia"))
        one.append((old, api.calcular_indice(basket.where("version = 2024"), series.where("version = 2024"), tipo, at)))
    return [written(one[0][k].unionByName(one[1][k]), "span") for k in (0, 1)]


@_query(_BASE + " select hasta, tipo, ord, case when hasta = 2018 and tipo <> 'INPC' then (" + _list(0) + ")[list_position(" + _list(1) + ", indice)] else indice end as indice, version, round(i, 6) as indice_replicado from spliced, (values (2018), (2024)) v(hasta) where tipo in ('INPC', 'CCIF DIVISION')")
def empalme_verbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans spliced under the names of either version."""
    spans = Q._once(spark, sf_dir, "spans", lambda: _spans(spark, sf_dir))
    both = [api.empalmar(*reversed(spans), version_nombres=v).select(F.lit(v).alias("hasta"), "tipo", "ord", "indice", "version", "indice_replicado") for v in (2018, 2024)]
    return _rounded(both[0].unionByName(both[1]), "indice_replicado")


@_query("""with p as (select distinct case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2 when '4-NOT SPECIFIED' then 3 else 4 end as t, (year(o_orderdate) * 24 + (month(o_orderdate) - 1) * 2 + case when day(o_orderdate) > 15 then 1 else 0 end)::int as ord from orders),
s as (select t, ord from p where ord between 47880 + 20 * t and 47900 + 20 * t + case when t = 2 then 25 when t = 3 then -2 else 0 end)
select a.t as a, b.t as b, b.t = a.t + 1 as vecinos, coalesce(n, 0)::bigint as n_compartidos, compartido, coalesce(n, 0) <> case when b.t = a.t + 1 then 1 else 0 end as roto
from (select distinct t from s) a join (select distinct t from s) b on a.t < b.t left join (select x.t as a, y.t as b, count(*) as n, min(x.ord) as compartido from s x join s y on x.ord = y.ord and x.t < y.t group by 1, 2) c on c.a = a.t and c.b = b.t""")
def tramos_compartidos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five spans of order periods, of which one is too long and one too short: every pair that breaks the rule is named."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    levels = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).when(F.col("o_orderpriority") == "3-MEDIUM", 2).when(F.col("o_orderpriority") == "4-NOT SPECIFIED", 3).otherwise(4)
    rows = orders.select(levels.alias("_tramo"), demo.half_of_date(F.col("o_orderdate")).cast("int").alias("ord"))
    t = F.col("_tramo")
    return convert.shared_periods(rows.where(F.col("ord").between(47880 + 20 * t, 47900 + 20 * t + F.when(t == 2, 25).when(t == 3, -2).otherwise(0))))


class _Published:
    """An official source over figures that Spark holds: the history's own, with gaps and differences."""

    def __init__(self, history: DataFrame) -> None:
        self._rows = history

    def history(self, periodicity: str, measure: str) -> DataFrame:
        value = {"indice": "indice_replicado", "anual": "variacion_pp"}[measure]
        rows = self._rows if measure == "indice" else api.variacion_periodica(self._rows, "anual")
        off = F.when(F.col("ord") % 5 == 0, 0.5).otherwise(0.0)
        return rows.where("ord % 11 <> 4").select("tipo", "indice", "ord", F.when(F.col("ord") % 7 != 3, F.col(value) + off).alias("oficial"))

    def at(self, periods: DataFrame, periodicity: str, measure: str) -> DataFrame:
        return self.history(periodicity, measure).join(F.broadcast(periods.select("ord").distinct()), "ord", "left_semi")


_VALIDATED = """, v as (
  select t.tipo, t.ord, t.i is not null and b.i is not null as computable, (t.i / b.i - 1) * 100 as x, case when t.ord % 11 = 4 then 'fuera_rango_inegi' when t.ord % 7 = 3 or b.i is null then 'no_disponible' when t.ord % 5 = 0 then 'diferencia_detectada' else 'ok' end as s
  from hist t left join hist b on b.tipo = t.tipo and b.indice = t.indice and b.ord = t.ord - 24 where t.tipo in ('INPC', 'INFLACION COMPONENTE'))
select tipo, 'periodica_anual' as clase_variacion, 'ok' as estado_calculo, (min(ord) filter (computable))::int as desde, (max(ord) filter (computable))::int as hasta, count(*) filter (computable) as n_filas, count(*) filter (computable and s in ('ok', 'diferencia_detectada')) as n_comparables,
  count(*) filter (computable and s = 'ok') as n_ok, count(*) filter (computable and s = 'diferencia_detectada') as n_diferencia_detectada, 0::bigint as n_diferencia_por_parcial, count(*) filter (computable and s = 'no_disponible') as n_no_disponible,
  count(*) filter (computable and s = 'fuera_rango_inegi') as n_fuera_rango_inegi, round(max(case when computable and s = 'diferencia_detectada' then 0.5 when computable and s = 'ok' then 0.0 end), 6) as error_maximo, count(*) filter (s <> 'ok') as n_diagnostico,
  case when bool_or(computable and s = 'diferencia_detectada') then 'diferencia_detectada' when not bool_or(computable and s = 'ok') then 'no_disponible' else 'ok' end as estado_global
from v group by 1"""


@_query(_BASE + _VALIDATED)
def val_verbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of validated variations: rows without a base are in the report alone."""
    h = _verb_history(spark, sf_dir).where("tipo in ('INPC', 'INFLACION COMPONENTE')")
    found = api.validar(Result(api.variacion_periodica(h, "anual"), "variacion"), lambda: _Published(h))
    return _rounded(found.resumen, "error_maximo")
