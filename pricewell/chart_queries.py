"""Registered queries of axes, legends and marks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from . import catalog_queries as Q
from .functions.periods import text_of
from .operators import axes, variation
from .results import Result

_query, _sql, _rounded = Q._query, Q._sql, Q._rounded


@_query(_sql("""select tipo, ord from (select tipo, ord, r, c, (n - 1) / (c - 1.0) as s from (select *, least(n, 20) as c from (select tipo, ord, row_number() over (partition by tipo order by ord) - 1 as r, count(*) over (partition by tipo) as n from (select distinct tipo, ord from hist0))))
  where r in (select distinct round_even(i * s, 0) from (select unnest(range(20)) as i) where i < c)"""))
def etiquetas_periodo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty of the periods of each classification."""
    return axes.period_labels(Q._history(spark, sf_dir), "tipo")


_BREAKS = """,
ends as (select tipo, min(i)::double as a, max(i)::double as z from hist0 where i is not null group by 1),
qs(q, t) as (values (1.0::double, 1), (5.0::double, 2), (2.0::double, 3), (2.5::double, 4), (4.0::double, 5), (3.0::double, 6)),
c1 as (select e.*, q, t, j, k, ceil(log10((z - a) * (1.0::double / (k + 1)) / (j * q)))::int as p0 from ends e, qs, (select unnest(range(1, 5)) as j), (select unnest(range(2, 25)) as k) where z > a),
c2 as (select *, j * q * pow(10.0::double, p0) as s0 from c1),
c3 as (select *, p0 + more as p, j * q * pow(10.0::double, p0 + more) as step from c2, (select unnest([0, 1]) as more) where floor(z / s0) * j - (k - 1) * j <= ceil(a / s0) * j),
c4 as (select *, unnest(range((floor(z / step) * j - (k - 1) * j)::bigint, (ceil(a / step) * j)::bigint + 1)) as start from c3),
c5 as (select *, start * (step / j) as lo, start * (step / j) + step * (k - 1) as hi from c4),
c6 as (
  select *, 0.25 * ((6 - t) / 5.0::double + case when (lo - floor(lo / step) * step < 1e-10 or step - (lo - floor(lo / step) * step) < 1e-10) and lo <= 0 and hi >= 0 then 1 else 0 end - j) + 0.2 * (1 - 0.5 * (pow(z - hi, 2) + pow(a - lo, 2)) / pow(0.1 * (z - a), 2))
    + 0.5 * (2 - greatest(((k - 1) / (hi - lo)) / (9 / (greatest(hi, z) - least(lo, a))), (9 / (greatest(hi, z) - least(lo, a))) / ((k - 1) / (hi - lo)))) + 0.05 as score
  from c5),
best as (select * from c6 qualify row_number() over (partition by tipo order by round(score, 12) desc, j, t, k, p, start) = 1),
cuts as (select tipo, unnest(range(k)) * step + lo as b from best union all select tipo, 100.0 from ends where z > a)
select tipo, round(b, 6) as corte from cuts join ends using (tipo) where b > a + (z - a) * 0.035 and b < z - (z - a) * 0.035 union select tipo, round(a, 6) from ends union select tipo, round(z, 6) from ends"""


@_query(_sql("") + _BREAKS)
def cortes_valor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks of the value axis of each classification's indices, the base of 100 among them."""
    return _rounded(axes.value_breaks(Q._history(spark, sf_dir), "indice_replicado", 100.0, "tipo"), "corte")


_SERIES = "(select distinct p_size as panel, case when p_partkey % 50 = 0 then 'INPC' when p_partkey % 50 = 1 then '__resto_cola__' else p_name || ' de la marca con numero ' || p_brand end as indice from part)"


@_query(f"""with s as (select *, sum((indice not in ('INPC', '__resto_cola__'))::int) over (partition by panel order by indice) - 1 as turn, case when indice = '__resto_cola__' then 'resto (sin detallar)' when length(indice) > 34 then substr(indice, 1, 31) || '...' else indice end as cut from {_SERIES}),
n as (select *, count(*) over (partition by panel, cut) as many, row_number() over (partition by panel, cut order by indice) as place from s)
select panel, indice, case indice when 'INPC' then 'black' when '__resto_cola__' then '#7a7a7a' else ['#2a78d6', '#eb6834', '#1baf7a', '#eda100', '#e87ba4', '#008300', '#4a3aa7', '#e34948'][(turn % 8 + 1)::bigint] end as color,
  case when many > 1 then left(cut, 34 - length(' (' || place || ')')) || ' (' || place || ')' else cut end as etiqueta from n""")
def leyenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours and distinct short labels of long names."""
    key = F.col("p_partkey") % 50
    name = F.when(key == 0, "INPC").when(key == 1, "__resto_cola__").otherwise(F.concat("p_name", F.lit(" de la marca con numero "), "p_brand"))
    return axes.legend(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").alias("panel"), name.alias("indice")), "panel", distinct=True)


@_query(_sql("""select tipo, indice, extremo, ord, round(i, 6) as indice_replicado from (
  select tipo, any_value(indice) as indice, 'primero' as extremo, min(ord) as ord, arg_min(i, ord) as i from hist0 group by tipo having count(distinct indice) = 1 union all
  select tipo, any_value(indice), 'ultimo', max(ord), arg_max(i, ord) from hist0 group by tipo having count(distinct indice) = 1)"""))
def extremos_marcados(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last value of the one chart that has a single line."""
    return _rounded(axes.ends_to_mark(Q._history(spark, sf_dir), "indice_replicado", "tipo"), "indice_replicado")


@_query(f"""select panel, case when n <> (select count(distinct indice) from {_SERIES} where indice <> '__resto_cola__') then n || ' de ' || (select count(distinct indice) from {_SERIES} where indice <> '__resto_cola__') || ' categorías detalladas' end as cobertura,
  'Imagen ' || row_number() over (order by panel) || ' de ' || count(*) over () as numeracion from (select panel, count(distinct case when indice <> '__resto_cola__' then indice end) as n from {_SERIES} group by 1)""")
def pies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands below the panels of a stacked chart."""
    rows = leyenda(spark, sf_dir).select("panel", "indice")
    return axes.captions(rows, rows.where("indice <> '__resto_cola__'").agg(F.countDistinct("indice").alias("categorias")), "panel")


_CHART = """, v as (select t.indice, t.ord, (t.i / b.i - 1) * 100 as v from hist0 t join hist0 b on b.tipo = t.tipo and b.indice = t.indice and b.ord = t.ord - 24 where t.tipo in ('ADJETIVO', 'INPC') and t.ord between 47990 and 48020),
names as (select indice, row_number() over (order by indice) - 1 as r, count(*) over () as n from (select distinct indice from v where indice <> 'INPC')),
ks as (select *, ceil(n / 8.0)::int as k, n // ceil(n / 8.0)::int as q, n % ceil(n / 8.0)::int as more from names),
panels as (select indice, (case when r < more * (q + 1) then r // (q + 1) else more + (r - more * (q + 1)) // q end)::int as panel from ks),
every as (select * from panels union all select 'INPC', panel from (select distinct panel from panels))"""


def _chart(spark: SparkSession, sf_dir: str) -> api.Grafica:
    """Annual variations of one classification with the headline, for a range of periods."""
    rows = variation.periodic(Q._history(spark, sf_dir).where("tipo in ('ADJETIVO', 'INPC')"), "anual", "Q")
    return api.preparar_grafica(Result(rows, "variacion"), desde=text_of(47990, "Q"), hasta=text_of(48020, "Q"))


@_query(_sql("") + _CHART + " select panel, ord, indice, round(v, 6) as variacion_pp, case when indice = 'INPC' then 2 else 1 end as turno from v join every using (indice)")
def grafica_filas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to draw: panels of eight categories, the headline in each."""
    return _rounded(_chart(spark, sf_dir).filas.select("panel", "ord", "indice", "variacion_pp", "turno"), "variacion_pp")


@_query(_sql("") + _CHART + """ select panel, indice, case when indice = 'INPC' then 'black' else ['#2a78d6', '#eb6834', '#1baf7a', '#eda100', '#e87ba4', '#008300', '#4a3aa7', '#e34948'][((row_number() over (partition by panel, indice = 'INPC' order by indice) - 1) % 8 + 1)::bigint] end as color, indice as etiqueta from every""")
def grafica_leyenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chart(spark, sf_dir).leyenda
