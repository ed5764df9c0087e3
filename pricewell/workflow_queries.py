"""Further registered queries: contributions asked for, validation, charts, extracts, printed lines, files, official figures and renames, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_queries as Q
from . import renames
from .functions import periods, text
from .operators import charts, consult, extracts, incidence, laspeyres, lines, validate, variation
from .scratch import shared_dir, written
from .sources import baskets, series
from .sources.official import Archive

_query, _sql, _rounded = Q._query, Q._sql, Q._rounded
_ANNUAL_INC = Q._incidence_rows(Q._lagged("t.ord - 24"), "periodica_anual")


def _annual_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q._incidence(spark, sf_dir, incidence.periodic, "anual", "Q").where("computable")


@_query(_ANNUAL_INC + "select tipo, indice, round(v, 6) as incidencia_pp from inc where ord = 48000 and v is not null")
def incidencia_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(consult.at(_annual_incidence(spark, sf_dir), "incidencia_pp", 48000), "incidencia_pp")


@_query(_ANNUAL_INC + "select tipo, indice, round(sum(v), 6) as acumulada from inc where v is not null and ord between 47950 and 48000 group by 1, 2")
def incidencia_acumulada(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(consult.total(_annual_incidence(spark, sf_dir), "incidencia_pp", 47950, 48000), "acumulada")


@_query(_ANNUAL_INC + "select tipo, indice, round(avg(v), 6) as promedio from inc where v is not null group by 1, 2")
def incidencia_promedio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(consult.mean(_annual_incidence(spark, sf_dir), "incidencia_pp"), "promedio")


@_query(_ANNUAL_INC + Q._extreme_sql("inc", "incidencia_pp", "desc"))
def mayor_incidencia(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(Q._by_class(_annual_incidence(spark, sf_dir), lambda rows: consult.extreme(rows, "incidencia_pp", True)), "incidencia_pp")


@_query(_ANNUAL_INC + Q._extreme_sql("inc", "incidencia_pp", ""))
def menor_incidencia(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(Q._by_class(_annual_incidence(spark, sf_dir), lambda rows: consult.extreme(rows, "incidencia_pp", False)), "incidencia_pp")


#: Every period that the order lines have.
_PERIODS = [(o, periods.text_of(o, "Q")) for o in range(47880, 48045)]


@_query(_sql("select tipo, indice, " + ", ".join(f'round(max(case when ord = {o} then i end), 6) as "{t}"' for o, t in _PERIODS) + " from hist0 group by 1, 2"))
def ancho(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a category, a column a period."""
    return _rounded(consult.wide(Q._history(spark, sf_dir), ["indice_replicado"]), *(t for _, t in _PERIODS))


def _published(rows: DataFrame, value: str) -> DataFrame:
    """Figures with periods left out, gaps and differences."""
    off = F.when(F.col("ord") % 5 == 0, 0.5).otherwise(0.0)
    return rows.where("ord % 11 <> 4").select("tipo", "indice", "ord", F.when(F.col("ord") % 7 != 3, F.col(value) + off).alias("oficial"))


def _state(value: str) -> str:
    return f"""case when t.ord % 11 = 4 then 'fuera_rango_inegi' when t.ord % 7 = 3 or {value} is null then 'no_disponible' when t.ord % 5 <> 0 then 'ok' when t.estado = 'parcial' then 'diferencia_por_parcial' else 'diferencia_detectada' end"""


_ALL_ANNUAL = "(select t.tipo, t.ord, t.indice, t.estado, (t.i / b.i - 1) * 100 as v from hist0 t left join hist0 b on b.tipo = t.tipo and b.indice = t.indice and b.ord = t.ord - 24)"


def _variation_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = variation.periodic(Q._history(spark, sf_dir), "anual", "Q")
    return validate.compare(rows, _published(rows, "variacion_pp"), "variacion_pp", validate.POINT_TOLERANCE)


@_query(_sql(f"select tipo, ord, indice, {_state('v')} as estado_validacion from {_ALL_ANNUAL} t"))
def val_variacion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variation_compared(spark, sf_dir).select("tipo", "ord", "indice", "estado_validacion")


@_query(_sql(f"""select tipo, count(*) as n_filas, count(*) filter (s in ('ok', 'diferencia_detectada', 'diferencia_por_parcial')) as n_comparables, count(*) filter (s = 'ok') as n_ok,
  case when bool_or(s = 'diferencia_detectada') then 'diferencia_detectada' when bool_or(s = 'diferencia_por_parcial') then 'diferencia_por_parcial' when not bool_or(s = 'ok') then 'no_disponible' else 'ok' end as estado_global
from (select tipo, {_state('v')} as s from {_ALL_ANNUAL} t) group by 1"""))
def val_resumen_variacion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_filas has all rows of the report: a row is ok or in the diagnostics. Rows without a base are never comparable, so that the state rests on the others."""
    out = validate.derived_summary(_variation_compared(spark, sf_dir), "tipo")
    return out.select("tipo", (F.col("n_ok") + F.col("n_diagnostico")).alias("n_filas"), "n_comparables", "n_ok", "estado_global")


@_query(_sql(f"select tipo, ord, indice, s as estado_validacion from (select tipo, ord, indice, {_state('v')} as s from {_ALL_ANNUAL} t) where s <> 'ok'"))
def val_fallas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.failures(_variation_compared(spark, sf_dir)).select("tipo", "ord", "indice", "estado_validacion")


@_query(_ANNUAL_INC + f"select tipo, ord, indice, {_state('v')} as estado_validacion from inc t where v is not null")
def val_incidencia(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _annual_incidence(spark, sf_dir)
    return validate.compare(rows, _published(rows, "incidencia_pp"), "incidencia_pp", validate.POINT_TOLERANCE).select("tipo", "ord", "indice", "estado_validacion")


_BARS = "(select tipo, ord, indice, round(i - 100, 9) + 0.0 as v from hist0)"
_DETAILED = f"""
ranked as (select tipo, indice, m, row_number() over (partition by tipo order by m desc, indice) as r, coalesce(sum(m) over (partition by tipo order by m desc, indice rows unbounded preceding) / sum(m) over (partition by tipo) < 0.8, false) as below from (select tipo, indice, avg(abs(v)) as m from {_BARS} group by 1, 2)),
kept as (select tipo, indice from (select *, greatest(count(*) filter (below) over (partition by tipo) + 1, 8) as most from ranked) where r <= most)"""


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q._history(spark, sf_dir).select("tipo", "ord", "indice", (F.round(F.col("indice_replicado") - 100, 9) + 0.0).alias("valor"))


@_query(_sql("") + f""", {_DETAILED}
select b.tipo, ord, b.indice, round(v, 6) as valor from {_BARS} b join kept using (tipo, indice)
union all select b.tipo, ord, 'resto ' || case when v >= 0 then 'positivo' else 'negativo' end, round(sum(v), 6) from {_BARS} b anti join kept using (tipo, indice) where v is not null group by 1, 2, 3""")
def apilado_completo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacked bars of every classification."""
    return _rounded(Q._by_class(_bars(spark, sf_dir), lambda rows: charts.stacked(rows, "valor")), "valor")


@_query(_sql(f"select tipo, ord, round(sum(greatest(v, 0)), 6) as arriba, round(sum(least(v, 0)), 6) as abajo from {_BARS} group by 1, 2"))
def alturas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(Q._by_class(_bars(spark, sf_dir), lambda rows: charts.stack_ends(rows, "valor")), "arriba", "abajo")


@_query(_sql(f"select tipo, ord, indice, 'comparacion' as linea, round(v + 1, 6) as valor from {_BARS} where ord = (select max(ord) from hist0)"))
def puntos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many periods: only what stands alone in its line has a point, here a comparison with the last period."""
    rows = _bars(spark, sf_dir)
    last = rows.join(F.broadcast(rows.agg(F.max("ord").alias("ord"))), "ord").withColumn("valor", F.col("valor") + 1)
    return _rounded(Q._by_class(charts.combined(rows, last), lambda own: charts.points(own, "Q")).select("tipo", "ord", "indice", "linea", "valor"), "valor")


_PAIRS = """(select p_partkey::varchar as generico, '0' || p_size || ' ' || p_type as x, case when p_partkey % 4 = 0 then p_type || '!' else p_type end as p from part)"""


def _extracts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("generico", F.col("p_partkey").cast("string"))
    price, kind = F.format_string("%.2f", "p_retailprice"), F.col("p_type")
    one = part.select("generico", price.alias("ponderador"), F.concat(F.lit("0"), "p_size", F.lit(" "), kind).alias("clase"))
    other = F.when(F.col("p_partkey") % 2 == 0, price).otherwise(F.format_string("%.2f", F.col("p_retailprice") + 1))
    two = part.select("generico", other.alias("ponderador"), F.when(F.col("p_partkey") % 4 == 0, F.concat(kind, F.lit("!"))).otherwise(kind).alias("clase"))
    return one, two


@_query(f"""select 'clase' as columna, x, p, p as valor_final, case when regexp_replace(x, '^[0-9.]+\\s+', '') = p then 'igual' else 'preferido' end as metodo, count(*) as n from {_PAIRS} group by x, p""")
def match_categorias(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extracts.match_categories(*_extracts(spark, sf_dir), "clase")
    return out.select("columna", "x", "p", "valor_final", "metodo", F.size("genericos").cast("long").alias("n"))


@_query(f"select metodo, valor_final, count(*) as n from (select p as valor_final, case when regexp_replace(x, '^[0-9.]+\\s+', '') = p then 'igual' else 'preferido' end as metodo from {_PAIRS}) group by 1, 2")
def metodos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracts.method_counts(extracts.match_categories(*_extracts(spark, sf_dir), "clase")).select("metodo", "valor_final", "n")


@_query(f"select generico, regexp_extract(x, '^([0-9.]+)\\s', 1) || ' ' || p as etiqueta from {_PAIRS}")
def etiqueta_hibrida(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of one side with the name of the other."""
    one, two = _extracts(spark, sf_dir)
    both = one.select("generico", F.col("clase").alias("p")).join(two.select("generico", F.col("clase").alias("x")), "generico")
    return both.select("generico", extracts.hybrid_label().alias("etiqueta"))


@_query(f"select x as valor_final, 'directo' as metodo, count(*) as n from {_PAIRS} group by 1")
def valores_directos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracts.single_source(_extracts(spark, sf_dir)[0], "clase").select("valor_final", "metodo", F.size("genericos").cast("long").alias("n"))


@_query(f"select p as categoria, count(*) as n from {_PAIRS} group by 1")
def resumen_clases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracts.class_summary(_extracts(spark, sf_dir)[1], "clase").withColumnRenamed("count", "n")


@_query(f"select a.generico, printf('%.2f', p_retailprice) as ponderador, a.p as clase from {_PAIRS} a join part on generico = p_partkey::varchar")
def clases_llevadas(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = _extracts(spark, sf_dir)
    return extracts.carried(one, two, ["clase"])


@_query(f"""select generico, columna, valor_final, metodo from (
  select generico, 'ponderador' as columna, case when p_partkey % 2 = 0 then printf('%.2f', p_retailprice) else printf('%.2f', p_retailprice + 1) end as valor_final, case when p_partkey % 2 = 0 then 'igual' else 'preferido' end as metodo from {_PAIRS} join part on generico = p_partkey::varchar
  union all select generico, 'clase', p, case when regexp_replace(x, '^[0-9.]+\\s+', '') = p then 'igual' else 'preferido' end from {_PAIRS})""")
def auditoria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole match of two extracts, item by item."""
    return extracts.audit(extracts.match_all(*_extracts(spark, sf_dir), by_row=["ponderador"], by_pair=["clase"])).select("generico", "columna", "valor_final", "metodo")


_LINES = """(select p_size as documento, p_partkey as linea, case when p_partkey % 7 = 0 then '0' || p_size || ' ' || p_name when p_partkey % 3 = 0 then p_name || ' ' || printf('%.2f', p_retailprice) else p_name end as texto from part)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed lines of made-up tables: headings with a code, rows that end with a number, and parts of rows."""
    key, name = F.col("p_partkey"), F.col("p_name")
    line = F.when(key % 7 == 0, F.concat(F.lit("0"), "p_size", F.lit(" "), name)).when(key % 3 == 0, F.concat(name, F.lit(" "), F.format_string("%.2f", "p_retailprice"))).otherwise(name)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").alias("documento"), key.alias("linea"), line.alias("texto"))


@_query(f"select documento, linea, texto, last_value(case when regexp_matches(texto, '^0[0-9]+ ') then texto end ignore nulls) over (partition by documento order by linea rows unbounded preceding) as grupo from {_LINES}")
def lineas_grupo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.carried(_lines(spark, sf_dir), F.when(F.col("texto").rlike(r"^0\d+ "), F.col("texto")))


@_query(f"""select documento, min(linea) as linea, trim(string_agg(nullif(trim(t), ''), ' ' order by linea)) as texto, max(n)::double as valor from (
  select *, coalesce(sum((n is not null)::int) over (partition by documento order by linea rows between unbounded preceding and 1 preceding), 0) as r
  from (select documento, linea, regexp_replace(texto, ' [0-9]+[.][0-9]+$', '') as t, nullif(regexp_extract(texto, ' ([0-9]+[.][0-9]+)$', 1), '') as n from {_LINES})) group by documento, r""")
def lineas_numero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.rows_by_number(_lines(spark, sf_dir))


@_query(f"""select documento, linea, case when despues is not null and not regexp_matches(despues, '^0[0-9]+ ') then texto || ' ' || despues else texto end as texto
from (select *, lead(texto) over (partition by documento order by linea) as despues from {_LINES}) where regexp_matches(texto, '^0[0-9]+ ')""")
def lineas_seguidas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.with_continuation(_lines(spark, sf_dir))


@_query(f"""with n as (
  select documento, min(linea) as linea, trim(string_agg(nullif(trim(t), ''), ' ' order by linea)) as texto, max(n)::double as valor from (
    select *, coalesce(sum((n is not null)::int) over (partition by documento order by linea rows between unbounded preceding and 1 preceding), 0) as r
    from (select documento, linea, regexp_replace(texto, ' [0-9]+[.][0-9]+$', '') as t, nullif(regexp_extract(texto, ' ([0-9]+[.][0-9]+)$', 1), '') as n from {_LINES})) group by documento, r)
select 'scian' as anexo, l.documento || '/' || l.linea as generico, n.texto, valor from {_LINES} l left join n using (documento, linea)""")
def anexo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An annex's rows joined to the lines at which they begin; other lines keep nulls."""
    key = F.concat(F.col("documento").cast("string"), F.lit("/"), F.col("linea").cast("string")).alias("generico")
    rows = lines.rows_by_number(_lines(spark, sf_dir)).select(key, "texto", "valor")
    return lines.with_annex(_lines(spark, sf_dir).select(F.lit("scian").alias("anexo"), key), rows)


def _basket_file(spark: SparkSession, sf_dir: str) -> str:
    """A basket as CSV in the shared folder: one item a part name."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_name").alias("generico")).agg(F.min("p_type").alias("t"), F.count("*").alias("n"))
    kinds = {c: "t" for c in baskets.FILE_COLUMNS[3:]}
    rows = part.select("generico", (F.col("n") / 4).cast("string").alias("ponderador"), F.lit(None).cast("string").alias("encadenamiento"), *(F.col(t).alias(c) for c, t in kinds.items()))
    path = f"{shared_dir(spark)}/basket-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    baskets.write_basket(rows, path)
    return path


@_query("""select 2018 as version, lower(regexp_replace(p_name, '[^a-zA-Z0-9_ ]', '', 'g')) as generico, count(*) / 4.0 as ponderador, min(p_type) as cog from part group by p_name""")
def leer_canasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = baskets.read_basket(spark, _basket_file(spark, sf_dir), 2018)
    return out.select("version", "generico", "ponderador", F.col("COG").alias("cog"))


@_query("""select version, tipo, n as genericos, case when tipo = 'INPC' then 1 else k end as categorias from (select 2018 as version, count(distinct p_name) as n from part) x,
  (select count(distinct t) as k from (select min(p_type) as t from part group by p_name)) y, (select unnest(['INPC', 'COG', 'INFLACION COMPONENTE', 'INFLACION SUBCOMPONENTE', 'INFLACION AGRUPACION', 'CANASTA BASICA', 'CCIF DIVISION', 'CCIF GRUPO', 'CCIF CLASE', 'SCIAN SECTOR', 'SCIAN RAMA', 'DURABILIDAD', 'CANASTA CONSUMO MINIMO']) as tipo) z""")
def resumen_canasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baskets.summary(baskets.read_basket(spark, _basket_file(spark, sf_dir), 2018))


@_query("""select 2018 as version, 'parte ' || p_partkey as generico, (48400 + k)::int as ord, case when (p_partkey + k) % 5 = 0 then null else p_size + k end::double as valor from part, (select unnest(range(0, 4)) as k)""")
def leer_serie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series files with titles by rows, five lines above each header, gaps as empty cells."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    cell = lambda k: F.when((F.col("p_partkey") + k) % 5 == 0, F.lit("")).otherwise((F.col("p_size") + k).cast("string"))
    body = part.select(F.concat_ws(",", F.concat(F.lit('"001 parte '), "p_partkey", F.lit('"')), *(cell(k) for k in range(4))).alias("value"))
    path = f"{shared_dir(spark)}/series-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    series.write_series(body, ",".join(["Título", *(periods.text_of(48400 + k, "Q") for k in range(4))]), path)
    return series.read_series(spark, f"{path}/*.txt", 2018)


@_query("""select p_partkey, regexp_extract(x, '^([0-9.]+)\\s', 1) as codigo, regexp_replace(x, '^[0-9.]+\\s+', '') as nombre, regexp_replace(x, '^[0-9]+\\s+', '') as sin_numero, length(split_part(y, '.', 2)) as decimales, round(p_retailprice, 1) = z::double as iguales, y as preciso
from (select *, p_size || ' ' || p_type as x, printf('%.2f', p_retailprice) as y, printf('%.1f', p_retailprice) as z from part)""")
def funciones_texto(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    x, y, z = F.concat_ws(" ", "p_size", "p_type"), F.format_string("%.2f", "p_retailprice"), F.format_string("%.1f", "p_retailprice")
    return part.select(
        "p_partkey", text.code_of(x).alias("codigo"), text.name_after_code(x).alias("nombre"), text.without_number(x).alias("sin_numero"), text.decimals(y).cast("long").alias("decimales"),
        text.equal_when_rounded(y, z).alias("iguales"), text.more_precise(z, y).alias("preciso"),
    )


@_query("""select distinct (year(o_orderdate) * 24 + (month(o_orderdate) - 1) * 2 + case when day(o_orderdate) > 15 then 1 else 0 end)::int as quincena, (year(o_orderdate) * 24 + (month(o_orderdate) - 1) * 2 + case when day(o_orderdate) > 15 then 1 else 0 end)::int as leida,
  (year(o_orderdate) * 12 + month(o_orderdate) - 1)::int as mes from orders""")
def periodos_leidos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half months of dates, written as texts and read back; and their months."""
    own = spark.read.parquet(f"{sf_dir}/orders.parquet").select(periods.half_of_date(F.col("o_orderdate")).cast("int").alias("quincena")).distinct()
    label = periods.text_column(F.col("quincena"), F.lit("Q"))
    month = F.regexp_replace(label, r"^\dQ ", "")
    return own.select("quincena", periods.parse_column(label, "Q").cast("int").alias("leida"), periods.parse_column(month, "M").cast("int").alias("mes"))


@_query(_sql("") + """, seen as (select * from hist0 where i is not null), spine as (select tipo, indice, unnest(range(min(ord), max(ord) + 1))::int as ord from seen group by 1, 2)
select p.tipo, p.indice, p.ord, round(i, 6) as oficial from spine p left join seen using (tipo, indice, ord)""")
def oficial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures as an official source answers them, kept as files of JSON, an answer an indicator, and read by Spark: every period from the first to the last."""
    rows = Q._history(spark, sf_dir).where("indice_replicado is not null")
    o = F.col("ord")
    period = F.format_string("%d/%02d/%02d", F.floor(o / 24), F.floor(o % 24 / 2) + 1, o % 2 + 1)
    seen = F.array_sort(F.collect_list(F.struct(period.alias("TIME_PERIOD"), F.col("indice_replicado").cast("string").alias("OBS_VALUE"))))
    body = F.to_json(F.struct(F.array(F.struct(seen.alias("OBSERVATIONS"))).alias("Series")))
    answers = rows.groupBy("tipo", "indice").agg(body.alias("body")).withColumn("indicador", F.xxhash64("tipo", "indice").cast("string"))
    path = f"{shared_dir(spark)}/answers-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    answers.select("indicador", "body").write.mode("overwrite").json(path)
    kept = spark.read.schema("indicador string, body string").json(path)
    catalogue = answers.select(F.lit("Q").alias("periodicidad"), F.lit("indice").alias("medida"), "tipo", "indice", "indicador")
    return _rounded(Archive(kept, catalogue).history("Q", "indice").select("tipo", "indice", F.col("ord").cast("int").alias("ord"), "oficial"), "oficial")


def _steps_sql() -> str:
    """Names and codes of every version's categories in 2024 and 2010, by chained left joins of the tables."""
    quote = lambda x: "'" + x.replace("'", "''") + "'" if x is not None else "null"
    names = ", ".join(f"({quote(k)}, {v}, {quote(a)}, {quote(b)})" for k, v, a, b in renames.NAMES)
    codes = ", ".join(f"({quote(k)}, {v}, {quote(a)}, {quote(old)}, {quote(now)})" for k, v, a, old, now in renames.CODES)
    return f"""
with n(tipo, v, a, b) as (values {names}),
c(tipo, v, a, old, new) as (values {codes}),
step as (select coalesce(n.tipo, c.tipo) as tipo, coalesce(n.v, c.v) as v, coalesce(n.a, c.a) as a, coalesce(n.b, c.a) as b, c.new as code, c.old as back from n full join c on c.tipo = n.tipo and c.v = n.v and c.a = n.a),
own as (select tipo, v as version, a as nombre from step union select tipo, case v when 2013 then 2018 else 2024 end, b from step),
up1 as (select o.*, coalesce(s.b, o.nombre) as x, s.code as k from own o left join step s on o.version <= 2013 and s.v = 2013 and s.tipo = o.tipo and s.a = o.nombre),
up as (select u.tipo, u.version, u.nombre, coalesce(s.b, u.x) as nuevo, coalesce(s.code, u.k) as code from up1 u left join step s on u.version <= 2018 and s.v = 2018 and s.tipo = u.tipo and s.a = u.x),
down1 as (select o.*, coalesce(s.a, o.nombre) as x, s.back as k from own o left join step s on o.version = 2024 and s.v = 2018 and s.tipo = o.tipo and s.b = o.nombre),
down as (select u.tipo, u.version, u.nombre, coalesce(s.a, u.x) as nuevo, coalesce(s.back, u.k) as code from down1 u left join step s on u.version >= 2018 and s.v = 2013 and s.tipo = u.tipo and s.b = u.x)
select 2024 as hasta, tipo, version, nombre, case when tipo in ('CCIF DIVISION', 'CCIF GRUPO', 'CCIF CLASE') then coalesce(code, '99') || ' ' || nuevo else nuevo end as nuevo from up
union all select 2010, tipo, version, nombre, case when tipo in ('CCIF DIVISION', 'CCIF GRUPO', 'CCIF CLASE') then coalesce(code, '99') || ' ' || nuevo else nuevo end from down"""


@_query(_steps_sql())
def renombres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every category that a table renames, under the code 99 where it has one, as versions 2024 and 2010 name it."""
    s = renames.steps(spark)
    own = s.select("tipo", F.col("desde").alias("version"), "nombre").where("version = 2013 or version = 2018 or version = 2024").distinct()
    coded = F.col("tipo").isin(*renames.CODED)
    rows = own.withColumn("nuevo", F.when(coded, F.concat(F.lit("99 "), "nombre")).otherwise(F.col("nombre")))
    out = [renames.to_version(rows, v, "nuevo").select(F.lit(v).alias("hasta"), "tipo", "version", "nombre", "nuevo") for v in (2024, 2010)]
    return out[0].unionByName(out[1])


@_query(_sql("select version, generico, ord from grid where valor is null"))
def sin_precio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the baskets that the series lack."""
    x = Q._inputs(spark, sf_dir)
    return laspeyres.grid(laspeyres.trim(x.series, x.ranges), x.basket).where("valor is null").select("version", "generico", "ord")
