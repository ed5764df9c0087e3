"""Registered queries through readers, loaders, results and official sources, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from . import catalog_queries as Q
from . import workflow_queries as X
from .functions import periods
from .operators import charts, incidence, validate, variation
from .results import Result
from .scratch import shared_dir
from .sources import baskets, series, tables
from .sources.official import Archive
from .verb_queries import _BASE as _VERBS
from .verb_queries import _verb_history

_query, _sql, _rounded = Q._query, Q._sql, Q._rounded
FIRST = 48460


def _path(spark: SparkSession, sf_dir: str, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item a part name, with a few values: as many as a file has columns."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_name").alias("nombre")).agg(F.count("*").alias("n"))


_ITEM_SERIES = f"select 2018 as version, {{name}} as generico, ({FIRST} + k)::int as ord, case when (n + k) % 4 = 0 then null else (n + k)::double end as valor from (select p_name, count(*) as n from part group by 1), (select unnest(range(5)) as k)"


def _cell(k: int) -> Column:
    return F.when((F.col("n") + k) % 4 == 0, F.lit("")).otherwise((F.col("n") + k).cast("string"))


@_query(_ITEM_SERIES.format(name="'niño ' || p_name"))
def leer_serie_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by columns, periods by rows, in Latin-1."""
    names = [(r.nombre, r.n) for r in _items(spark, sf_dir).orderBy("nombre").collect()]  # the file's columns
    head = [["x"] * (len(names) + 1)] * 5 + [["Título", *(f"{i:03d} Niño {n}" for i, (n, _) in enumerate(names))]]
    body = [[periods.text_of(FIRST + k, "Q"), *("" if (n + k) % 4 == 0 else str(n + k) for _, n in names)] for k in range(5)]
    columns = [f"c{i}" for i in range(len(names) + 1)]
    rows = spark.createDataFrame([(i, *line) for i, line in enumerate([*head, *body])], ", ".join(["i int", *(f"{c} string" for c in columns)]))
    path = _path(spark, sf_dir, "series-down")
    rows.coalesce(1).sortWithinPartitions("i").select(*columns).write.mode("overwrite").csv(path, encoding="ISO-8859-1", emptyValue="")
    return series.read_series(spark, f"{path}/*.csv", 2018)


@_query(_ITEM_SERIES.format(name="p_name"))
def leer_serie_jerarquia(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without codes, each after its parents': the leaves are the items."""
    items = _items(spark, sf_dir)
    first = F.split_part("nombre", F.lit(" "), F.lit(1))
    parents = items.select(F.concat(F.lit("Quincenal INPC, grupo "), first).alias("t")).distinct().unionByName(spark.createDataFrame([("Quincenal INPC",)], "t string"))
    line = lambda title, *cells: F.concat_ws(",", F.concat(F.lit('"'), title, F.lit('"')), *cells).alias("value")
    leaves = items.select(line(F.concat(F.lit("Quincenal INPC, grupo "), first, F.lit(", "), "nombre"), *(_cell(k) for k in range(5))))
    above = parents.select(line(F.col("t"), *(F.lit("1") for _ in range(5))))
    header = ",".join(["Título", *(periods.text_of(FIRST + k, "Q") for k in range(5))])
    top = spark.createDataFrame([(i, x) for i, x in enumerate(["a", "b", "c", "d", "e", header])], "i int, value string")
    path = _path(spark, sf_dir, "series-tree")
    rows = top.unionByName(above.withColumn("i", F.lit(7))).unionByName(leaves.withColumn("i", F.lit(9)))
    rows.coalesce(1).sortWithinPartitions("i", "value").select("value").write.mode("overwrite").text(path)
    return series.read_series(spark, f"{path}/*.txt", 2018)


@_query("""select 2018 as version, p_name as generico, round(n * 100.0 / t, 6) as ponderador, tipo from (select p_name, count(*) as n, min(p_type) as tipo from part group by 1), (select count(*) as t from part)""")
def cargar_canasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A basket file through the loader, which checks keys, weights and classes."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = part.groupBy(F.col("p_name").alias("generico")).agg(F.count("*").alias("n"), F.min("p_type").alias("t")).join(part.agg(F.count("*").alias("all")), F.lit(True))
    rows = rows.select("generico", (F.col("n") * 100 / F.col("all")).cast("string").alias("ponderador"), F.lit(None).cast("string").alias("encadenamiento"), *(F.col("t").alias(c) for c in baskets.FILE_COLUMNS[3:]))
    path = _path(spark, sf_dir, "basket-whole")
    baskets.write_basket(rows, path)
    return _rounded(api.cargar_canasta(spark, path, 2018).select("version", "generico", "ponderador", F.col("COG").alias("tipo")), "ponderador")


@_query("select 2018 as version, 'parte ' || p_partkey as generico, (48460 + k)::int as ord, case when (p_partkey + k) % 5 = 0 then null else p_size + k end::double as valor from part, (select unnest(range(0, 4)) as k)")
def cargar_serie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series files through the loader, which checks values, keys and that the periods meet the version's."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    cell = lambda k: F.when((F.col("p_partkey") + k) % 5 == 0, F.lit("")).otherwise((F.col("p_size") + k).cast("string"))
    body = part.select(F.concat_ws(",", F.concat(F.lit('"001 parte '), "p_partkey", F.lit('"')), *(cell(k) for k in range(4))).alias("value"))
    path = _path(spark, sf_dir, "series-loaded")
    series.write_series(body, ",".join(["Título", *(periods.text_of(FIRST + k, "Q") for k in range(4))]), path)
    return api.cargar_serie(spark, f"{path}/*.txt", 2018)


@_query("select p_partkey::varchar as clave, p_name as nombre, case when p_partkey % 3 = 0 then '' else p_size::varchar end as talla from part")
def leer_textos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV whose cells are all texts, empty ones too."""
    path = _path(spark, sf_dir, "texts")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    part.select(F.col("p_partkey").alias("clave"), F.col("p_name").alias("nombre"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("talla")).write.mode("overwrite").csv(path, header=True)
    return tables.text_table(spark, path)


@_query(_sql("select tipo, min(ord)::int as desde, max(ord)::int as hasta, count(*) as filas, round(min(v), 6) as minimo, round(max(v), 6) as maximo from (select t.tipo, t.ord, (t.i / b.i - 1) * 100 as v from hist0 t join hist0 b on b.tipo = t.tipo and b.indice = t.indice and b.ord = t.ord - 24) where v is not null group by 1"))
def resultado_variacion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result that keeps its rules, summed up."""
    return _rounded(Result(variation.periodic(Q._history(spark, sf_dir), "anual", "Q"), "variacion").check().resumen, "minimo", "maximo")


@_query(Q._incidence_rows(Q._lagged("t.ord - 24"), "periodica_anual") + "select tipo, min(ord)::int as desde, max(ord)::int as hasta, count(*) as filas, round(min(v), 6) as minimo, round(max(v), 6) as maximo from inc where v is not null group by 1")
def resultado_incidencia(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q._incidence(spark, sf_dir, incidence.periodic, "anual", "Q")
    return _rounded(Result(rows, "incidencia").check().resumen, "minimo", "maximo")


@_query(_sql("select ord, tipo, indice, round(i, 6) as indice_replicado from hist0 where version = 3"))
def resultado_indice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result whose manifest names the versions that must have rows; its rows in order."""
    h = Q._history(spark, sf_dir).where("version = 3")
    manifest = [{"version": r.version, "tipo": r.tipo} for r in h.select("version", "tipo").distinct().collect()]  # a row a classification
    return _rounded(Result(h, "indice", manifest).check().resultado.select("ord", "tipo", "indice", "indice_replicado"), "indice_replicado")


def _archive(spark: SparkSession, sf_dir: str) -> Archive:
    """Answers of an official source as files: indices and annual variations by half months, contributions by months."""
    def make() -> DataFrame:
        h = _verb_history(spark, sf_dir).where("tipo in ('INPC', 'INFLACION COMPONENTE')")
        annual = api.variacion_periodica(h, "anual").where("computable").select("tipo", "indice", "ord", F.col("variacion_pp").alias("v"))
        half = h.select(F.lit("indice").alias("medida"), "tipo", "indice", "ord", F.col("indice_replicado").alias("v")).unionByName(annual.withColumn("medida", F.lit("anual")))
        month = h.where("tipo <> 'INPC'").groupBy("tipo", "indice", F.floor(F.col("ord") / 2).cast("int").alias("ord")).agg(F.sum("indice_replicado").alias("v")).withColumn("medida", F.lit("incidencia"))
        o = F.col("ord")
        rows = half.withColumns({"p": F.lit("Q"), "t": F.format_string("%d/%02d/%02d", F.floor(o / 24), F.floor(o % 24 / 2) + 1, o % 2 + 1)}).unionByName(month.withColumns({"p": F.lit("M"), "t": F.format_string("%d/%02d", F.floor(o / 12), o % 12 + 1)}))
        seen = F.array_sort(F.collect_list(F.struct(F.col("t").alias("TIME_PERIOD"), F.col("v").cast("string").alias("OBS_VALUE"))))
        answers = rows.groupBy("p", "medida", "tipo", "indice").agg(F.to_json(F.struct(F.array(F.struct(seen.alias("OBSERVATIONS"))).alias("Series"))).alias("body"))
        path = _path(spark, sf_dir, "official")
        answers.withColumn("indicador", F.xxhash64("p", "medida", "tipo", "indice").cast("string")).withColumnRenamed("p", "periodicidad").write.mode("overwrite").json(path)
        return spark.read.schema("periodicidad string, medida string, tipo string, indice string, indicador string, body string").json(path)

    kept = Q._once(spark, sf_dir, "official answers", make)
    return Archive(kept.select("indicador", "body"), kept.drop("body"))


@_query(_VERBS + """ select ord, round(max(i) filter (indice = 'subyacente'), 6) as subyacente, round(max(i) filter (indice = 'no subyacente'), 6) as no_subyacente from hist where tipo = 'INFLACION COMPONENTE' group by 1""")
def consulta_indice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published indices: a row a period, a column a category."""
    out = api.consultar_indice(_archive(spark, sf_dir), "inflacion componente", "Q").withColumnRenamed("no subyacente", "no_subyacente")
    return _rounded(out.withColumn("ord", F.col("ord").cast("int")), "subyacente", "no_subyacente")


@_query(_VERBS + """ select t.ord, round((t.i / b.i - 1) * 100, 6) as "INPC" from hist t join hist b on b.tipo = t.tipo and b.ord = t.ord - 24 where t.tipo = 'INPC'""")
def consulta_variacion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(api.consultar_variacion(_archive(spark, sf_dir), "INPC", "anual", "Q").withColumn("ord", F.col("ord").cast("int")), "INPC")


@_query(_VERBS + """ select (ord // 2)::int as ord, round(sum(i) filter (indice = 'subyacente'), 6) as subyacente, round(sum(i) filter (indice = 'no subyacente'), 6) as no_subyacente from hist where tipo = 'INFLACION COMPONENTE' group by 1""")
def consulta_incidencia(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = api.consultar_incidencia(_archive(spark, sf_dir), "INFLACION COMPONENTE").withColumnRenamed("no subyacente", "no_subyacente")
    return _rounded(out.withColumn("ord", F.col("ord").cast("int")), "subyacente", "no_subyacente")


@_query(_VERBS + """ select tipo, ord, indice, case when i is null then 'no_disponible' else 'ok' end as estado_validacion from hist where tipo in ('INPC', 'INFLACION COMPONENTE')""")
def val_archivo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices against the source that they were published in."""
    h = _verb_history(spark, sf_dir).where("tipo in ('INPC', 'INFLACION COMPONENTE')")
    return api.validar(Result(h, "indice"), lambda: _archive(spark, sf_dir)).check().reporte.select("tipo", "ord", "indice", "estado_validacion")


@_query(_sql("""select tipo, ord, indice, coalesce(max(esperados) filter (q = 1), max(esperados) filter (q = 0)) as genericos_esperados, min(con_indice) as genericos_con_indice, max(esperados - con_indice) as genericos_sin_indice, round(min(con_indice * 100.0 / esperados), 6) as cobertura_genericos_pct,
  round(coalesce(max(w_esperado) filter (q = 1), max(w_esperado) filter (q = 0)), 6) as ponderador_esperado, round(min(w_cubierto), 6) as ponderador_cubierto from (select *, (ord // 2)::int as m, ord % 2 as q from hist0) h group by tipo, m, indice""").replace("select tipo, ord, indice, coalesce(max(esperados)", "select tipo, m as ord, indice, coalesce(max(esperados)"))
def cobertura_mensual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of months: the worse half counts, what the basket fixes comes from the second."""
    columns = ("genericos_esperados", "genericos_con_indice", "genericos_sin_indice", "cobertura_genericos_pct", "ponderador_esperado", "ponderador_cubierto")
    return _rounded(Q._months(spark, sf_dir).select("tipo", "ord", "indice", *columns), "cobertura_genericos_pct", "ponderador_esperado", "ponderador_cubierto")


@_query(Q._incidence_rows(Q._lagged("t.ord - 1", "months"), "periodica_mensual", "months") + f"select tipo, ord, indice, {X._state('v')} as estado_validacion from inc t where v is not null")
def val_incidencia_mensual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions by months, for which there are official figures."""
    months, h = Q._months(spark, sf_dir), Q._history(spark, sf_dir)
    x = Q._inputs(spark, sf_dir)
    rows = incidence.periodic(months, Q.demo.category_weights(x), x.ranges, Q.demo.steady(x), "mensual", "M", Q.convert.frontier(h, x.ranges)).where("computable")
    return validate.compare(rows, X._published(rows, "incidencia_pp"), "incidencia_pp", validate.POINT_TOLERANCE).select("tipo", "ord", "indice", "estado_validacion")


@_query(_sql("select tipo, ord, indice, case when indice like 'resto %' then 0 when indice = 'INPC' then 2 else 1 end as turno from hist0 where ord between 47900 and 47999"))
def orden_dibujo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a range asked for by text, with the turn in which each line is drawn."""
    rows = charts.clipped(Q._history(spark, sf_dir), periods.text_of(47900, "Q"), periods.text_of(47999, "Q"), "Q")
    return rows.select("tipo", "ord", "indice", charts.draw_order(F.col("indice")).alias("turno"))
