"""Guards, results, names of versions, official figures."""

import json

import pytest
from pyspark.sql import functions as F

import pricewell
from pricewell import api, catalog, catalog_queries, renames, results, workflow_queries
from pricewell.errors import ConfigurationProblem, InvariantBroken, PeriodUnavailable, PeriodUnreadable
from pricewell.operators import charts, consult, extracts, incidence
from pricewell.sources import indicators
from pricewell.sources.official import Official


def rows(spark, data, extra=""):
    return spark.createDataFrame(data, "tipo string, periodicidad string, ord int, indice string, version int, indice_replicado double, indice_incidencia double, estado_calculo string, motivo_error string" + extra)


def index(spark, *cells):
    return rows(spark, [(k, "Q", o, i, v, x, x, "ok", None) for k, o, i, v, x in cells])


def test_names_exported():
    assert {"calcular_historia", "validar", "InvariantBroken", "Result"} <= set(pricewell.__all__)
    assert pricewell.rebasar is api.rebasar
    with pytest.raises(AttributeError):
        pricewell.nothing_of_the_kind  # noqa: B018


def test_history_guards(spark):
    names = [c.upper() for c in catalog.CLASSES]
    basket = lambda *versions: spark.createDataFrame([(v, "pan", 100.0, None, *("x" for _ in names)) for v in versions], "version int, generico string, ponderador double, encadenamiento double, " + ", ".join(f"`{c}` string" for c in names))
    series = lambda *versions: spark.createDataFrame([(v, "pan", 1, 1.0) for v in versions], "version int, generico string, ord int, valor double")
    for versions, match in (((), "no basket"), ((2011,), "unknown"), ((2010, 2018), "contiguous"), ((2013,), "chained"), ((2010, 2010), "twice")):
        with pytest.raises(InvariantBroken, match=match):
            api.calcular_historia(basket(*versions), series(*versions))
    with pytest.raises(InvariantBroken, match="without series"):
        api.calcular_historia(basket(2010, 2013), series(2010))
    with pytest.raises(InvariantBroken, match="periodicity"):
        api.calcular_historia(basket(2010), series(2010), "Jul 2018")
    with pytest.raises(PeriodUnreadable):
        api.calcular_historia(basket(2010), series(2010), "sometime")


def test_categories_go_through_the_versions(spark):
    data = [
        (2013, "CCIF CLASE", "12.5.4 seguro relacionado con el transporte", "12.1.4 seguros relacionado con el transporte"),
        (2010, "CCIF GRUPO", "06.1 productos artefactos y equipo medicos", "06.1 medicamentos y productos sanitarios"),
        (2018, "CCIF DIVISION", "bienes y servicios diversos", "cuidado personal proteccion social y bienes diversos"),
        (2018, "CCIF DIVISION", "12 bienes y servicios diversos", "13 cuidado personal proteccion social y bienes diversos"),
        (2024, "CCIF GRUPO", "13.1 cuidado personal", "13.1 cuidado personal"),
        (2013, "SCIAN RAMA", "5241 instituciones de seguros y fianzas", "5241 compañias de seguros y fianzas"),
        (2013, "INFLACION AGRUPACION", "educacion", "educacion colegiaturas"),
        (2013, "COG", "01 never renamed", "01 never renamed"),
    ]
    own = spark.createDataFrame([(v, k, a, b) for v, k, a, b in data], "version int, tipo string, indice string, quiere string")
    assert all(r.indice == r.quiere for r in renames.to_version(own, 2024).collect())
    back = spark.createDataFrame([(2024, "CCIF GRUPO", "13.1 cuidado personal"), (2024, "CCIF DIVISION", "13 cuidado personal proteccion social y bienes diversos")], "version int, tipo string, indice string")
    assert {r.indice for r in renames.to_version(back, 2013).collect()} == {"12.1 cuidado personal", "12 bienes y servicios diversos"}
    items = spark.createDataFrame([(2013, "trajes"), (2018, "leche de soya"), (2024, "leche de soya"), (2013, "pan")], "version int, generico string")
    assert sorted(r.generico for r in renames.items_to_version(items, 2024).collect()) == ["leche de soya", "leches de origen vegetal", "pan", "traje para hombre"]
    with pytest.raises(ConfigurationProblem):
        renames.to_version(own, 2030)


def test_results_keep_their_rules(spark):
    good = index(spark, ("INPC", 1, "INPC", 2018, 100.0), ("INPC", 2, "INPC", 2018, 110.0))
    r = results.Result(good, "indice", [{"version": 2018, "tipo": "INPC"}]).check()
    assert r.resultado.count() == 2 and r.diagnostico.count() == 0 and r.resumen.first().filas == 2 and r.ancho.columns[2:] == ["2Q Ene 0", "1Q Feb 0"] and "INPC" in r._repr_html_()
    for bad, manifest in ((good.where("false"), []), (good.union(good), []), (good.withColumn("estado_calculo", F.lit("bien")), []), (good.drop("version"), []), (good, [{"version": 2024, "tipo": "INPC"}])):
        with pytest.raises(InvariantBroken):
            results.Result(bad, "indice", manifest).check()
    varied = api.variacion_periodica(good, "quincenal")
    v = results.Result(varied, "variacion").check()
    assert v.resultado.count() == 1 and v.reporte.count() == 2 and v.diagnostico.count() == 1 and v.resumen.first().maximo == pytest.approx(10)
    for bad in (varied.withColumn("clase_variacion", F.lit("diaria")), varied.withColumn("variacion_pp", F.lit(float("inf"))), varied.withColumn("estado_calculo", F.lit("rellenado"))):
        with pytest.raises(InvariantBroken):
            results.Result(bad, "variacion").check()
    with pytest.raises(InvariantBroken):
        results.Result(good, "otro")


def source(spark, values, key=("Q", "indice")):
    answers = {"1": json.dumps({"Series": [{"OBSERVATIONS": [{"TIME_PERIOD": p, "OBS_VALUE": x} for p, x in values]}]})}
    return Official(spark, answers.__getitem__, {key: {("INPC", "INPC"): "1"}})


def test_validation_checks_before_it_asks(spark):
    good = index(spark, ("INPC", 48000, "INPC", 2018, 100.0), ("INPC", 48001, "INPC", 2018, 110.0))
    def never():
        raise AssertionError("asked for the source")
    for bad in (results.Result(good.withColumn("tipo", F.lit("COG")), "indice"), results.Result(good.withColumn("ord", F.col("ord")).where("false"), "indice")):
        with pytest.raises((ConfigurationProblem, InvariantBroken)):
            api.validar(bad, never)
    with pytest.raises(InvariantBroken):
        api.validar(results.Result(api.variacion_periodica(good, "bimestral"), "variacion"), never)
    done = api.validar(results.Result(good, "indice"), lambda: source(spark, [("2000/01/01", "100.0005"), ("2000/01/02", "111")])).check()
    assert {r.ord: r.estado_validacion for r in done.rows.collect()} == {48000: "ok", 48001: "diferencia_detectada"}
    assert done.diagnostico.count() == 1 and done.resumen.first().estado_global == "diferencia_detectada"
    with pytest.raises(ConfigurationProblem):
        api.validar(done, never)


def test_official_tables(spark):
    assert api.consultar_indice(source(spark, [("2000/01/01", "5")]), "inpc", "Q").first().INPC == 5.0
    assert api.consultar_variacion(source(spark, [("2000/01", "2")], ("M", "anual")), clase="anual").first().INPC == 2.0
    assert api.consultar_incidencia(source(spark, [("2000/01", "3")], ("M", "incidencia"))).first().INPC == 3.0
    for call in (lambda: api.consultar_indice(source(spark, []), "COG"), lambda: api.consultar_variacion(source(spark, []), clase="diaria"), lambda: api.consultar_indice(source(spark, []), periodicidad="S")):
        with pytest.raises(ConfigurationProblem):
            call()
    whole = indicators.catalogue()
    assert len(whole) == 9 and all(len(x) == 7 for x in whole.values()) and len({i for x in whole.values() for i in x.values()}) == 63


def test_settings(monkeypatch):
    monkeypatch.delenv(api.TOKEN, raising=False)
    with pytest.raises(ConfigurationProblem):
        api.token()
    api.set_token(" abc ")
    assert api.token() == "abc" and api.mostrar_config()["token"] is True
    monkeypatch.setenv(api.TOKEN, "first")
    assert api.token() == "first"
    api.settings.timeout = 3.0
    api.reset_config()
    assert api.settings.timeout == 10.0 and api.settings.token is None


def test_ranges_are_checked(spark):
    own = index(spark, ("INPC", 48000, "INPC", 2018, 100.0), ("COG", 48001, "a", 2018, 110.0))
    consult.check_range(own, 48000, 48001)
    for args, error in (((47000, None), PeriodUnavailable), ((None, None, "b"), InvariantBroken), ((48001, 48001, "INPC"), InvariantBroken)):
        with pytest.raises(error):
            consult.check_range(own, *args)
    assert charts.clipped(own, "2Q Ene 2000", None, "Q").count() == 1
    with pytest.raises(InvariantBroken, match="periodicity"):
        charts.clipped(own, "Ene 1900", None, "Q")


def test_contributions_need_a_basket_for_each_version(spark):
    own = index(spark, ("INPC", 1, "INPC", 2018, 100.0), ("COG", 1, "a", 2018, 110.0))
    basket = spark.createDataFrame([(2018,)], "version int")
    incidence.check_inputs(own, basket)
    for bad, b in ((own.where("tipo = 'COG'"), basket), (own, basket.where("false")), (own.withColumn("periodicidad", F.col("tipo")), basket)):
        with pytest.raises(ConfigurationProblem):
            incidence.check_inputs(bad, b)
    with pytest.raises(InvariantBroken):
        incidence.check_inputs(own.withColumn("indice_replicado", F.lit(0.0)), basket)


def test_whole_match(spark):
    one = spark.createDataFrame([("x", "1.25", "01 Pan", "a"), ("y", "2.0", "02 Miel", "b")], "generico string, n string, clase string, solo string")
    two = spark.createDataFrame([("x", "1.2", "Pan"), ("y", "3.0", "Mieles")], "generico string, n string, clase string")
    answers = spark.createDataFrame([("clase", "02 Miel", "Mieles", "03 Mieles")], "columna string, x string, p string, valor_final string")
    got = {(r.generico, r.columna): (r.valor_final, r.metodo) for r in extracts.audit(extracts.match_all(one, two, ["n"], ["clase"], ["solo"], answers=answers)).collect()}
    assert got == {("x", "n"): ("1.25", "redondeo"), ("y", "n"): ("3.0", "preferido"), ("x", "clase"): ("Pan", "igual"), ("y", "clase"): ("03 Mieles", "respuesta"), ("x", "solo"): ("a", "directo"), ("y", "solo"): ("b", "directo")}


def test_classes_by_name(spark, tmp_path):
    from pricewell.sources.tables import text_table

    (tmp_path / "a.csv").write_text("generico,clase\n\"Azúcar, fina\",\nPan,1\n")
    (tmp_path / "b.csv").write_text("generico,clase\nazucar fina,7\npan,\n")
    one, two = (text_table(spark, str(tmp_path / f"{x}.csv")) for x in "ab")
    assert {tuple(r) for r in one.collect()} == {("Azúcar, fina", ""), ("Pan", "1")}
    assert {tuple(r) for r in extracts.carried_by_name(one, two, ["clase"]).collect()} == {("Azúcar, fina", "7"), ("Pan", "")}
    with pytest.raises(InvariantBroken):
        extracts.carried_by_name(one, two.where("clase = '7'"), ["clase"])


def test_every_query_has_sql():
    assert workflow_queries.renombres.__name__ in catalog_queries.queries()
    assert set(catalog_queries.queries()) == set(catalog_queries.oracle())


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = f"import sys; sys.path.insert(0, {str(root)!r}); import __spark_entry__ as e; assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, timeout=120).returncode == 0


@pytest.mark.parametrize(("halves", "comparable"), [(30, True), (12, False)])
def test_the_summary_of_variations_counts_the_whole_report(spark, tmp_path, halves, comparable):
    """Two items over a year and a quarter, of which the first year lacks a base, and over half a year, where nothing has one."""
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.sql("create table part as select * from (values (1, 'blue anvil'), (2, 'red anvil')) t(p_partkey, p_name)")
    day = "timestamp '1995-01-05' + to_months((h // 2)::int) + to_days((h % 2 * 15)::int)"
    db.sql(f"create table lineitem as select p_partkey as l_partkey, 2.0::double as l_quantity, (100 + p_partkey * h)::double as l_extendedprice, {day} as l_shipdate from part, range({halves}) r(h)")
    for name in ("part", "lineitem"):
        db.sql(f"copy {name} to '{tmp_path}/{name}.parquet' (format parquet)")
    query = lambda name: catalog_queries.queries()[name](spark, str(tmp_path))
    got = {r.tipo: r for r in query("val_resumen_variacion").collect()}
    assert {t: r.n_filas for t, r in got.items()} == {"INPC": halves, "SUSTANTIVO": halves, "ADJETIVO": 2 * halves, "RENOMBRE": halves}
    assert {t: r.n_filas for t, r in got.items()} == {r.tipo: r["count"] for r in query("val_variacion").groupBy("tipo").count().collect()}
    assert all((r.n_comparables > 0, r.estado_global == "no_disponible") == (comparable, not comparable) for r in got.values())
    assert sorted(tuple(r) for r in got.values()) == sorted(db.sql(catalog_queries.oracle()["val_resumen_variacion"]).fetchall())
