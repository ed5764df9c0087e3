"""Sheets walked over cells, two extracts resolved, audit documents, axes and legends on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from pricewell.errors import ConfigurationProblem, InvariantBroken, SourceUnavailable
from pricewell.operators import audit, axes
from pricewell.sources import sheets
from pricewell.sources.official import Archive


def cells(spark, *sheets_):
    rows = [("m", name, f, c, t, number) for name, lines in sheets_ for f, line in enumerate(lines) for c, (t, number) in line.items()]
    return spark.createDataFrame(rows, "documento string, hoja string, fila int, columna int, texto string, numerico boolean").repartition(3)


def item(name, weight, *more, column=1, at=2):
    return {column: (name, False), at: (weight, True)} | {c: (t, False) for c, t in more}


def test_groups_in_the_items_column(spark):
    book = [
        {1: ("Índice general", False), 2: ("100", True)}, {1: ("a title without a weight", False)}, item("1 Alimentos", "20.5"), item("001 Pan de caja", "1.50", (5, "X"), (19, "X")),
        item("002 Café", "0.25", (6, "x"), (14, "X"), (13, "X")), item("2 Ropa", "3"), item("003 Pantalón", "2.125", (17, "X"), (19, "x")), {1: ("004 Sin número", False), 2: ("n/d", False), 5: ("X", False)}, item("Total", "9"),
    ]
    ccif = [item("01 Comida", "1"), item("001 Pan de caja", "1.50", (5, "X")), item("02 Otra", "1"), item("001 Pan de caja", "1.50", (5, "X"))]
    out = sheets.basket_of(cells(spark, ("Objeto de gasto", book), ("CCIF", ccif)), 2018)
    got = {r.generico: (r.ponderador, r.COG, r["CCIF division"], r["inflacion componente"], r["inflacion agrupacion"], r["canasta basica"], r.encadenamiento, r["canasta consumo minimo"]) for r in out.collect()}
    assert got == {
        "pan de caja": ("1.50", "alimentos", "otra", "subyacente", "alimentos bebidas y tabaco", "X", "", ""),
        "cafe": ("0.25", "alimentos", "", "no subyacente", "frutas y verduras", "-", "", ""),
        "pantalon": ("2.125", "ropa", "", "no subyacente", "tarifas autorizadas por el gobierno", "-", "", ""),
    }
    with pytest.raises(ConfigurationProblem):
        sheets.basket_of(cells(spark), 2011)


def test_groups_in_a_column_of_their_own(spark):
    book = [item("Total", "9", column=1, at=3), item("Vivienda", "5", column=1, at=3), item("Renta", "4.75", (1, "a remark"), (4, "1.5"), (10, "X"), (20, "X"), column=2, at=3), item("Suma", "5", column=2, at=3), item("Agua", "0.25", (1, ""), column=2, at=3)]
    out = sheets.walk(cells(spark, ("h", book)), sheets.LAYOUTS[2013]).orderBy("fila").collect()
    assert [(r.generico, r._grupo, r.ponderador, r.encadenamiento, r["inflacion agrupacion"], r["canasta basica"]) for r in out] == [("renta", "vivienda", "4.75", "1.5", "vivienda", "X"), ("agua", "vivienda", "0.25", "", "", "-")]


SIDES = "generico string, ponderador string, encadenamiento string, COG string, `CCIF division` string"


@pytest.fixture(scope="module")
def extracts(spark):
    xlsx = spark.createDataFrame([("pan", "1.25", "1.0", "a", "comida"), ("cafe", "0.5", "1.1", "a", ""), ("renta", "3.0", "1.2", "", "casa"), ("agua", "1E-3", "1.3", "b", "casa")], SIDES)
    pdf = spark.createDataFrame([("pan", "1.3", "1.0", "a", "01 comida"), ("cafe", "0.7", "1.1", "b", "02 bebida"), ("renta", "3.0", "1.2", "", "04 vivienda"), ("agua", "0.001", "1.3", "b", "casa")], SIDES)
    return xlsx, pdf


def how(rows):
    return {(r.generico, r.columna): (r.valor_final, r.origen, r.metodo) for r in rows.collect()}


def test_resolutions(spark, extracts):
    got = how(audit.resolutions(*extracts, 2013, "xlsx"))
    assert got["pan", "ponderador"] == ("1.25", "xlsx", "preferido") and got["cafe", "ponderador"] == ("0.5", "xlsx", "preferido") and got["renta", "ponderador"] == ("3.0", "ambas", "igual")
    assert got["agua", "ponderador"] == ("1E-3", "xlsx", "redondeo")
    assert got["pan", "CCIF division"] == ("01 comida", "pdf", "igual") and got["renta", "CCIF division"] == ("04 casa", "mixto", "preferido") and got["cafe", "CCIF division"] == ("", "xlsx", "preferido") and got["agua", "CCIF division"] == ("casa", "ambas", "igual")
    assert got["pan", "COG"] == ("a", "xlsx", "directo") and got["renta", "COG"] == ("", "xlsx", None) and got["pan", "SCIAN rama"] == ("", "pdf", None)
    said = spark.createDataFrame([("CCIF division", "casa", "04 vivienda", "xlsx")], "columna string, valor_xlsx string, valor_pdf string, origen string")
    asked = how(audit.resolutions(*extracts, 2018, None, said))
    assert asked["renta", "CCIF division"] == ("04 casa", "mixto", "interactiva") and asked["cafe", "CCIF division"] == ("02 bebida", "pdf", "interactiva")
    assert asked["cafe", "COG"] == ("b", "pdf", "interactiva") and asked["renta", "COG"] == ("", "ambas", None)
    with pytest.raises(InvariantBroken):
        audit.resolutions(extracts[0].where("generico <> 'pan'"), extracts[1], 2018)
    with pytest.raises(ConfigurationProblem):
        audit.resolutions(*extracts, 2018, "neither")


def test_audit_documents(spark, extracts, tmp_path):
    rows = audit.resolutions(*extracts, 2018, "xlsx")
    audit.write_document(audit.cross_document(rows, 2018, "xlsx", xlsx="a.xlsx", pdf="b.pdf", csv="c.csv"), str(tmp_path / "doc"))
    doc = json.loads(spark.read.text(str(tmp_path / "doc")).first()[0])
    assert doc["tipo"] == "xlsx_pdf" and doc["genericos"] == 4 and doc["ponderadores"] == 4 and "encadenamientos" not in doc
    tree = doc["clasificaciones"]["CCIF division"]
    assert tree == {
        "genericos": 3, "categorias_unicas": 3,
        "categorias": {
            "01 comida": {"genericos": 1, "metodos": {"igual": 1}, "origenes_igual": {"pdf": 1}}, "04 casa": {"genericos": 1, "metodos": {"decision": 1}, "origenes_decision": {"mixto": 1}},
            "casa": {"genericos": 1, "metodos": {"igual": 1}, "origenes_igual": {"ambas": 1}}, "sin_clasificar": {"genericos": 1, "metodos": {"decision": 1}, "origenes_decision": {"xlsx": 1}},
        },
    }
    assert doc["clasificaciones"]["SCIAN rama"] == {"genericos": 0, "categorias_unicas": 0, "categorias": {}}
    assert {d["generico"]: d["ponderador"]["metodo"] for d in doc["genericos_detalle"]} == {"pan": "preferido", "cafe": "preferido", "renta": "igual", "agua": "redondeo"}
    one = json.loads(audit.xlsx_document(extracts[0], 2013, xlsx="a.xlsx").first()[0])
    assert one["encadenamientos"] == 4 and one["clasificaciones"]["COG"] == {"genericos_clasificados": 3, "categorias_unicas": 2, "categorias": {"a": 2, "b": 1}} and one["genericos_detalle"][0] == {"generico": "agua", "ponderador": "1E-3", "encadenamiento": "1.3"}
    target = spark.createDataFrame([("pan", "31 x", ""), ("cafe", "old", None)], "generico string, `SCIAN sector` string, `SCIAN rama` string")
    source = spark.createDataFrame([("pan", "31 x", "3118 y"), ("cafe", "31 x", "3119 z")], "generico string, `SCIAN sector` string, `SCIAN rama` string")
    sync = json.loads(audit.sync_document(audit.synchronised(target, source)).first()[0])
    assert sync["celdas_actualizadas"] == 3 and [d["cambio"] for d in sync["genericos_detalle"]] == [True, True] and sync["clasificaciones"]["SCIAN sector"]["categorias"] == {"31 x": 2}


def test_period_labels(spark):
    rows = spark.createDataFrame([(p, 3 * o) for p, n in (("a", 165), ("b", 20), ("c", 1), ("d", 33)) for o in range(n)] * 2, "panel string, ord int")
    got = {}
    for r in axes.period_labels(rows, "panel").collect():
        got.setdefault(r.panel, []).append(r.ord // 3)
    for panel, n in (("a", 165), ("b", 20), ("c", 1), ("d", 33)):
        c = min(n, 20)
        assert sorted(got[panel]) == ([0] if c == 1 else sorted({round(i * (n - 1) / (c - 1)) for i in range(c)}))
    assert axes.period_labels(rows.where("panel = 'd'")).count() == 20


def test_value_breaks(spark):
    rows = spark.createDataFrame([("a", 0.0), ("a", 100.0), ("b", 5.0), ("b", 5.0), ("c", -3.2), ("c", 8.7), ("d", 99.0), ("d", 131.0), ("e", None)], "panel string, v double")
    got = {}
    for r in axes.value_breaks(rows, "v", 100.0, "panel").collect():
        got.setdefault(r.panel, []).append(round(r.corte, 6))
    assert got["a"] == [10.0 * k for k in range(11)] and got["b"] == [5.0] and "e" not in got
    assert got["c"][0] == -3.2 and got["c"][-1] == 8.7 and 0.0 in got["c"] and all(b > a for a, b in zip(got["c"], got["c"][1:], strict=False))
    assert got["d"][0] == 99.0 and got["d"][-1] == 131.0 and 100.0 not in got["d"]  # the base lies too near the end


def test_legend_keeps_long_names_apart(spark):
    long = "22 generacion transmision distribucion y comercializacion de "
    rows = spark.createDataFrame([(n, k) for k, n in enumerate([long + "energia", "INPC", long + "gas", "corto", "__resto_cola__", *(f"s{i}" for i in range(6))])], "indice string, turno int")
    got = {r.indice: (r.color, r.etiqueta) for r in axes.legend(rows, order="turno").collect()}
    assert got["INPC"] == ("black", "INPC") and got["__resto_cola__"] == ("#7a7a7a", "resto (sin detallar)") and got["corto"] == ("#1baf7a", "corto")
    assert got[long + "energia"][0] == "#2a78d6" and got[long + "gas"][0] == "#eb6834" and got["s5"][0] == "#2a78d6"
    assert got[long + "energia"][1] == got[long + "gas"][1] == long[:31] + "..." and len(got[long + "gas"][1]) == 34
    apart = {r.indice: r.etiqueta for r in axes.legend(rows, order="turno", distinct=True).collect()}
    assert len(set(apart.values())) == len(apart) and all(len(x) <= 34 for x in apart.values()) and apart[long + "gas"].endswith(" (2)")


def test_marks_of_a_single_line(spark):
    rows = spark.createDataFrame([("p", "INPC", "resultado", o, o / 2) for o in (3, 1, 2)] + [("q", "INPC", k, 1, 1.0) for k in ("resultado", "comparacion")], "panel string, indice string, linea string, ord int, v double")
    assert sorted((r.panel, r.extremo, r.ord, r.v) for r in axes.ends_to_mark(rows, "v", "panel").collect()) == [("p", "primero", 1, 0.5), ("p", "ultimo", 3, 1.5)]
    said = axes.captions(rows.select("panel", "indice").unionByName(spark.createDataFrame([("q", "a"), ("q", "__resto_cola__")], "panel string, indice string")), spark.createDataFrame([(2,)], "categorias int"), "panel")
    assert sorted((r.panel, r.cobertura, r.numeracion) for r in said.collect()) == [("p", "1 de 2 categorías detalladas", "Imagen 1 de 2"), ("q", None, "Imagen 2 de 2")]


def test_kept_answers(spark):
    answers = spark.createDataFrame([("7", '{"Series":[{"OBSERVATIONS":[{"TIME_PERIOD":"2020/01/01","OBS_VALUE":"1.5"},{"TIME_PERIOD":"2020/02/01","OBS_VALUE":""}]}]}')], "indicador string, body string")
    names = spark.createDataFrame([("Q", "indice", "INPC", "INPC", "7"), ("M", "indice", "INPC", "INPC", "8")], "periodicidad string, medida string, tipo string, indice string, indicador string")
    source = Archive(answers, names)
    first = 2020 * 24
    assert sorted((r.ord, r.oficial) for r in source.history("Q", "indice").collect()) == [(first, 1.5), (first + 1, None), (first + 2, None)]
    assert source.table("Q", "indice").columns == ["ord", "INPC"] and source.at(spark.createDataFrame([(first,), (first + 9,)], "ord int"), "Q", "indice").count() == 1
    with pytest.raises(SourceUnavailable):
        source.history("M", "indice")
    with pytest.raises(ConfigurationProblem):
        source.history("Q", "anual")


def test_chart_facade(spark):
    from pricewell import api
    from pricewell.errors import ConfigurationProblem, InvariantBroken, PeriodUnavailable
    from pricewell.results import Result

    schema = "tipo string, periodicidad string, ord int, indice string, version int, indice_replicado double, indice_incidencia double, estado_calculo string, motivo_error string"
    names = [f"c{i:02d}" for i in range(10)]
    first = 2020 * 24
    rows = spark.createDataFrame([(("INPC" if n == "INPC" else "COG"), "Q", first + o, n, 2018, 100.0 + k + o, 100.0, "ok", None) for o in range(30) for k, n in enumerate([*names, "INPC"])], schema)
    made = api.preparar_grafica(Result(rows, "indice"), desde="1Q Ene 2020", hasta="2Q Jul 2020", referencia="1Q Ene 2020")
    assert made.titulo == "COG + INPC" and made.eje == "Indice (1Q Ene 2020 = 100)"
    per = {r.panel: r.n for r in made.filas.groupBy("panel").agg(F.countDistinct("indice").alias("n")).collect()}
    assert per == {0: 6, 1: 6} and made.filas.where("indice = 'INPC'").count() == 2 * 14 and made.etiquetas.count() == 14 and made.puntos.count() == made.filas.count() and made.extremos.count() == 0
    assert {r.turno for r in made.filas.where("indice = 'INPC'").collect()} == {2}
    alone = api.preparar_grafica(Result(rows.where("indice = 'INPC'"), "indice"))
    assert alone.filas.count() == 30 and alone.puntos.count() == 0 and sorted(r.extremo for r in alone.extremos.collect()) == ["primero", "ultimo"] and alone.etiquetas.count() == 20
    with pytest.raises(PeriodUnavailable):
        api.preparar_grafica(Result(rows, "indice"), desde="1Q Ene 1990")
    with pytest.raises(InvariantBroken):
        api.preparar_grafica(Result(rows, "indice"), desde="Ene 2020")
    annual = api.variacion_periodica(rows, "anual")
    with pytest.raises(ConfigurationProblem):
        api.preparar_grafica(Result(rows, "indice"), Result(annual, "variacion"))
    with pytest.raises(ConfigurationProblem):
        api.preparar_grafica(Result(annual, "variacion"), Result(api.variacion_acumulada_anual(rows), "variacion"))
    parts = annual.where("indice <> 'INPC'").withColumnRenamed("variacion_pp", "incidencia_pp").withColumnRenamed("clase_variacion", "clase_incidencia")
    stacked = api.preparar_grafica(Result(parts, "incidencia"), Result(annual.where("indice = 'INPC'"), "variacion"))
    assert {r.linea for r in stacked.filas.select("linea").distinct().collect()} == {"resultado", "comparacion"} and stacked.cortes.where("corte = 0").count() == 1
    top = stacked.filas.where("linea = 'resultado'").groupBy("ord").agg(F.sum("incidencia_pp").alias("s")).agg(F.max("s")).first()[0]
    assert abs(stacked.cortes.agg(F.max("corte")).first()[0] - top) < 1e-9
