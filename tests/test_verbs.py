"""Verbs over two versions whose categories and items change their names; spans; summaries of derived results."""

import math
import warnings

import pytest
from pyspark.sql import functions as F

from pricewell import api, catalog, renames
from pricewell.errors import InvariantBroken
from pricewell.functions.periods import parse_as
from pricewell.operators import convert, incidence, validate
from pricewell.results import Result
from pricewell.sources import baskets

JUNTA = parse_as("2Q Jul 2024", "Q")
FIRST = JUNTA - 30
#: item, weight, division and durability in 2018; the same in 2024.
ITEMS = (
    ("pan", 40.0, "01 alimentos y bebidas no alcoholicas", "a", "pan", 35.0, "01 alimentos y bebidas no alcoholicas", "a"),
    ("leche de soya", 10.0, "01 alimentos y bebidas no alcoholicas", "a", "leches de origen vegetal", 15.0, "01 alimentos y bebidas no alcoholicas", "b"),
    ("telefono", 30.0, "08 comunicaciones", "b", "telefono", 20.0, "08 informacion y comunicacion", "b"),
    ("escuela", 20.0, "10 educacion", "b", "escuela", 30.0, "10 servicios educativos", "b"),
)


def price(k, o):
    return 100.0 + (k + 1) * (o - FIRST) * 0.3 + 2 * math.sin(k + o)


@pytest.fixture(scope="module")
def inputs(spark):
    basket, series = [], []
    for k, (old, w, div, dur, new, w2, div2, dur2) in enumerate(ITEMS):
        basket += [(2018, old, w, None, div, dur), (2024, new, w2, None, div2, dur2)]
        series += [(2018, old, o, price(k, o)) for o in range(FIRST, JUNTA + 1)] + [(2024, new, o, price(k, o)) for o in range(JUNTA, JUNTA + 25)]
    own = {"CCIF DIVISION": F.col("division"), "DURABILIDAD": F.col("durabilidad")}
    rows = spark.createDataFrame(basket, "version int, generico string, ponderador double, encadenamiento double, division string, durabilidad string")
    rows = rows.select("version", "generico", "ponderador", "encadenamiento", *(own.get(c, F.lit(None).cast("string")).alias(c) for c in catalog.CLASSES))
    return rows.cache(), spark.createDataFrame(series, "version int, generico string, ord int, valor double").cache()


@pytest.fixture(scope="module")
def history(inputs):
    return {v: api.calcular_historia(*inputs, referencia="1Q Ago 2023", mensual=False, nombres_de=v).cache() for v in (2018, 2024)}


@pytest.mark.parametrize("named", [2018, 2024])
def test_contributions_find_the_names_of_the_result(inputs, history, named):
    """As with the renames given by hand, and adding up to the headline across the link period."""
    h, classes = history[named], baskets.classes_of(inputs[0])
    assert {r.tipo: r.canonica for r in renames.canonical_versions(h, classes).collect()}["CCIF DIVISION"] == named
    spoken = classes.select("version", "tipo", F.col("categoria").alias("indice"), F.col("categoria").alias("nuevo")).distinct()
    given = renames.to_version(spoken, named, "nuevo").where("indice <> nuevo").cache()
    assert {r.version for r in given.collect()} == ({2024} if named == 2018 else {2018})
    own = api.incidencia_periodica(h, inputs[0], "anual").where("computable").cache()
    by_hand = api.incidencia_periodica(h, inputs[0], "anual", renombres=given).where("computable")
    key = lambda rows: {(r.tipo, r.ord, r.indice): (round(r.incidencia_pp, 9), r.metodo_incidencia) for r in rows.collect()}
    found = key(own)
    assert found == key(by_hand)
    names = {i for t, o, i in found if t == "CCIF DIVISION" and o > JUNTA}
    assert len(names) == 3 and all(m == "cross_segmentado" for (t, o, _), (_, m) in found.items() if t == "CCIF DIVISION" and o > JUNTA)
    head = {r.ord: r.variacion_pp for r in api.variacion_periodica(h.where("tipo = 'INPC'"), "anual").where("computable").collect()}
    sums = {r.ord: r.s for r in own.where("tipo = 'CCIF DIVISION'").groupBy("ord").agg(F.sum("incidencia_pp").alias("s")).collect()}
    assert sums.keys() == head.keys() and all(abs(sums[o] - head[o]) < 1e-9 for o in head)


def test_an_item_that_is_renamed_and_moves_makes_a_class_unstable(inputs, history):
    classes = baskets.classes_of(inputs[0])
    stable = {r.tipo: r.estable for r in incidence.stable(renames.aligned(classes)).collect()}
    assert stable == {"INPC": True, "CCIF DIVISION": True, "DURABILIDAD": False}
    # Under the items' own names nobody is seen to move, and under the categories' own ones the divisions differ.
    assert {r.tipo: r.estable for r in incidence.stable(classes).collect()} == {"INPC": True, "CCIF DIVISION": False, "DURABILIDAD": True}
    rows = api.incidencia_periodica(history[2024], inputs[0], "anual").where("tipo = 'DURABILIDAD' and computable").collect()
    assert {r.metodo_incidencia for r in rows if r.ord > JUNTA} == {"cross_visible"}
    # Versions that the result lacks don't count.
    only = api.incidencia_periodica(history[2024].where("version = 2018"), inputs[0], "anual").where("computable").collect()
    assert {r.metodo_incidencia for r in only} == {"within"}


def test_items_go_forward_and_back(spark):
    rows = spark.createDataFrame([(2013, "helados"), (2018, "helados nieves y paletas de hielo"), (2018, "leche de soya"), (2024, "leches de origen vegetal"), (2010, "pan"), (2024, "helados nieves y paletas de hielo")], "version int, generico string")
    as_of = lambda v: sorted(r.generico for r in renames.items_to_version(rows, v).collect())
    assert as_of(2024) == ["helados nieves y paletas de hielo"] * 3 + ["leches de origen vegetal"] * 2 + ["pan"]
    assert as_of(2013) == ["helados"] * 3 + ["leche de soya"] * 2 + ["pan"]
    each = rows.withColumn("hasta", F.when(F.col("version") == 2013, 2024).otherwise(2013))
    assert sorted(r.generico for r in renames.items_to_version(each, F.col("hasta")).collect()) == ["helados"] * 2 + ["helados nieves y paletas de hielo"] + ["leche de soya"] * 2 + ["pan"]


def index(spark, *cells):
    schema = "tipo string, periodicidad string, ord int, indice string, version int, indice_replicado double, indice_incidencia double, estado_calculo string, motivo_error string"
    return spark.createDataFrame([(k, p, o, i, v, x, x, "ok", None) for k, p, o, i, v, x in cells], schema)


def test_spans_are_spliced_under_one_versions_names(spark):
    old = index(spark, *(("CCIF DIVISION", "Q", o, n, 2018, 1.0 * o) for o in (JUNTA - 1, JUNTA) for n in ("08 comunicaciones", "10 educacion")))
    new = index(spark, *(("CCIF DIVISION", "Q", o, n, 2024, 2.0 * o) for o in (JUNTA, JUNTA + 1) for n in ("08 informacion y comunicacion", "10 servicios educativos", "14 nueva")))
    key = lambda rows: sorted((r.ord - JUNTA, r.indice, r.version) for r in rows.collect())
    assert key(api.empalmar(new, old)) == [
        (-1, "08 informacion y comunicacion", 2018), (-1, "10 servicios educativos", 2018), (0, "08 informacion y comunicacion", 2018), (0, "10 servicios educativos", 2018), (0, "14 nueva", 2024),
        (1, "08 informacion y comunicacion", 2024), (1, "10 servicios educativos", 2024), (1, "14 nueva", 2024),
    ]
    assert {i for _, i, _ in key(api.empalmar(old, new, version_nombres=2018))} == {"08 comunicaciones", "10 educacion", "14 nueva"}
    # Two names that become one: the first in the alphabet stays.
    both = old.unionByName(index(spark, ("CCIF DIVISION", "Q", JUNTA - 1, "03 ropa y calzado", 2018, 7.0), ("CCIF DIVISION", "Q", JUNTA - 1, "03 prendas de vestir y calzado", 2018, 8.0)))
    fell = [r.indice_replicado for r in api.empalmar(both, new).where("indice = '03 ropa y calzado'").collect()]
    assert fell == [8.0]


def test_spans_that_break_the_rules(spark):
    span = lambda v, a, z, tipo="INPC", p="Q": index(spark, *((tipo, p, o, "INPC", v, 100.0) for o in range(a, z + 1)))
    a, b = span(2018, JUNTA - 5, JUNTA), span(2024, JUNTA, JUNTA + 5)
    with pytest.raises(InvariantBroken, match="two spans"):
        api.empalmar(a)
    with pytest.raises(InvariantBroken, match="same classifications"):
        api.empalmar(a, span(2024, JUNTA, JUNTA + 5, "COG"))
    with pytest.raises(InvariantBroken, match="one periodicity"):
        api.empalmar(a, span(2024, JUNTA, JUNTA + 5, p="M"))
    with pytest.raises(InvariantBroken, match="outside"):
        api.empalmar(a, b, version_nombres=2013)
    # Of three spans: three periods between the first two, two between the first and the last, none between the last two.
    third = span(2024, 111, 112).unionByName(span(2024, 130, 131))
    with pytest.raises(InvariantBroken, match="0 and 1 share 3; 0 and 2 share 2; 1 and 2 share 0"):
        api.empalmar(span(2013, 100, 120), span(2018, 108, 110).unionByName(span(2018, 124, 126)), third)
    with pytest.raises(InvariantBroken, match="rebased"):
        api.empalmar(a, b, referencias=["1Q Ene 2024", None])
    with pytest.warns(UserWarning, match="rebased"):
        assert api.empalmar(a, b, forzar=True, referencias=["1Q Ene 2024", None]).count() == 11
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert api.empalmar(b, a, referencias=[None, "2Q Jul 2024"]).count() == 11
    with pytest.warns(UserWarning, match="months"):
        api.empalmar(span(2018, 1, 5, p="M"), span(2024, 5, 8, p="M"))


def test_derived_summaries_count_computable_rows(spark):
    """The first year lacks a base: its rows are in the diagnostics, and the overall state is ok."""
    h = index(spark, *(("INPC", "Q", o, "INPC", 2018, 100.0 + o) for o in range(48)))
    rows = api.variacion_periodica(h, "anual")
    official = rows.select("tipo", "indice", "ord", F.coalesce("variacion_pp", F.lit(1.0)).alias("oficial"))
    r = validate.derived_summary(api.validar_variacion(rows, official), "tipo").first()
    assert (r.n_filas, r.n_comparables, r.n_ok, r.n_diagnostico, r.estado_global, r.estado_calculo, r.desde, r.hasta) == (24, 24, 24, 24, "ok", "ok", 24, 47)
    assert validate.summary(api.validar_variacion(rows, official), "tipo").first().estado_global == "sin_calculo"

    class Source:
        def at(self, periods, periodicity, measure):
            return official.where("ord < 30").withColumn("oficial", F.when(F.col("ord") == 29, F.col("oficial") + 1).otherwise(F.col("oficial")))

    found = api.validar(Result(rows, "variacion"), Source).resumen.first()
    assert (found.n_comparables, found.n_ok, found.n_diferencia_detectada, found.n_fuera_rango_inegi, found.clase_variacion) == (6, 5, 1, 18, "periodica_anual")
    assert found.estado_global == "diferencia_detectada" and abs(found.error_maximo - 1) < 1e-9


def test_shared_periods_of_many_spans(spark):
    rows = spark.createDataFrame([(t, o) for t in range(4) for o in range(10 * t, 10 * t + 11)] * 2, "_tramo int, ord int")
    assert convert.check_spans(rows) == [10, 20, 30]
