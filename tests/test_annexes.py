"""Automata, and annexes of printed lines against small documents written out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from pricewell.errors import ConfigurationProblem
from pricewell.operators import automata
from pricewell.sources import annexes


@pytest.mark.parametrize("chunk", [1, 3, 256])
def test_automata_replay_as_one_run(spark, chunk):
    rnd = random.Random(2)
    table = annexes.SPLIT_2013
    data = [(d, i, rnd.randrange(3)) for d in ("a", "b", "c") for i in range({"a": 50, "b": 1, "c": 17}[d])]
    rows = spark.createDataFrame([(d, 3 * i, t, f"x{i}") for d, i, t in data], "documento string, linea int, clase int, texto string").repartition(4)
    got = {(r.documento, r.linea): (r.antes, r.despues, r.texto) for r in automata.states(rows, F.col("clase"), table, chunk=chunk).collect()}
    want, state = {}, {}
    for d, i, t in data:
        before = state.get(d, 0)
        state[d] = table[before][t]
        want[d, 3 * i] = (before, state[d], f"x{i}")
    assert got == want


def lines_of(spark, **texts):
    rows = [("m", a, i, t) for a, body in texts.items() for i, t in enumerate(body.strip("\n").split("\n"))]
    return spark.createDataFrame(rows, "documento string, anexo string, linea int, texto string").repartition(3)


def found(df, *columns):
    return sorted(tuple(r) for r in df.select("generico", *(f"`{c}`" for c in columns)).collect())


def test_2010(spark):
    ccif = """
  Total                         100.000
 01 Alimentos y bebidas          20.0
   01.1 Alimentos                18.5
      01.1.1 Pan y cereales       9.25
 001 Tortilla de maíz             5.1
   01.2 Bebidas                   1.5
 002 Café                         1.50
a line without a number
 02 Ropa                          3
 02 Ropa                          3.0
 003 Calcetines                   0.5
"""
    cog = """
INPC 100.0
Alimentos, bebidas y tabaco 40.0
001 Tortilla de maíz 5.1
otrosse rvicios 3.0
003 Calcetines 0.5
"""
    out = annexes.basket_of(lines_of(spark, CCIF=ccif, COG=cog), 2010)
    assert out.columns == ["documento", *annexes.FILE_COLUMNS]
    assert found(out, "ponderador", "CCIF division", "CCIF grupo", "CCIF clase", "COG", "SCIAN rama") == [
        ("cafe", "1.50", "01 alimentos y bebidas", "01.2 bebidas", "", "", ""),
        ("calcetines", "0.5", "02 ropa", "", "", "otros servicios", ""),
        ("tortilla de maiz", "5.1", "01 alimentos y bebidas", "01.1 alimentos", "01.1.1 pan y cereales", "alimentos bebidas y tabaco", ""),
    ]


def test_2013_rows_split_over_lines_and_pages(spark):
    ccif = """
Documento Metodológico INPC
 Índice general                 100.0   1.0
 01 Alimentos                    20.0   1.1
 01.1.1 Pan, cereales y
                                  9.0   1.2
 productos de panadería
 001 Pan dulce                    1.5   1.01
 002 Otros productos de
    panadería fina                2.5   1.02
                     61
 y galletas

 003 Harinas                      3.0   1.03
 a name that
 never has numbers
 004 Cereales                     4.0   1.04
"""
    scian = """
 Sector económico secundario     50.0   1.0
 31-33. Industrias               40.0   1.0
 Rama 3118. Elaboración de
                                 10.0   1.0
 productos de panadería
 001 Pan dulce                    1.5   1.01
 Rama 3112. Molienda              5.0   1.0
 003 Harinas                      3.0   1.03
 Anexo III                        0.0   0.0
 004 Cereales                     4.0   1.04
"""
    out = annexes.basket_of(lines_of(spark, CCIF=ccif, SCIAN=scian), 2013)
    assert found(out, "ponderador", "encadenamiento", "CCIF division", "CCIF clase", "SCIAN sector", "SCIAN rama") == [
        ("cereales", "4.0", "1.04", "01 alimentos", "01.1.1 pan cereales y productos de panaderia", "", ""),
        ("harinas", "3.0", "1.03", "01 alimentos", "01.1.1 pan cereales y productos de panaderia", "31 industrias", "3112 molienda"),
        ("otros productos de panaderia fina y galletas", "2.5", "1.02", "01 alimentos", "01.1.1 pan cereales y productos de panaderia", "", ""),
        ("pan dulce", "1.5", "1.01", "01 alimentos", "01.1.1 pan cereales y productos de panaderia", "31 industrias", "3118 elaboracion de productos de panaderia"),
    ]


def test_2018_sections_by_headings(spark):
    text = """
Preface  1.0
Anexo C. Canasta por CCIF
 01 Alimentos                          20.0
 01.1 Alimentos                        10.0
 001 Tortilla     No duradero           5.1
 002 Corte        Servicio              0.2
 003 Nada                               0.3
 Total general                        100.0
Anexo D. Canasta por objeto del gasto
 1. Alimentos, bebidas                 30.0
 1.1. Alimentos                        20.0
 01 Maíz                                6.0
 001 Tortilla                           5.1
 2. Ropa                               10.0
 003 Nada                               0.3
Anexo E. Canasta por SCIAN
 31 Industrias de la alimentación      30.0
 y las bebidas
 3118 Panaderías                       20.0
 julio de 2018
 001 Tortilla                           5.1
 8121 Salones                           1.0
 002 Corte                              0.2
"""
    rows = [("m", i, t) for i, t in enumerate(text.strip("\n").split("\n"))]
    lines = annexes.by_heading(spark.createDataFrame(rows, "documento string, linea int, texto string"), [("CCIF", r"^\s*Anexo C\."), ("COG", r"^\s*Anexo D\."), ("SCIAN", r"^\s*Anexo E\.")])
    out = annexes.basket_of(lines, 2018)
    assert found(out, "ponderador", "durabilidad", "CCIF grupo", "COG", "SCIAN sector", "SCIAN rama") == [
        ("corte", "0.2", "servicio", "01.1 alimentos", "", "31 industrias de la alimentacion y las bebidas", "8121 salones"),
        ("nada", "0.3", "", "01.1 alimentos", "ropa", "", ""),
        ("tortilla", "5.1", "no duradero", "01.1 alimentos", "alimentos bebidas", "31 industrias de la alimentacion y las bebidas", "3118 panaderias"),
    ]


def test_2024_names_before_their_number(spark, tmp_path):
    ccif = " 01 Alimentos   20.0\n 001 Tortilla   Duradero   5.1\n 002 Aceite   1.0"
    scian = "A. Canasta\n31 Industrias de\nproductos comesti\nbles\n30.0\n3118 Panaderías 20.0\n001 Tortilla Secundario 5.1\n102\n3112 Grasas y aceites\ninterna\ncionales 2.0\n002 Aceite Secundario 1.0\nwithout an end"
    path = tmp_path / "manual.txt"
    path.write_text("\f".join([""] * 90 + [ccif] + [""] * 9 + [scian]))
    pages = annexes.read_pages(spark, str(path))
    assert pages.agg(F.max("pagina")).first()[0] == 101
    out = annexes.basket_of(annexes.by_page(pages, 2024), 2024)
    assert found(out, "ponderador", "durabilidad", "SCIAN sector", "SCIAN rama") == [
        ("aceite", "1.0", "", "31 industrias de productos comestibles", "3112 grasas y aceites internacionales"),
        ("tortilla", "5.1", "duradero", "31 industrias de productos comestibles", "3118 panaderias"),
    ]
    with pytest.raises(ConfigurationProblem):
        annexes.basket_of(pages, 2011)
