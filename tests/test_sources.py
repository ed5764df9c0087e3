"""Readers on small files, and the official source on canned answers."""

import csv
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pricewell import api, catalog_queries, source_queries, workflow_queries  # noqa: F401  (these register their queries with the first)
from pricewell.errors import ColumnsMissing, ConfigurationProblem, EncodingUnreadable, FileCorrupt, FileEmpty, OrientationUnknown, ResponseInvalid
from pricewell.scratch import shared_dir
from pricewell.sources import baskets, official, series, tables

HEAD = "\n".join(["x"] * 5)
P = "1Q Ago 2018"


def values(df):
    return {(r.generico, r.ord): r.valor for r in df.collect()}


def test_horizontal_in_latin1(spark, tmp_path):
    body = f'{HEAD}\nTítulo,Cifra,{P},2Q Ago 2018\n"001 Arroz, niño",Indice,100.5,N/E\nGrupo,x,1,2\n002 Huevo,Indice,,7\n'
    (tmp_path / "s.csv").write_bytes(body.encode("latin-1"))
    got = values(series.read_series(spark, f"{tmp_path}/s.csv", 2018))
    o = min(k[1] for k in got)
    assert got == {("arroz niño", o): 100.5, ("arroz niño", o + 1): None, ("huevo", o): None, ("huevo", o + 1): 7.0}


def test_vertical(spark, tmp_path):
    (tmp_path / "s.csv").write_text(f"{HEAD}\nTítulo,001 Arroz,002 Huevo\nCifra,a,b\n{P},1,2\n2Q Ago 2018,3,4\n")
    got = values(series.read_series(spark, f"{tmp_path}/s.csv", 2018))
    assert sorted(got.values()) == [1, 2, 3, 4] and {k[0] for k in got} == {"arroz", "huevo"}


def test_hierarchy(spark, tmp_path):
    titles = ["Quincenal", "Quincenal, Alimentos", "Quincenal, Alimentos, Pan, tortillas y cereales", "Quincenal, Ropa", "Suelto"]
    (tmp_path / "s.csv").write_text(f"{HEAD}\nTítulo,{P}\n" + "\n".join(f'"{t}",{i}' for i, t in enumerate(titles)))
    got = values(series.read_series(spark, f"{tmp_path}/s.csv", 2018))
    assert {k[0]: v for k, v in got.items()} == {"pan tortillas y cereales": 2.0, "ropa": 3.0}


def test_headers_are_checked(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"{HEAD}\nOtro,{P}\nx,1\n")
    (tmp_path / "b.csv").write_text(f"{HEAD}\nTítulo,foo\nx,1\n")
    with pytest.raises(ColumnsMissing):
        series.read_series(spark, f"{tmp_path}/a.csv", 2018)
    with pytest.raises(OrientationUnknown):
        series.read_series(spark, f"{tmp_path}/b.csv", 2018)


def write_basket_file(path, items=(("Arroz", 40), ("Huevo", 60))):
    rows = [",".join(baskets.FILE_COLUMNS)] + [",".join([n, str(w), "", "granos", *["c"] * 11]) for n, w in items]
    path.write_text("\n".join(rows))


def test_basket_and_history(spark, tmp_path):
    write_basket_file(tmp_path / "b.csv")
    basket = api.cargar_canasta(spark, f"{tmp_path}/b.csv", 2018)
    assert {(r.generico, r.ponderador, r.COG) for r in basket.collect()} == {("arroz", 40.0, "granos"), ("huevo", 60.0, "granos")}
    assert baskets.summary(basket).where("tipo = 'COG'").first().categorias == 1
    (tmp_path / "s.csv").write_text(f"{HEAD}\nTítulo,2Q Jul 2018,{P},2Q Ago 2018\n001 Arroz,100,110,120\n002 Huevo,100,100,100\n")
    data = api.cargar_serie(spark, f"{tmp_path}/s.csv", 2018)
    one = api.calcular_indice(basket, data, "cog")
    assert {round(r.indice_replicado, 6) for r in one.collect()} == {100.0, 104.0, 108.0}
    months = api.calcular_historia(basket, data)
    got = {r.ord: (round(r.indice_replicado, 6), r.estado_calculo) for r in months.where("tipo = 'INPC'").collect()}
    assert got == {2018 * 12 + 6: (100.0, "parcial"), 2018 * 12 + 7: (106.0, "ok")}
    assert api.inflacion_en(api.variacion_periodica(months, "mensual"), "Ago 2018").where("tipo = 'INPC'").first().variacion_pp == pytest.approx(6)
    baskets.write_basket(basket.select("generico", "ponderador", "COG"), f"{tmp_path}/out")
    assert tuple(spark.read.csv(f"{tmp_path}/out", header=True).columns) == baskets.FILE_COLUMNS
    with pytest.raises(ConfigurationProblem):
        api.cargar_canasta(spark, f"{tmp_path}/b.csv", 1999)
    (tmp_path / "c.csv").write_text("generico,ponderador\nx,1\n")
    with pytest.raises(ColumnsMissing):
        api.cargar_canasta(spark, f"{tmp_path}/c.csv", 2018)


def test_official(spark):
    seen = []

    def fetch(indicator):
        seen.append(indicator)
        if indicator == "bad":
            return "<html>"
        return json.dumps({"Series": [{"OBSERVATIONS": [{"TIME_PERIOD": "2026/03/01", "OBS_VALUE": "145.446"}, {"TIME_PERIOD": "2026/04/01", "OBS_VALUE": None}]}]})

    source = official.Official(spark, fetch, {("Q", "indice"): {("INPC", "INPC"): "1"}, ("M", "indice"): {("INPC", "INPC"): "1"}, ("Q", "x"): {("INPC", "INPC"): "bad"}})
    o = 2026 * 24 + 4
    assert {r.ord: r.oficial for r in source.history("Q", "indice").collect()} == {o: 145.446, o + 1: None, o + 2: None}
    assert source.at(spark.createDataFrame([(o,), (o + 9,)], "ord int"), "Q", "indice").count() == 1
    assert source.table("Q", "indice").columns == ["ord", "INPC"] and seen == ["1"] and len(source) == 1
    for p, m in (("M", "indice"), ("Q", "x")):
        with pytest.raises(ResponseInvalid):
            source.history(p, m)
    with pytest.raises(ConfigurationProblem):
        source.history("M", "y")
    with pytest.raises(ConfigurationProblem):
        official.http(str, 0)


def test_series_of_any_length(spark, tmp_path):
    """Files that no task may take whole, several of a series, each in its encoding and with its own columns and orientation."""
    title = lambda i: f'"{i:03d} Niño ""{i}"", y,\n más"'
    lines = [f"{title(i)},{i},x{i},{i + 0.5}" if i % 3 else f"{i:03d} Niño {i},{i}" for i in range(1, 60)]
    (tmp_path / "a.csv").write_bytes(f"{HEAD}\nTítulo,{P},Cifra,2Q Ago 2018\n{'\n'.join(lines)}".encode())
    (tmp_path / "b.csv").write_bytes(f'{HEAD}\r\nTítulo,"2Q Ago 2018"\r\n\r\n"200 Otro, niño",7\r\n201 Más,8'.encode("latin-1"))
    (tmp_path / "c.csv").write_text(f"{HEAD}\nTítulo,300 Arroz,301 Huevo\n{P},1,2\n2Q Ago 2018,3")
    o, conf = 2018 * 24 + 14, {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1", "spark.sql.sources.binaryFile.maxLength": "100"}
    kept = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = sorted(((r.generico, r.ord - o, r.valor) for r in series.read_series(spark, f"{tmp_path}/*.csv", 2018).collect()), key=str)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    want = [(f"niño {i} y" if i % 3 else f"niño {i}", k, v) for i in range(1, 60) for k, v in ((0, float(i)), (1, i + 0.5 if i % 3 else None))]
    want += [("otro niño", 1, 7.0), ("mas", 1, 8.0), ("arroz", 0, 1.0), ("huevo", 0, 2.0), ("arroz", 1, 3.0), ("huevo", 1, None)]
    assert got == sorted(want, key=str)
    (tmp_path / "d.csv").write_text(f'{HEAD}\nTítulo,{P}\n"001 Arroz,1\n002 Huevo,2\n')
    (tmp_path / "e.csv").write_text(HEAD)
    with pytest.raises(FileCorrupt):  # a quote that never ends
        series.read_series(spark, f"{tmp_path}/d.csv", 2018)
    with pytest.raises(FileEmpty):
        series.read_series(spark, f"{tmp_path}/e.csv", 2018)


def test_records_over_chunks(spark, tmp_path):
    """A file's records don't depend on where its lines are cut, quotes over many lines among them; as Python reads the file whole."""
    text = 'a\n"b\nc\n' + "".join(f'{i},"u\n\n""v"" ,\n{i}"\n"w"x"y,"",\n\n"z",  ,"\né"\n' for i in range(12)) + "end,"
    (tmp_path / "t.csv").write_text(text)
    want, reader, at = [], csv.reader(x + "\n" for x in text.split("\n")[3:]), 0
    for cells in reader:
        want += [(at, [x.strip() or None for x in cells])] if cells else []
        at = reader.line_num
    for chunk in (1, 9, 1 << 15):
        assert sorted((r.row, r.cells) for r in tables.records(spark, f"{tmp_path}/t.csv", 3, chunk=chunk).collect()) == want
    (tmp_path / "u.csv").write_bytes(b"a\n\x81")
    with pytest.raises(EncodingUnreadable):
        tables.records(spark, f"{tmp_path}/u.csv", 0, ("utf-8", "cp1252"))


@pytest.mark.parametrize("name, files", [("cargar_serie", "series-loaded"), ("leer_serie", "series")])
def test_series_are_written_by_many_tasks(spark, tmp_path, name, files):
    rows = spark.range(0, 1000, 1, 3).select(F.col("id").alias("p_partkey"), F.lit("x").alias("p_name"), (F.col("id") % 50).cast("int").alias("p_size"))
    rows.write.parquet(f"{tmp_path}/part.parquet")
    size = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task a file
    try:
        got = catalog_queries.queries()[name](spark, str(tmp_path))
        assert got.count() == 4000 and got.where("valor is null").count() == 800 and got.select("generico").distinct().count() == 1000
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", size)
    written = sorted(Path(shared_dir(spark)).glob(f"{files}-{spark.sparkContext.applicationId}-{abs(hash(str(tmp_path)))}/*.txt"))
    assert len(written) >= 3 and all(p.read_text().split("\n")[5].startswith("Título,") for p in written)
