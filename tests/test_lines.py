from pyspark.sql import functions as F

from pricewell.operators import lines

TEXT = ["01 Alimentos", "pan de caja", "integral 1.25", "", "leche 1,002.5", "02 Ropa", "camisa", "Total 3"]


def test_lines(spark):
    data = spark.createDataFrame([(d, k, t) for d in ("a", "b") for k, t in enumerate(TEXT)], "documento string, linea int, texto string").repartition(3)
    got = {(r.documento, r.linea): r.grupo for r in lines.carried(data, F.when(F.col("texto").rlike(r"^\d\d "), F.col("texto"))).collect()}
    assert got["a", 0] == got["b", 4] == "01 Alimentos" and got["a", 6] == "02 Ropa"
    rows = [(r.linea, r.texto, r.valor) for r in lines.rows_by_number(lines.without_totals(data)).where("documento = 'a'").orderBy("linea").collect()]
    assert rows == [(0, "01 Alimentos pan de caja integral", 1.25), (4, "leche", 1002.5), (5, "02 Ropa camisa", None)]
    more = [r.texto for r in lines.with_continuation(data.where("documento = 'a'")).orderBy("linea").collect()]
    assert more == ["01 Alimentos pan de caja", "02 Ropa camisa"]
