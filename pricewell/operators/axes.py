"""Axes, legends and marks of charts as relations: labelled periods, breaks of the value axis, colours and labels of series, first and last points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Labels of the period axis and of the value axis at most; least distance of a break from an end, as a share of the range.
PERIOD_LABELS, VALUE_LABELS, LEAST_DISTANCE = 20, 10, 0.035
#: Greatest length of a legend label; colours of series in their order; those that have their own.
LABEL_LENGTH = 34
PALETTE = ("#2a78d6", "#eb6834", "#1baf7a", "#eda100", "#e87ba4", "#008300", "#4a3aa7", "#e34948")
OWN_COLOURS = {"INPC": "black", "__resto_diferido__": "#cccccc", "__resto_cola__": "#7a7a7a"}
OWN_LABELS = {"__resto_diferido__": "resto (en otras imagenes)", "__resto_cola__": "resto (sin detallar)"}
#: Extended Wilkinson search (Talbot, Lin, Hanrahan 2010): nice steps, weights of simplicity, coverage, density and legibility.
STEPS, WEIGHTS = (1.0, 5.0, 2.0, 2.5, 4.0, 3.0), (0.25, 0.2, 0.5, 0.05)
#: Beyond these skips, labels and powers a score can't be the best: its bound is below what the first skips give.
MOST_SKIPS, MOST_LABELS, MORE_POWERS = 4, 24, 1


def period_labels(rows: DataFrame, *panel: str, most: int = PERIOD_LABELS) -> DataFrame:
    """panel, ord: at most `most` periods of each panel, spread evenly, the first and the last among them; steps differ by one period at most.

    Of n periods those are labelled whose place is the rounding (half to even) of i (n - 1) / (most - 1) for a whole i: for a place only the two i next to it can be.
    """
    every = W.partitionBy(*panel) if panel else W.partitionBy(F.lit(0))
    periods = rows.select(*panel, "ord").distinct().withColumns({"_r": F.row_number().over(every.orderBy("ord")) - 1, "_n": F.count("*").over(every)})
    count = F.least(F.col("_n"), F.lit(most))
    step = (F.col("_n") - 1) / (count - 1)
    hits = lambda i: F.coalesce(F.rint(i * step) == F.col("_r"), F.lit(False))
    at = F.col("_r") / step
    return periods.where((count == 1) & (F.col("_r") == 0) | (count > 1) & (hits(F.floor(at)) | hits(F.ceil(at)))).select(*panel, "ord")


def value_breaks(rows: DataFrame, value: str, base: float, *panel: str) -> DataFrame:
    """panel, corte: both ends of each panel's values, the nice breaks between them and the base; what comes too near an end is left out."""
    ends = rows.where(F.col(value).isNotNull()).groupBy(*panel).agg(F.min(value).alias("_a"), F.max(value).alias("_z"))
    nice = _extended(ends, *panel)
    room = (F.col("_z") - F.col("_a")) * LEAST_DISTANCE
    inside = nice.withColumn("_all", F.concat("_nice", F.array(F.lit(float(base))))).withColumn("_in", F.filter("_all", lambda b: (b > F.col("_a") + room) & (b < F.col("_z") - room)))
    every = F.when(F.col("_z") > F.col("_a"), F.array_distinct(F.concat(F.array("_a", "_z"), "_in"))).otherwise(F.array("_a"))
    return inside.select(*panel, F.explode(F.array_sort(every)).alias("corte"))


def _extended(ends: DataFrame, *panel: str) -> DataFrame:
    """Adds _nice, the labels of the best score: all candidates of a panel are scored as rows, the first of the best stays. Panels are few."""
    a, z, n = F.col("_a"), F.col("_z"), VALUE_LABELS
    wide = ends.where(z > a)
    tried = wide.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(MOST_SKIPS)))).select("*", F.posexplode(F.array(*map(F.lit, STEPS))).alias("i", "q")).withColumn("k", F.explode(F.sequence(F.lit(2), F.lit(MOST_LABELS))))
    first = F.ceil(F.log10((z - a) * (1.0 / (F.col("k") + 1.0)) / (F.col("j") * F.col("q")))).cast("int")
    j, q, k, p = (F.col(c) for c in ("j", "q", "k", "p"))
    tried = tried.withColumn("first", first).withColumn("p", F.explode(F.sequence(F.col("first"), F.col("first") + MORE_POWERS)))
    size = lambda power: j * q * F.pow(F.lit(10.0), power)
    low = lambda s: (F.floor(z / s) * j - (k - 1) * j).cast("long")
    high = lambda s: (F.ceil(a / s) * j).cast("long")
    # Where the least power leaves no place for the labels, greater ones are not tried.
    tried = tried.where(low(size(F.col("first"))) <= high(size(F.col("first")))).withColumn("step", size(p))
    tried = tried.withColumn("start", F.explode(F.sequence(low(F.col("step")), high(F.col("step")))))
    step = F.col("step")
    tried = tried.withColumn("lo", F.col("start") * (step / j)).withColumn("hi", F.col("lo") + step * (k - 1))
    lo, hi = F.col("lo"), F.col("hi")
    rest = lo - F.floor(lo / step) * step
    zero = (((rest < 1e-10) | (step - rest < 1e-10)) & (lo <= 0) & (hi >= 0)).cast("int")
    simplicity = (len(STEPS) - (F.col("i") + 1)) / F.lit(len(STEPS) - 1.0) + zero - j
    coverage = 1 - 0.5 * (F.pow(z - hi, F.lit(2.0)) + F.pow(a - lo, F.lit(2.0))) / F.pow(0.1 * (z - a), F.lit(2.0))
    own, wanted = (k - 1.0) / (hi - lo), (n - 1) / (F.greatest(hi, z) - F.least(lo, a))
    density = 2 - F.greatest(own / wanted, wanted / own)
    score = WEIGHTS[0] * simplicity + WEIGHTS[1] * coverage + WEIGHTS[2] * density + WEIGHTS[3]
    best = tried.withColumn("score", score).groupBy(*panel).agg(F.max(F.struct(F.round("score", 12), -j, -F.col("i"), -k, -p, -F.col("start"), "lo", "step", "k")).alias("b"))
    made = best.select(*panel, F.transform(F.sequence(F.lit(0), F.col("b.k") - 1), lambda x: x * F.col("b.step") + F.col("b.lo")).alias("_nice"))
    empty = F.expr("cast(array() as array<double>)")
    if not panel:
        return ends.join(F.broadcast(made), F.lit(True), "left").withColumn("_nice", F.coalesce("_nice", empty))
    return ends.join(F.broadcast(made), list(panel), "left").withColumn("_nice", F.coalesce("_nice", empty))


def legend(series: DataFrame, *panel: str, order: str = "indice", distinct: bool = False) -> DataFrame:
    """panel, indice, color, etiqueta of the distinct series of each panel, in order of a column.

    Headline and remainders have their own colours and take no turn of the palette. A label is the name, cut to LABEL_LENGTH characters; with `distinct`,
    names that are cut to the same label get a number, so that no two labels of a panel agree.
    """
    own = F.col("indice").isin(*OWN_COLOURS)
    names = series.groupBy(*panel, "indice").agg(F.min(order).alias("_o"))
    turn = F.sum((~own).cast("int")).over(W.partitionBy(*panel).orderBy("_o", "indice").rowsBetween(W.unboundedPreceding, W.currentRow)) - 1
    colour = F.element_at(F.array(*map(F.lit, PALETTE)), (turn % len(PALETTE) + 1).cast("int"))
    text = F.col("indice")
    for k, c in OWN_COLOURS.items():
        colour = F.when(F.col("indice") == k, c).otherwise(colour)
    for k, t in OWN_LABELS.items():
        text = F.when(F.col("indice") == k, t).otherwise(text)
    cut = F.when(F.length(text) > LABEL_LENGTH, F.concat(F.substring(text, 1, LABEL_LENGTH - 3), F.lit("..."))).otherwise(text)
    out = names.withColumn("color", colour).withColumn("etiqueta", cut)
    if distinct:
        same = W.partitionBy(*panel, "etiqueta")
        place, many = F.row_number().over(same.orderBy("_o", "indice")), F.count("*").over(same)
        number = F.concat(F.lit(" ("), place.cast("string"), F.lit(")"))
        short = F.concat(F.expr(f"left(etiqueta, {LABEL_LENGTH} - length(_m))"), F.col("_m"))
        out = out.withColumn("_m", F.when(many > 1, number)).withColumn("etiqueta", F.when(F.col("_m").isNotNull(), short).otherwise(F.col("etiqueta")))
    return out.select(*panel, "indice", "color", "etiqueta")


def ends_to_mark(rows: DataFrame, value: str, *panel: str) -> DataFrame:
    """panel, indice, extremo (primero or ultimo), ord, value: the marks of panels with a single line; with several, numbers would compete with the legend."""
    lines = ["indice", *(c for c in ("linea",) if c in rows.columns)]
    at = F.struct("ord", *lines, value)
    g = rows.groupBy(*panel).agg(F.countDistinct(*lines).alias("_n"), F.min_by(at, "ord").alias("primero"), F.max_by(at, "ord").alias("ultimo")).where("_n = 1")
    both = g.select(*panel, F.explode(F.array(*(F.struct(F.lit(x).alias("extremo"), F.col(x).alias("p")) for x in ("primero", "ultimo")))).alias("e"))
    return both.select(*panel, "e.p.indice", "e.extremo", "e.p.ord", f"e.p.{value}")


def captions(series: DataFrame, totals: DataFrame, *panel: str) -> DataFrame:
    """panel, cobertura, numeracion of stacked charts: how many categories a panel details of all, and which of the panels it is; null where there is nothing to say.

    series: panel and indice; totals: one row with `categorias`. Panels are numbered in their order.
    """
    own = series.groupBy(*panel).agg(F.countDistinct(F.when(~F.col("indice").isin(*OWN_LABELS), F.col("indice"))).alias("_n"))
    every = W.partitionBy(F.lit(0))
    out = own.join(F.broadcast(totals.select("categorias")), F.lit(True)).withColumns({"_k": F.row_number().over(every.orderBy(*panel)), "_of": F.count("*").over(every)})
    said = F.concat(F.col("_n").cast("string"), F.lit(" de "), F.col("categorias").cast("string"), F.lit(" categorías detalladas"))
    return out.select(*panel, F.when(F.col("_n") != F.col("categorias"), said).alias("cobertura"), F.when(F.col("_of") > 1, F.concat(F.lit("Imagen "), F.col("_k").cast("string"), F.lit(" de "), F.col("_of").cast("string"))).alias("numeracion"))
