"""Matching two extracts of one basket, and carrying classes from one basket to another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvariantBroken
from ..functions.text import code_of, equal_when_rounded, more_precise, name_after_code, normalized


def check_same_items(a: DataFrame, b: DataFrame, key: str = "generico") -> None:
    """Raises if either side has items that the other lacks."""
    for x, y, side in ((a, b, "second"), (b, a, "first")):
        lacking = [r[0] for r in x.select(key).join(y.select(key), key, "left_anti").orderBy(key).limit(3).collect()]
        if lacking:
            raise InvariantBroken(f"items that the {side} extract lacks: {lacking}")


def _both(a: DataFrame, b: DataFrame, column: str, key: str) -> DataFrame:
    return a.select(key, F.col(column).alias("x")).join(b.select(key, F.col(column).alias("p")), key)


def match_numbers(a: DataFrame, b: DataFrame, column: str, prefer: str = "p", key: str = "generico") -> DataFrame:
    """Row by row: equal, equal after rounding to the less precise (the more precise stays), else the preferred side."""
    x, p = F.col("x"), F.col("p")
    near = F.coalesce(equal_when_rounded(x, p), F.lit(False))
    return _both(a, b, column, key).select(
        key, F.lit(column).alias("columna"), "x", "p",
        F.when(x.eqNullSafe(p), x).when(near, more_precise(x, p)).otherwise(F.col(prefer)).alias("valor_final"),
        F.when(x.eqNullSafe(p), "igual").when(near, "redondeo").otherwise("preferido").alias("metodo"),
    )


def match_categories(a: DataFrame, b: DataFrame, column: str, answers: DataFrame | None = None, key: str = "generico") -> DataFrame:
    """One decision a pair of values: equal without code, else the answer given for the pair (x, p, valor_final), else the second side."""
    pairs = _both(a, b, column, key).groupBy("x", "p").agg(F.sort_array(F.collect_list(key)).alias("genericos"))
    same = name_after_code(F.col("x")).eqNullSafe(name_after_code(F.col("p")))
    if answers is None:
        pairs = pairs.withColumn("_answer", F.lit(None).cast("string"))
    else:
        pairs = pairs.join(answers.select("x", "p", F.col("valor_final").alias("_answer")), ["x", "p"], "left")
    return pairs.select(
        F.lit(column).alias("columna"), "x", "p", F.coalesce("_answer", "p").alias("valor_final"),
        F.when(same, "igual").when(F.col("_answer").isNotNull(), "respuesta").otherwise("preferido").alias("metodo"), "genericos",
    )


def hybrid_label(xlsx: str = "x", pdf: str = "p"):  # noqa: ANN201
    """The code of one side with the name of the other; without a code the name alone."""
    code = code_of(F.col(pdf))
    return F.when(code == "", F.col(xlsx)).otherwise(F.concat(code, F.lit(" "), name_after_code(F.col(xlsx))))


def single_source(a: DataFrame, column: str, key: str = "generico") -> DataFrame:
    """Values that only one side has."""
    return a.groupBy(F.col(column).alias("valor_final")).agg(F.sort_array(F.collect_list(key)).alias("genericos")).select(F.lit(column).alias("columna"), "valor_final", F.lit("directo").alias("metodo"), "genericos")


def class_summary(a: DataFrame, column: str) -> DataFrame:
    """Items by category; the empty ones aside."""
    return a.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(F.col(column).alias("categoria")).count()


def method_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("columna", "valor_final", "metodo").agg(F.sum(F.size("genericos")).alias("n"))


def carried(target: DataFrame, source: DataFrame, columns: list[str], key: str = "generico") -> DataFrame:
    """The target with `columns` taken from the source by item; both must have the same items."""
    check_same_items(target, source, key)
    return target.drop(*columns).join(source.select(key, *columns), key).select(*target.columns, *(c for c in columns if c not in target.columns))


def carried_by_name(target: DataFrame, source: DataFrame, columns: list[str], key: str = "generico") -> DataFrame:
    """The same for items that the two sides spell in different ways: keys are compared without case, accents and punctuation, and stay as the target has them."""
    named = lambda df: df.withColumn("_item", normalized(F.col(key)))
    out = carried(named(target), named(source).drop(key), columns, "_item")
    return out.drop("_item")


def match_all(a: DataFrame, b: DataFrame, by_row: list[str], by_pair: list[str], only_a: list[str] = (), only_b: list[str] = (), prefer: str = "p", answers: DataFrame | None = None, key: str = "generico") -> DataFrame:
    """columna, valor_final, metodo, genericos of a whole match: numbers row by row, categories by pairs, columns of one side as they are.

    answers: columna, x, p, valor_final. Both extracts must have the same items.
    """
    check_same_items(a, b, key)
    parts = [match_numbers(a, b, c, prefer, key).select("columna", "valor_final", "metodo", F.array(key).alias("genericos")) for c in by_row]
    for c in by_pair:
        own = None if answers is None else answers.where(F.col("columna") == c)
        parts.append(match_categories(a, b, c, own, key).select("columna", "valor_final", "metodo", "genericos"))
    parts += [single_source(x, c, key) for x, some in ((a, only_a), (b, only_b)) for c in some]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit(resolved: DataFrame, key: str = "generico") -> DataFrame:
    """One row an item and column: what was taken, and how."""
    return resolved.select(F.explode("genericos").alias(key), "columna", "valor_final", "metodo")
