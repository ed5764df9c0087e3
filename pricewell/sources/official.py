"""Official figures from an HTTP source that answers JSON; every indicator is fetched once."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigurationProblem, ResponseInvalid, SourceUnavailable

ANSWER = "struct<Series: array<struct<OBSERVATIONS: array<struct<TIME_PERIOD: string, OBS_VALUE: string>>>>>"
#: Fixed value: seconds to wait for an answer.
TIMEOUT = 10.0


def http(url: Callable[[str], str], timeout: float = TIMEOUT) -> Callable[[str], str]:
    """A fetch by GET. `url` makes an address of an indicator; neither it nor a token in it appears in errors."""
    if not isinstance(timeout, int | float) or isinstance(timeout, bool) or timeout <= 0:
        raise ConfigurationProblem("the timeout must be a positive number")

    def fetch(indicator: str) -> str:
        try:
            with urllib.request.urlopen(url(indicator), timeout=timeout) as answer:
                return answer.read().decode()
        except (urllib.error.URLError, TimeoutError, OSError):
            raise SourceUnavailable(f"indicator {indicator} can't be fetched") from None

    return fetch


def observations(answers: DataFrame, periodicity: str) -> DataFrame:
    """tipo, indice, ord, oficial of answers (tipo, indice, body: the JSON) for every period from an indicator's first to its last; null where it has a gap."""
    parsed = answers.withColumn("a", F.from_json("body", ANSWER))
    if parsed.where("a is null or a.Series is null or size(a.Series) = 0 or a.Series[0].OBSERVATIONS is null").limit(1).count():
        raise ResponseInvalid("an answer has no observations")
    seen = parsed.select("tipo", "indice", F.explode(F.col("a.Series")[0]["OBSERVATIONS"]).alias("o"))
    part = F.split("o.TIME_PERIOD", "/")
    number = lambda k: F.get(part, F.lit(k)).try_cast("int")
    ord_ = number(0) * 24 + (number(1) - 1) * 2 + number(2) - 1 if periodicity == "Q" else number(0) * 12 + number(1) - 1
    seen = seen.select("tipo", "indice", F.when(F.size(part) == (3 if periodicity == "Q" else 2), ord_).alias("ord"), F.col("o.OBS_VALUE").try_cast("double").alias("oficial"))
    if seen.where("ord is null").limit(1).count():
        raise ResponseInvalid(f"a period is not of periodicity {periodicity}")
    spine = seen.groupBy("tipo", "indice").agg(F.min("ord").alias("a"), F.max("ord").alias("z")).select("tipo", "indice", F.explode(F.sequence("a", "z")).alias("ord"))
    return spine.join(seen, ["tipo", "indice", "ord"], "left")


class _Source:
    """What sources of official figures share: history() is theirs."""

    def at(self, periods: DataFrame, periodicity: str, measure: str) -> DataFrame:
        """The figures of `periods` (ord) that lie within an indicator's range; what is later than the last published is out of range, not a gap."""
        return self.history(periodicity, measure).join(F.broadcast(periods.select("ord").distinct()), "ord", "left_semi")

    def history(self, periodicity: str, measure: str) -> DataFrame:
        raise NotImplementedError

    def _names(self, periodicity: str, measure: str) -> list[str]:
        raise NotImplementedError

    def table(self, periodicity: str, measure: str) -> DataFrame:
        """One row a period, one column an indicator."""
        return self.history(periodicity, measure).groupBy("ord").pivot("indice", self._names(periodicity, measure)).agg(F.first("oficial")).orderBy("ord")


class Official(_Source):
    """Figures of indicators; `catalogue` maps (periodicity, measure) to {(tipo, indice): indicator}, fetch returns an indicator's JSON."""

    def __init__(self, spark: SparkSession, fetch: Callable[[str], str], catalogue: dict[tuple[str, str], dict[tuple[str, str], str]]) -> None:
        self._spark, self._fetch, self._catalogue = spark, fetch, catalogue
        self._answers: dict[str, str] = {}

    def __len__(self) -> int:
        return len(self._answers)

    def clear(self) -> None:
        self._answers.clear()

    def _answer(self, indicator: str) -> str:
        if indicator not in self._answers:
            text = self._fetch(indicator)
            try:
                json.loads(text)
            except ValueError:
                raise ResponseInvalid(f"indicator {indicator} has no JSON answer") from None
            self._answers[indicator] = text
        return self._answers[indicator]

    def history(self, periodicity: str, measure: str) -> DataFrame:
        own = self._catalogue.get((periodicity, measure))
        if not own:
            raise ConfigurationProblem(f"no indicators for {measure} by {periodicity}")
        rows = [(kind, index, self._answer(i)) for (kind, index), i in own.items()]  # a few dozen indicators
        return observations(self._spark.createDataFrame(rows, "tipo string, indice string, body string"), periodicity)

    def _names(self, periodicity: str, measure: str) -> list[str]:
        return sorted({i for _, i in self._catalogue[periodicity, measure]})


class Archive(_Source):
    """The same figures from answers that were kept in files, which Spark reads: nothing of them passes through the driver.

    answers: indicador and body, such as a folder of JSON lines; catalogue: periodicidad, medida, tipo, indice, indicador.
    """

    def __init__(self, answers: DataFrame, catalogue: DataFrame) -> None:
        self._answers, self._catalogue = answers, catalogue

    def history(self, periodicity: str, measure: str) -> DataFrame:
        own = self._catalogue.where((F.col("periodicidad") == periodicity) & (F.col("medida") == measure))
        lacking = own.join(self._answers.select("indicador"), "indicador", "left_anti").limit(1).collect()
        if lacking:
            raise SourceUnavailable(f"indicator {lacking[0].indicador} has no answer")
        if not own.limit(1).count():
            raise ConfigurationProblem(f"no indicators for {measure} by {periodicity}")
        return observations(own.join(self._answers, "indicador").select("tipo", "indice", "body"), periodicity)

    def _names(self, periodicity: str, measure: str) -> list[str]:
        own = self._catalogue.where((F.col("periodicidad") == periodicity) & (F.col("medida") == measure))
        return [r.indice for r in own.select("indice").distinct().orderBy("indice").collect()]  # columns of a table
