"""SQL-callable table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from guilloche.schemas import DIGIT_FROM, DIGIT_TO, KNOWN_DENOMINATIONS, LEADING_FIX


@udtf(returnType="nth int, denom string")
class DenomCandidates:
    """``SELECT * FROM tokens, LATERAL denom_candidates(text)``: what ``denomination.candidates`` does, for SQL users."""

    def eval(self, text: str):
        fixed = (text or "").translate(str.maketrans(DIGIT_FROM, DIGIT_TO))
        if fixed.isascii() and fixed.isdigit():
            ways = [fixed, *(o + fixed[1:] for o in LEADING_FIX.get(fixed[0], ())), fixed[1:]]
            for nth, denom in enumerate(dict.fromkeys(w for w in ways if w in KNOWN_DENOMINATIONS)):
                yield nth, denom


def register(spark: SparkSession) -> None:
    spark.udtf.register("denom_candidates", DenomCandidates)
