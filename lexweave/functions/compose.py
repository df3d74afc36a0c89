"""Unicode composition, the one text step with no Spark built-in.

Only strings that hold something to compose travel to Python; for all others the Arrow batch
carries a null.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Code points a normal form can change, or that can join the letter before them, as a few wide
# ranges: matching too much only costs a trip to Python.
_MAY_CHANGE = {
    "NFC": (
        r"[\p{M}\u0340-\u037e\u0387\u0958-\u0fff\u1100-\u11ff\u1f00-\u2001\u2126-\u212b"
        r"\u2329-\u232a\u2adc\uf900-\ufb4f\x{10000}-\x{2ffff}]"
    ),
    "NFKC": (
        r"[\p{M}\u00a0-\u00be\u0132-\u0149\u017f\u01c4-\u01f3\u02b0-\u02ff\u0340-\u0390"
        r"\u03d0-\u03ff\u0587\u0675-\u0678\u0958-\u11ff\u1d2c-\u1dbf\u1e9a-\u1e9b\u1f00-\u2011"
        r"\u2017\u2024-\u2026\u202f-\u33ff\ua69c-\ua69d\ua770\ua7f0-\ua7ff\uab5c-\uab69"
        r"\uf900-\uffff\x{10000}-\x{2ffff}]"
    ),
}


#: Characters with a compatibility form of their own, whatever follows them.
COMPATIBLE = _MAY_CHANGE["NFKC"].replace(r"\p{M}", "")


def _normalizer(form: str):
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unicodedata.normalize(form, v), na_action="ignore")

    return run


def composed(x: Column, form: str = "NFC") -> Column:
    needs = (F.octet_length(x) > F.char_length(x)) & x.rlike(_MAY_CHANGE[form])
    return F.coalesce(_normalizer(form)(F.when(needs, x)), x)


def compose(df: DataFrame, *columns: str, form: str = "NFC") -> DataFrame:
    """Bring string columns to a normal form once, at the edge of a job."""
    return df.withColumns({c: composed(F.col(c), form) for c in columns})
