"""Whether a text proves an amount: written out in it, or the sum of amounts in it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_VALUES = 40


def written(text: Column, value: Column) -> Column:
    """The amount stands in the text in one of its usual spellings, not as part of a longer number."""
    plain = F.format_string("%.2f", value)
    grouped = F.format_number(value, 2)
    spellings = [plain, F.replace(plain, F.lit("."), F.lit(",")), grouped, F.replace(grouped, F.lit(","), F.lit(" ")), F.translate(grouped, ",.", ".,"), F.replace(F.translate(grouped, ",.", " ,"), F.lit(" "), F.lit(" "))]
    found = F.lit(False)
    for s in spellings:
        found = found | F.concat(F.lit(" "), F.regexp_replace(text, r"[^0-9.,  ]", " "), F.lit(" ")).contains(F.concat(F.lit(" "), s, F.lit(" ")))
    return found


@F.pandas_udf(T.BooleanType())
def is_sum_of(values: pd.Series, target: pd.Series) -> pd.Series:
    """Two or more of the (at most 40 smallest) amounts add up to the target, within 1.00 or half a percent. Distinct sums of cents up to the target are kept."""

    def one(amounts, wanted) -> bool:
        if amounts is None or wanted is None or not np.isfinite(wanted) or wanted <= 0:
            return False
        goal, slack = round(wanted * 100), round(max(1.0, wanted * 0.005) * 100)
        cents = sorted(c for c in (round(float(a) * 100) for a in amounts if a is not None and np.isfinite(a)) if 0 < c <= goal + slack)[:MOST_VALUES]
        once, more, top = np.zeros(0, np.int64), np.zeros(0, np.int64), goal + slack  # sums of exactly one value, of two or more
        for c in cents:
            sums = np.concatenate([more, more + c, once + c])
            more, once = np.unique(sums[sums <= top]), np.append(once, c)
        return bool(len(more)) and bool(more[-1] >= goal - slack)

    return pd.Series([one(a, t) for a, t in zip(values, target, strict=True)])
