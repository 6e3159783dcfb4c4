"""row-wise features on the merged mart (one projection, no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import config as C
from ..functions import expr as X
from . import clean as CL


def feature_engineering(df: DataFrame, *, keys=C.KEYS, sentinel=C.DAYS_SENTINEL,
                        guarded=C.GUARDED_RATIOS, years=C.YEAR_FEATURES,
                        plain=C.PLAIN_RATIOS, mean_median=("EXT_SOURCE_MEAN",
                                                           "EXT_SOURCE_MEDIAN",
                                                           C.EXT_SOURCE_COLUMNS),
                        sums=(("FLAG_DOCUMENT_SUM", C.FLAG_DOCUMENT_COLUMNS),
                              ("FLAG_PHONE_SUM", C.FLAG_PHONE_COLUMNS))) -> DataFrame:
    """Sentinel -> NULL on every numeric non-key column, then the derived columns.

    ``guarded``/``plain``: (name, numerator, denominator); ``years``: (name, days);
    ``mean_median``: (mean name, median name, columns); ``sums``: (name, columns).
    """
    df = CL.sentinel_to_null_frame(df, sentinel=sentinel, keep=keys)
    new = {}
    for name, a, b in guarded:
        new[name] = X.guarded_ratio(a, b)
    for name, d in years:
        new[name] = X.days_to_years(d)
    for name, a, b in plain:
        new[name] = X.plain_ratio(a, b)
    if mean_median:
        mean_name, median_name, cols = mean_median
        new[mean_name] = X.row_mean(cols)
        new[median_name] = X.row_median(cols)
    for name, cols in sums:
        new[name] = X.row_sum(cols)
    return df.withColumns(new)
