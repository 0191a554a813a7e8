"""boreflow: forecasting and what-if analysis over panels of daily series, on Spark.

Every operator takes and returns a DataFrame; ``well`` is always the series key and
``ds`` the date. The long panel is ``(well, ds, param, value)``; the wide panel is
``(well, ds, <param> ...)``.
"""

__all__ = ["operators", "sources", "functions", "plans"]
