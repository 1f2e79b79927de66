"""Column expressions for numbers: bins, scores, thermodynamics, labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Fixed value: the gas constant in J/(mol K) and joules per kilocalorie.
GAS, KCAL = 8.314459848, 4184.0


def rt(celsius: float = 4.0) -> float:
    """RT in kcal/mol."""
    return (celsius + 273.15) * GAS / KCAL


def kd_to_kcal(kd_nm: Column, celsius: float = 4.0) -> Column:
    return F.log(kd_nm / 1e9) * rt(celsius)


def kcal_to_kd(energy: Column, celsius: float = 4.0) -> Column:
    return F.exp(energy / rt(celsius)) * 1e9


def accessibility(energy: Column, scale: float = 1.0, celsius: float = 37.0) -> Column:
    return F.exp(-energy * scale / rt(celsius))


def occupancy(z: Column, conc: Column | float) -> Column:
    """Z c / (Z c + 1)."""
    c = conc if isinstance(conc, Column) else F.lit(float(conc))
    return z * c / (z * c + 1)


def logistic(intercept: float, terms: list[tuple[float, Column]]) -> Column:
    """1 / (1 + exp(-(b0 + b1 x1 + ...))): null if any feature is."""
    total = F.lit(float(intercept))
    for b, x in terms:
        total = total + F.lit(float(b)) * x.cast("double")
    return 1 / (1 + F.exp(-total))


def z_score(value: Column, *by: str) -> Column:
    w = Window.partitionBy(*by)
    return (value - F.avg(value).over(w)) / F.stddev_pop(value).over(w)


def share_of_total(value: Column, *by: str) -> Column:
    return value / F.sum(value).over(Window.partitionBy(*by))


def equal_bin(value: Column, low: float, high: float, n: int) -> Column:
    """Bin 0 to n - 1 of equal widths; values outside go to the first or last."""
    return F.least(F.greatest(F.floor((value - low) / ((high - low) / n)), F.lit(0)), F.lit(n - 1)).cast("int")


def edge_bin(value: Column, edges: list[float], right: bool = False) -> Column:
    """The number of edges that are below the value (at most it, unless ``right``)."""
    total = F.lit(0)
    for e in edges:
        total = total + F.when(value > e if right else value >= e, 1).otherwise(0)
    return F.when(value.isNotNull(), total)


def rounded(value: Column, digits: Column) -> Column:
    """Rounded to a number of digits that may differ by row."""
    factor = F.pow(F.lit(10.0), digits)
    return F.round(value * factor) / factor


def error_digits(error: Column) -> Column:
    """How many digits an error leaves to tell: up to its first two significant ones."""
    return F.when(error > 0, F.greatest(F.lit(0), F.lit(1) - F.floor(F.log10(error)))).otherwise(F.lit(6)).cast("int")


def range_label(value: Column, cuts: list[tuple[float, str]], rest: str, missing: str = "NA") -> Column:
    """The label of the first cut that the value reaches (cuts descend); ``rest`` below all, ``missing`` for null."""
    out = F.when(value.isNull(), missing)
    for cut, label in cuts:
        out = out.when(value >= cut, label)
    return out.otherwise(rest)


def p_stars(p: Column) -> Column:
    return range_label(-p, [(-0.0001, "****"), (-0.001, "***"), (-0.01, "**"), (-0.05, "*")], "n.s.")


def concentration(nm: Column) -> Column:
    """A concentration in nM with the unit that suits it."""
    cases = [(1e6, 1e-6, " mM"), (1e3, 1e-3, " uM"), (1.0, 1.0, " nM")]
    out = F.when(nm.isNull(), "NA")
    for cut, factor, unit in cases:
        out = out.when(nm >= cut, F.concat(F.format_number(nm * factor, 1), F.lit(unit)))
    return out.otherwise(F.concat(F.format_number(nm * 1e3, 1), F.lit(" pM")))


def domain_class(domains: Column, separator: str = ",") -> Column:
    """The domain type if all are one, else mixed."""
    kinds = F.array_distinct(F.transform(F.split(domains, separator), lambda x: F.trim(x)))
    return F.when(F.size(kinds) == 1, kinds[0]).otherwise("mixed")


def boltzmann(energy: Column, conc: float) -> Column:
    """The weight of a state with a binding energy in RT at a concentration in nM."""
    return F.exp(-energy + float(np.log(conc * 1e-9)))


def trailing_slope(value: Column, at: Column, order: list, n: int, *by: str) -> Column:
    """The slope of a linear fit over the last ``n`` rows of each group; null where there are fewer."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(w) == n, F.regr_slope(value, at).over(w))
