"""Interval formulas as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def rate(hits: Column, total: Column) -> Column:
    """hits / total, null for an empty denominator."""
    return F.when(total > 0, hits / total)


def wilson(hits: Column, total: Column, z: float = Z) -> tuple[Column, Column]:
    """Wilson score interval (low, high) of a proportion; null without trials."""
    p, z2 = hits / total, z * z
    centre = (p + z2 / (2 * total)) / (1 + z2 / total)
    half = z * F.sqrt(p * (1 - p) / total + z2 / (4 * total * total)) / (1 + z2 / total)
    return F.when(total > 0, centre - half), F.when(total > 0, centre + half)


def diff_ci(h1: Column, n1: Column, h2: Column, n2: Column, z: float = Z) -> tuple[Column, Column, Column]:
    """(difference, low, high) of the proportions h1/n1 - h2/n2 by the normal approximation."""
    p1, p2 = h1 / n1, h2 / n2
    half = z * F.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)
    return p1 - p2, p1 - p2 - half, p1 - p2 + half
