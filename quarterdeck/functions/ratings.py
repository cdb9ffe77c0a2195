"""Rating letters and their ordinals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordinals of the two letter scales, 1 the best, 22 default.
RATING_ORDINALS = {
    "AAA": 1, "AA+": 2, "AA": 3, "AA-": 4, "A+": 5, "A": 6, "A-": 7, "BBB+": 8, "BBB": 9, "BBB-": 10, "BB+": 11, "BB": 12, "BB-": 13,
    "B+": 14, "B": 15, "B-": 16, "CCC+": 17, "CCC": 18, "CCC-": 19, "CC": 20, "C": 21, "D": 22, "SD": 22, "RD": 22,
    "Aaa": 1, "Aa1": 2, "Aa2": 3, "Aa3": 4, "A1": 5, "A2": 6, "A3": 7, "Baa1": 8, "Baa2": 9, "Baa3": 10, "Ba1": 11, "Ba2": 12, "Ba3": 13,
    "B1": 14, "B2": 15, "B3": 16, "Caa1": 17, "Caa2": 18, "Caa3": 19, "Ca": 20, "Ca-": 20,
}
BEST, WORST = 1, 22


def rating_ordinal(letters: Column) -> Column:
    """Ordinal of rating letters (case-sensitive, outer blanks ignored); NULL for anything else."""
    table = F.create_map(*(F.lit(x) for pair in RATING_ORDINALS.items() for x in pair))
    return F.try_element_at(table, F.trim(letters))
