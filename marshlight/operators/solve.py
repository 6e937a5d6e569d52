"""Small symmetric systems solved in columns: Cholesky factors and substitutions as folds over arrays.

A matrix is an array of rows, lower factors hold only the part up to the diagonal. One row of a table is
one system, so many keys are solved by the tasks that hold them, without a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ROW, _ROWS = "array<double>", "array<array<double>>"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def cholesky(matrix: Column) -> Column:
    """Lower factor of a positive definite matrix, row by row; entry j of a row uses the rows above and what the row has so far."""

    def entry(done: Column, row: Column, a: Column) -> Column:
        j = F.size(row)
        above = F.get(done, j)
        beside = (a - dot(row, F.slice(above, F.lit(1), j))) / F.get(above, j)
        return F.when(j < F.size(done), beside).otherwise(F.sqrt(a - dot(row, row)))

    def add_row(done: Column, wanted: Column) -> Column:
        part = F.slice(wanted, F.lit(1), F.size(done) + 1)
        row = F.aggregate(part, F.array().cast(_ROW), lambda row, a: F.array_append(row, entry(done, row, a)))
        return F.array_append(done, row)

    return F.aggregate(matrix, F.array().cast(_ROWS), add_row)


def forward(factor: Column, right: Column) -> Column:
    """z of L z = right."""

    def entry(z: Column, b: Column) -> Column:
        row = F.get(factor, F.size(z))
        return (b - dot(z, F.slice(row, F.lit(1), F.size(z)))) / F.get(row, F.size(z))

    return F.aggregate(right, F.array().cast(_ROW), lambda z, b: F.array_append(z, entry(z, b)))


def backward(factor: Column, z: Column) -> Column:
    """w of L' w = z; from the last entry to the first."""
    n = F.size(z)

    def entry(w: Column, i: Column) -> Column:
        below = F.transform(F.slice(factor, i + 2, n), lambda row: F.get(row, i))
        return (F.get(z, i) - dot(below, w)) / F.get(F.get(factor, i), i)

    places = F.sequence(n - 1, F.lit(0), F.lit(-1))
    return F.aggregate(places, F.array().cast(_ROW), lambda w, i: F.concat(F.array(entry(w, i)), w))
