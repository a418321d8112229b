"""Wide genotype tables: one line an individual, one column a marker, read without a plan that grows with the columns."""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Cells of a batch of long rows; the byte-order mark that may begin a file.
CELLS, MARK = 1 << 17, "\ufeff"


def split_line(line: str) -> list[str]:
    """The fields of one CSV line; quoted ones may hold commas and doubled quotes, not line breaks."""
    return next(csv.reader([line])) if '"' in line else line.split(",")


def numbers(cells: list[str]) -> np.ndarray:
    """The cells as doubles; NaN where a cell is no number."""
    try:
        return np.array(cells, np.float64)
    except ValueError:
        pass
    out = np.full(len(cells), np.nan)
    for k, cell in enumerate(cells):
        try:
            out[k] = float(cell) if "_" not in cell else np.nan
        except ValueError:
            pass
    return out


class WideTable:
    """A CSV file, or a folder of files with one header each. Columns by place: id, population, markers, and ``phenotypes``
    traits at the end.

    A line travels as one string and is split in Arrow batches; the markers' names come from the header and are sent to the
    tasks, so the plan is the same for ten columns and for a million. A cell that is no number is null; short lines are filled
    up with nulls, surplus fields are dropped, empty lines too; every line that equals the header is one. Repeated
    individuals and names stay as they are; a table without lines gives no rows. A task holds the lines of its split.
    """

    def __init__(self, spark: SparkSession, path: str, phenotypes: int):
        self.lines = spark.read.text(path)
        first = self.lines.first()
        self.header = first.value.removeprefix(MARK) if first else ""
        names = split_line(self.header)
        self.cut = max(2, len(names) - phenotypes)
        self.markers, self.traits = names[2 : self.cut], names[self.cut :]
        self.held = spark.sparkContext.broadcast((self.header, names))

    def _parsed(self, begin: int, end: int, rows: Callable, schema: str) -> DataFrame:
        """``rows(id, population, values of the columns from begin to end, their names)`` of every line, as Arrow batches."""
        held = self.held

        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            header, names = held.value
            mine, out, count = pa.array(names[begin:end], pa.string()), [], 0
            for batch in batches:
                for line in batch.column(0).to_pylist():
                    line = line.removeprefix(MARK)
                    if not line or line == header:
                        continue
                    cells = split_line(line)
                    cells += [""] * (len(names) - len(cells))
                    out.append(rows(cells[0] or None, cells[1] or None, numbers(cells[begin:end]), mine))
                    count += end - begin
                    if count >= CELLS:
                        yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                        out, count = [], 0
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

        return self.lines.mapInArrow(parse, schema)

    def _long(self, begin: int, end: int, key: str, value: str) -> DataFrame:
        def rows(name, population, values, names):
            n = len(values)
            columns = [pa.repeat(pa.scalar(name, pa.string()), n), pa.repeat(pa.scalar(population, pa.string()), n), names, pa.array(np.arange(n, dtype=np.int32)), pa.array(values, mask=np.isnan(values))]
            return pa.RecordBatch.from_arrays(columns, ["id", "population", key, "pos", value])

        return self._parsed(begin, end, rows, f"id string, population string, {key} string, pos int, {value} double")

    def genotypes(self) -> DataFrame:
        """id, population, marker, pos, dosage: a row a cell."""
        return self._long(2, self.cut, "marker", "dosage")

    def phenotypes(self) -> DataFrame:
        """id, population, phenotype, y."""
        return self._long(self.cut, self.cut + len(self.traits), "phenotype", "y").drop("pos")

    def vectors(self) -> DataFrame:
        """id, population, x: a row an individual, its dosages in the markers' order. What the solvers take, without a shuffle."""

        def rows(name, population, values, _):
            x = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, mask=np.isnan(values)))
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([population], pa.string()), x], ["id", "population", "x"])

        return self._parsed(2, self.cut, rows, "id string, population string, x array<double>")
