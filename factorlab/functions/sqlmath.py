"""Matrix algebra as SQL: each operation is a common table expression of (i, j, v), counted from 0.

The update steps of the solvers are written in operators (@, *, /, ..) and run on NumPy arrays or on these matrices, which
write a DuckDB query as they go. A fit of a fixed number of iterations is so a plain SQL statement.
"""

from __future__ import annotations

import numpy as np


class Program:
    """A growing list of common table expressions."""

    def __init__(self, head: str = ""):
        self.head, self.steps = head, []

    def add(self, sql: str, shape: tuple[int, int]) -> Matrix:
        name = f"m{len(self.steps)}"
        self.steps.append(f"{name} AS MATERIALIZED ({sql})")
        return Matrix(self, name, shape)

    def source(self, sql: str, shape: tuple[int, int]) -> Matrix:
        """A dense matrix given by SQL that returns i, j, v."""
        return self.add(sql, shape)

    def const(self, array) -> Matrix:
        array = np.atleast_2d(np.asarray(array, float))
        rows = ", ".join(f"({i}, {j}, CAST({float(v)!r} AS DOUBLE))" for i, line in enumerate(array) for j, v in enumerate(line))
        return self.add(f"SELECT i::BIGINT AS i, j::BIGINT AS j, v FROM (VALUES {rows}) AS t(i, j, v)", array.shape)

    def select(self, sql: str) -> str:
        """The whole statement, ending in sql."""
        return f"WITH {self.head}{', ' if self.head else ''}{', '.join(self.steps)} {sql}"

    pos = staticmethod(lambda x: x.map("greatest(v, 0.0)"))
    log = staticmethod(lambda x: x.map("ln(v)"))
    power = staticmethod(lambda x, p: x.map(f"pow(v, {float(p)!r})"))
    done = staticmethod(lambda *xs: xs)

    @staticmethod
    def sum(x: Matrix, axis=None) -> Matrix:
        i, j = ("0" if axis in (None, 0) else "i"), ("0" if axis in (None, 1) else "j")
        shape = (1 if axis in (None, 0) else x.shape[0], 1 if axis in (None, 1) else x.shape[1])
        return x.program.add(f"SELECT {i}::BIGINT AS i, {j}::BIGINT AS j, sum(v) AS v FROM {x.name} GROUP BY ALL", shape)


class Matrix:
    """One expression of a program."""

    def __init__(self, program: Program, name: str, shape: tuple[int, int]):
        self.program, self.name, self.shape = program, name, tuple(shape)

    def map(self, expression: str) -> Matrix:
        return self.program.add(f"SELECT i, j, {expression} AS v FROM {self.name}", self.shape)

    @property
    def T(self) -> Matrix:  # noqa: N802
        return self.program.add(f"SELECT j AS i, i AS j, v FROM {self.name}", self.shape[::-1])

    def __matmul__(self, other: Matrix) -> Matrix:
        if self.shape[1] != other.shape[0]:
            raise ValueError(f"shapes {self.shape} and {other.shape}")
        return self.program.add(f"SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {self.name} a JOIN {other.name} b ON a.j = b.i GROUP BY a.i, b.j", (self.shape[0], other.shape[1]))

    def _with(self, other, op: str, swapped: bool = False) -> Matrix:
        if not isinstance(other, Matrix):
            number = repr(float(other))
            return self.map(f"{number} {op} v" if swapped else f"v {op} {number}")
        shape = tuple(max(a, b) for a, b in zip(self.shape, other.shape, strict=True))
        keep = lambda axis: "a" if self.shape[axis] == shape[axis] else "b"
        on = [f"a.{x} = b.{x}" for k, x in enumerate("ij") if self.shape[k] == other.shape[k]]
        return self.program.add(f"SELECT {keep(0)}.i, {keep(1)}.j, a.v {op} b.v AS v FROM {self.name} a JOIN {other.name} b ON {' AND '.join(on) or 'true'}", shape)

    def __add__(self, other):
        return self._with(other, "+")

    def __radd__(self, other):
        return self._with(other, "+", True)

    def __sub__(self, other):
        return self._with(other, "-")

    def __rsub__(self, other):
        return self._with(other, "-", True)

    def __mul__(self, other):
        return self._with(other, "*")

    def __rmul__(self, other):
        return self._with(other, "*", True)

    def __truediv__(self, other):
        return self._with(other, "/")

    def __neg__(self):
        return self.map("-v")
