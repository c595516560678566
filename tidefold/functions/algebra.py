"""One declaration of a model's equations for Spark columns, NumPy arrays, LaTeX text and exact derivatives.

A model calls the functions of a namespace (tanh, sin, ...) and ordinary operators on its arguments; what the arguments
are decides what comes out. Dual carries a value with its partial derivatives over any of the other kinds.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

NUMPY = SimpleNamespace(tanh=np.tanh, sin=np.sin, cos=np.cos, exp=np.exp, log=np.log, sqrt=np.sqrt, abs=np.abs, max=np.maximum, sign=np.sign, where_greater=lambda a, b, yes, no: np.where(a > b, yes, no))
COLUMNS = SimpleNamespace(
    tanh=F.tanh, sin=F.sin, cos=F.cos, exp=F.exp, log=F.log, sqrt=F.sqrt, abs=F.abs, sign=F.signum,
    max=lambda a, b: F.greatest(a, F.lit(b) if isinstance(b, (int, float)) else b),
    where_greater=lambda a, b, yes, no: F.when(a > b, yes).otherwise(no),
)


class Dual:
    """value and its derivatives by each of some variables; a derivative may be the number 0."""

    __slots__ = ("value", "slopes")

    def __init__(self, value, slopes):
        self.value, self.slopes = value, slopes

    def _with(self, value, factor):
        return Dual(value, [0 if _zero(s) else s * factor for s in self.slopes])

    def __add__(self, other):
        if not isinstance(other, Dual):
            return Dual(self.value + other, self.slopes)
        return Dual(self.value + other.value, [_plus(a, b) for a, b in zip(self.slopes, other.slopes, strict=True)])

    __radd__ = __add__

    def __neg__(self):
        return self._with(-self.value, -1.0)

    def __sub__(self, other):
        return self + (-other)

    def __rsub__(self, other):
        return -self + other

    def __mul__(self, other):
        if not isinstance(other, Dual):
            return self._with(self.value * other, other)
        return Dual(self.value * other.value, [_plus(0 if _zero(a) else a * other.value, 0 if _zero(b) else b * self.value) for a, b in zip(self.slopes, other.slopes, strict=True)])

    __rmul__ = __mul__

    def __truediv__(self, other):
        if not isinstance(other, Dual):
            return self * (1.0 / other)
        return self * other._with(1.0 / other.value, -1.0 / (other.value * other.value))

    def __rtruediv__(self, other):
        return self._with(other / self.value, -other / (self.value * self.value))


def _zero(x) -> bool:
    return isinstance(x, (int, float)) and x == 0


def _plus(a, b):
    return b if _zero(a) else a if _zero(b) else a + b


def derivatives(fn) -> SimpleNamespace:
    """The functions of fn on Dual arguments (plain arguments pass through)."""

    def lifted(value, slope):
        return lambda x: x._with(value(x.value), slope(x.value)) if isinstance(x, Dual) else value(x)

    def larger(a, b):
        """The larger of a Dual and a number: where the number is larger the slope is 0."""
        if not isinstance(a, Dual):
            return fn.max(a, b)
        return Dual(fn.max(a.value, b), [0 if _zero(s) else fn.where_greater(a.value, b, s, 0.0 * s) for s in a.slopes])

    return SimpleNamespace(
        tanh=lifted(fn.tanh, lambda v: 1.0 - fn.tanh(v) * fn.tanh(v)), sin=lifted(fn.sin, fn.cos), cos=lifted(fn.cos, lambda v: -fn.sin(v)),
        exp=lifted(fn.exp, fn.exp), log=lifted(fn.log, lambda v: 1.0 / v), sqrt=lifted(fn.sqrt, lambda v: 0.5 / fn.sqrt(v)), abs=lifted(fn.abs, fn.sign), max=larger,
    )


class Latex:
    """Text of a formula; level is the binding strength of its last operator."""

    def __init__(self, text: str, level: int = 3):
        self.text, self.level = text, level

    @staticmethod
    def of(x) -> Latex:
        return x if isinstance(x, Latex) else Latex(f"{x:g}")

    def _inside(self, level: int) -> str:
        return self.text if self.level >= level else rf"\left({self.text}\right)"

    def __add__(self, other):
        other = Latex.of(other)
        return Latex(f"{self.text} + {other.text}", 1)

    def __radd__(self, other):
        return Latex.of(other) + self

    def __sub__(self, other):
        return Latex(f"{self.text} - {Latex.of(other)._inside(2)}", 1)

    def __rsub__(self, other):
        return Latex.of(other) - self

    def __mul__(self, other):
        return Latex(f"{self._inside(2)} {Latex.of(other)._inside(2)}", 2)

    def __rmul__(self, other):
        return Latex.of(other) * self

    def __truediv__(self, other):
        return Latex(rf"\frac{{{self.text}}}{{{Latex.of(other).text}}}")

    def __rtruediv__(self, other):
        return Latex.of(other) / self

    def __neg__(self):
        return Latex(f"-{self._inside(2)}", 1)


def _called(name: str):
    return lambda x: Latex(rf"{name}\left({x.text}\right)")


LATEX = SimpleNamespace(
    tanh=_called(r"\tanh"), sin=_called(r"\sin"), cos=_called(r"\cos"), exp=_called(r"\exp"), log=_called(r"\ln"),
    sqrt=lambda x: Latex(rf"\sqrt{{{x.text}}}"), abs=lambda x: Latex(rf"\left|{x.text}\right|"), max=lambda a, b: Latex(rf"\max\left({a.text}, {Latex.of(b).text}\right)"),
)
