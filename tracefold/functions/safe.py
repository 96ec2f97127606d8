"""Bodies that cannot abort a job: arithmetic and casts on a row's values give null where they would raise."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

# Spark's names of expressions that raise by their evaluation mode, and of lookups that raise when nothing is there.
RAISING = {"Add", "Subtract", "Multiply", "Divide", "IntegralDivide", "Remainder", "Pmod", "UnaryMinus", "Abs", "Cast", "Round", "BRound", "Conv"}
LOOKUPS = {"ElementAt", "GetArrayItem", "Elt"}


class SafeColumn(ClassicColumn):
    """A column whose operators are the ``try_`` forms: overflow, division by zero and unfit casts become null."""

    def __new__(cls, column: Column):
        return object.__new__(cls)

    def __init__(self, column: Column):
        super().__init__(column._jc)

    def __getitem__(self, k):
        return SafeColumn(super().__getitem__(k))

    def getField(self, name):
        return SafeColumn(super().getField(name))

    def cast(self, dataType):
        return SafeColumn(self.try_cast(dataType))

    astype = cast

    def __add__(self, other):
        return SafeColumn(F.try_add(self, _column(other)))

    def __radd__(self, other):
        return SafeColumn(F.try_add(_column(other), self))

    def __sub__(self, other):
        return SafeColumn(F.try_subtract(self, _column(other)))

    def __rsub__(self, other):
        return SafeColumn(F.try_subtract(_column(other), self))

    def __mul__(self, other):
        return SafeColumn(F.try_multiply(self, _column(other)))

    def __rmul__(self, other):
        return SafeColumn(F.try_multiply(_column(other), self))

    def __truediv__(self, other):
        return SafeColumn(F.try_divide(self, _column(other)))

    def __rtruediv__(self, other):
        return SafeColumn(F.try_divide(_column(other), self))

    def __mod__(self, other):
        return SafeColumn(F.try_mod(self, _column(other)))

    def __rmod__(self, other):
        return SafeColumn(F.try_mod(_column(other), self))

    def __neg__(self):
        return SafeColumn(F.try_subtract(F.lit(0), self))


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def raising(df: DataFrame) -> list[str]:
    """The expressions in the plan's last projection that could raise on some row, as text."""
    found: list[str] = []
    casts = df.sparkSession.sparkContext._jvm.org.apache.spark.sql.catalyst.expressions.Cast

    def walk(e) -> None:
        kind = e.getClass().getSimpleName()
        if kind in ("TryEval", "TryElementAt"):
            return
        strict = kind in RAISING | LOOKUPS and _strict(e) and not _harmless(e, kind, casts)
        if strict or kind == "RaiseError":
            found.append(e.toString())
        children = e.children()
        for i in range(children.size()):
            walk(children.apply(i))

    expressions = df._jdf.queryExecution().analyzed().expressions()
    for i in range(expressions.size()):
        walk(expressions.apply(i))
    return found


def _strict(e) -> bool:
    """Whether the expression was made to raise, which some kinds call a mode and some a flag."""
    try:
        return e.evalMode().toString() == "ANSI"
    except Py4JError:
        pass
    try:
        return bool(e.failOnError())
    except Py4JError:
        return False


def _harmless(e, kind: str, casts) -> bool:
    if kind == "Cast":
        source = e.child().dataType()
        return casts.canUpCast(source, e.dataType()) or e.dataType().typeName() == "string"
    floating = e.dataType().typeName() in ("float", "double")
    return floating and kind in ("Add", "Subtract", "Multiply", "UnaryMinus", "Abs", "Round", "BRound")
