"""3 x 3 algebra on array<double> columns, row-major, as SQL text over column names.

Each result is one higher-order expression, so stages that are used many times stay
separate projections and are not copied into one another.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

_I, _J = "cast(k div 3 as int)", "cast(k % 3 as int)"


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def multiply(a: str, b: str) -> Column:
    return F.expr(f"transform(sequence(0, 8), k -> {a}[3 * {_I}] * {b}[{_J}] + {a}[3 * {_I} + 1] * {b}[{_J} + 3] + {a}[3 * {_I} + 2] * {b}[{_J} + 6])")


def apply(m: str, v: str) -> Column:
    """Matrix by column vector."""
    return F.expr(f"transform(sequence(0, 2), i -> {m}[3 * i] * {v}[0] + {m}[3 * i + 1] * {v}[1] + {m}[3 * i + 2] * {v}[2])")


def determinant(m: str) -> str:
    return f"({m}[0] * ({m}[4] * {m}[8] - {m}[5] * {m}[7]) - {m}[1] * ({m}[3] * {m}[8] - {m}[5] * {m}[6]) + {m}[2] * ({m}[3] * {m}[7] - {m}[4] * {m}[6]))"


def inverse(m: str) -> Column:
    """Adjugate by determinant; null elements where the determinant is 0."""
    at = lambda row, col: f"{m}[3 * (({_J} + {row}) % 3) + ({_I} + {col}) % 3]"
    return F.expr(f"transform(sequence(0, 8), k -> try_divide({at(1, 1)} * {at(2, 2)} - {at(1, 2)} * {at(2, 1)}, {determinant(m)}))")


def scale_columns(m: str, v: str) -> Column:
    """m by the inverse of diag(v)."""
    return F.expr(f"transform(sequence(0, 8), k -> try_divide({m}[k], {v}[{_J}]))")


def lerp(a: str, b: str, t: str) -> Column:
    """a at t <= 0, b at t >= 1."""
    return F.expr(f"case when {t} <= 0 then {a} when {t} >= 1 then {b} else zip_with({a}, {b}, (x, y) -> x + (y - x) * {t}) end")
