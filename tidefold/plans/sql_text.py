"""DuckDB SQL of filters and simulations, as an independent check of the engine: recursive queries over (series, k).

A model's equations come as text through the same declaration; the filters' algebra is written out here on its own.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np

from tidefold.functions.algebra import Dual
from tidefold.operators import sigma
from tidefold.operators.kernels import factor
from tidefold.plans.models import Model


def num(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


class Text:
    """An SQL expression."""

    def __init__(self, text: str):
        self.text = text

    @staticmethod
    def of(x) -> Text:
        return x if isinstance(x, Text) else Text(num(x))

    def __add__(self, o):
        return Text(f"({self.text} + {Text.of(o).text})")

    def __radd__(self, o):
        return Text.of(o) + self

    def __sub__(self, o):
        return Text(f"({self.text} - {Text.of(o).text})")

    def __rsub__(self, o):
        return Text.of(o) - self

    def __mul__(self, o):
        return Text(f"({self.text} * {Text.of(o).text})")

    def __rmul__(self, o):
        return Text.of(o) * self

    def __truediv__(self, o):
        return Text(f"({self.text} / {Text.of(o).text})")

    def __rtruediv__(self, o):
        return Text.of(o) / self

    def __neg__(self):
        return Text(f"(-{self.text})")


def _call(name):
    return lambda x: Text(f"{name}({Text.of(x).text})")


SQL = SimpleNamespace(
    tanh=_call("tanh"), sin=_call("sin"), cos=_call("cos"), exp=_call("exp"), log=_call("ln"), sqrt=_call("sqrt"), abs=_call("abs"), sign=lambda x: Text(f"CAST(sign({x.text}) AS DOUBLE)"),
    max=lambda a, b: Text(f"greatest({Text.of(a).text}, {Text.of(b).text})"), where_greater=lambda a, b, yes, no: Text(f"CASE WHEN {Text.of(a).text} > {Text.of(b).text} THEN {Text.of(yes).text} ELSE {Text.of(no).text} END"),
)


def _sum(parts: list[str]) -> str:
    return "(" + " + ".join(parts) + ")" if parts else num(0)


def _level(inner: str, columns: dict[str, str]) -> str:
    return f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM ({inner})"


def start(model: Model) -> dict[str, str]:
    """Columns x_i and p_i_j of the first estimate, from y_i."""
    k, d = model.dim_x, model.dim_y
    cross, own = model.prior[:k, k:], model.prior[k:, k:]
    gain = cross @ np.linalg.pinv(own)
    p = model.prior[:k, :k] - gain @ cross.T
    out = {f"x_{i}": _sum([num(model.mean[i])] + [f"{num(gain[i, j])} * (y_{j} - {num(model.mean[k + j])})" for j in range(d)]) for i in range(k)}
    return out | {f"p_{i}_{j}": num(p[i, j]) for i in range(k) for j in range(k)}


def _update(model: Model, inner: str) -> str:
    """From z_i and h_i_j (mean and covariance of the next x and y) and yn_i: x and p after the update."""
    k, d = model.dim_x, model.dim_y
    inner = _level(inner, {f"i_{a}": f"yn_{a} - z_{k + a}" for a in range(d)})
    if d == 1:
        inverse = {"w_0_0": f"1 / h_{k}_{k}"}
    else:
        det = f"(h_{k}_{k} * h_{k + 1}_{k + 1} - h_{k}_{k + 1} * h_{k + 1}_{k})"
        inverse = {"w_0_0": f"h_{k + 1}_{k + 1} / {det}", "w_0_1": f"-h_{k}_{k + 1} / {det}", "w_1_0": f"-h_{k + 1}_{k} / {det}", "w_1_1": f"h_{k}_{k} / {det}"}
    inner = _level(inner, inverse)
    inner = _level(inner, {f"g_{a}_{b}": _sum([f"h_{a}_{k + c} * w_{c}_{b}" for c in range(d)]) for a in range(k) for b in range(d)})
    new = {f"nx_{a}": _sum([f"z_{a}"] + [f"g_{a}_{b} * i_{b}" for b in range(d)]) for a in range(k)}
    for a in range(k):
        for b in range(k):
            parts = [f"h_{a}_{b}"]
            parts += [f"(-1) * g_{a}_{c} * h_{k + c}_{b}" for c in range(d)] + [f"(-1) * h_{a}_{k + c} * g_{b}_{c}" for c in range(d)]
            parts += [f"g_{a}_{c} * h_{k + c}_{k + e} * g_{b}_{e}" for c in range(d) for e in range(d)]
            new[f"np_{a}_{b}"] = _sum(parts)
    return _level(inner, new)


def _extended(model: Model, inner: str) -> str:
    n, k = model.dim, model.dim_x
    names = [Text(f"x_{i}") for i in range(k)] + [Text(f"y_{i}") for i in range(model.dim_y)]
    if model.linear:
        z = {f"z_{i}": _sum([f"{num(model.A[i, j])} * {names[j].text}" for j in range(n)]) for i in range(n)}
        a = {f"a_{i}_{j}": num(model.A[i, j]) for i in range(n) for j in range(k)}
        b = model.B @ model.noise @ model.B.T
        q = {f"q_{i}_{j}": num(b[i, j]) for i in range(n) for j in range(n)}
    else:
        value, by_z, by_v = model.jacobians(SQL, names)
        z = {f"z_{i}": Text.of(v).text for i, v in enumerate(value)}
        a = {f"a_{i}_{j}": Text.of(by_z[i][j]).text for i in range(n) for j in range(k)}
        if model.form == "classic":  # unit gain
            x = model.advance(SQL, names[:k], [0.0] * k)
            h = model.measure(_derived(), [Dual(Text.of(c), [float(i == j) for j in range(k)]) for i, c in enumerate(x)], [0.0] * model.dim_y)
            gain = [[num(float(i == j)) for j in range(n)] for i in range(k)]
            gain += [[Text.of(o.slopes[j]).text for j in range(k)] + [num(float(i == j)) for j in range(model.dim_y)] for i, o in enumerate(h)]
        else:
            gain = [[Text.of(by_v[i][j]).text for j in range(n)] for i in range(n)]
        b = {f"b_{i}_{j}": gain[i][j] for i in range(n) for j in range(n)}
        inner = _level(inner, b)
        q = {f"q_{i}_{j}": _sum([f"b_{i}_{c} * {num(model.noise[c, e])} * b_{j}_{e}" for c in range(n) for e in range(n) if model.noise[c, e]]) for i in range(n) for j in range(n)}
    inner = _level(inner, z | a | q)
    inner = _level(inner, {f"ap_{i}_{j}": _sum([f"a_{i}_{c} * p_{c}_{j}" for c in range(k)]) for i in range(n) for j in range(k)})
    return _level(inner, {f"h_{i}_{j}": _sum([f"ap_{i}_{c} * a_{j}_{c}" for c in range(k)] + [f"q_{i}_{j}"]) for i in range(n) for j in range(n)})


def _derived():
    from tidefold.functions.algebra import derivatives

    return derivatives(SQL)


def _unscented(model: Model, inner: str, key: str) -> str:
    """For one state component: the square root of p is its Cholesky factor."""
    n = model.dim
    unit, wm, wc = sigma.points(key, 1 + n)
    noise = unit[:, 1:] @ factor(model.noise[None])[0].T
    moved = {}
    for s in range(len(unit)):
        z = [Text(f"(x_0 + {num(unit[s, 0])} * sqrt(p_0_0))"), *[Text(f"y_{i}") for i in range(model.dim_y)]]
        for i, v in enumerate(model.g(SQL, z, [float(x) for x in noise[s]])):
            moved[f"m_{s}_{i}"] = Text.of(v).text
    inner = _level(inner, moved)
    inner = _level(inner, {f"z_{i}": _sum([f"{num(wm[s])} * m_{s}_{i}" for s in range(len(unit))]) for i in range(n)})
    return _level(inner, {f"h_{i}_{j}": _sum([f"{num(wc[s])} * (m_{s}_{i} - z_{i}) * (m_{s}_{j} - z_{j})" for s in range(len(unit))]) for i in range(n) for j in range(n)})


def _unscented_classic(model: Model, inner: str, key: str) -> str:
    """For one state and one observation component of a nonlinear classic model."""
    unit, wm, wc = sigma.points(key, 1)
    s = range(len(unit))
    first = {f"m_{i}": Text.of(model.advance(SQL, [Text(f"(x_0 + {num(unit[i, 0])} * sqrt(p_0_0))")], [0.0])[0]).text for i in s}
    inner = _level(inner, first)
    inner = _level(inner, {"z_0": _sum([f"{num(wm[i])} * m_{i}" for i in s])})
    inner = _level(inner, {"h_0_0": _sum([f"{num(wc[i])} * (m_{i} - z_0) * (m_{i} - z_0)" for i in s] + [num(model.noise[0, 0])])})
    inner = _level(inner, {f"r_{i}": Text.of(model.measure(SQL, [Text(f"(z_0 + {num(unit[i, 0])} * sqrt(h_0_0))")], [0.0])[0]).text for i in s})
    inner = _level(inner, {"z_1": _sum([f"{num(wm[i])} * r_{i}" for i in s])})
    cross = _sum([f"{num(wc[i] * unit[i, 0])} * sqrt(h_0_0) * (r_{i} - z_1)" for i in s])
    return _level(inner, {"h_1_1": _sum([f"{num(wc[i])} * (r_{i} - z_1) * (r_{i} - z_1)" for i in s] + [num(model.noise[1, 1])]), "h_0_1": cross, "h_1_0": cross})


def filter_sql(model: Model, observations: str, method: str = "epkf", sigma_set: str = "wan2000") -> str:
    """CTEs o (the observations: series, k, y_0.., more) and f (series, k, y_i, x_i, p_i_j, i_i, s_i_j); the text begins with WITH RECURSIVE."""
    k, d = model.dim_x, model.dim_y
    s0 = start(model)
    state = [f"y_{i}" for i in range(d)] + list(s0)
    carried = ", ".join(f"f.{c}" for c in state)
    nexts = ", ".join(f"o.y_{i} AS yn_{i}" for i in range(d))
    inner = f"SELECT f.series, o.k AS nk, {carried}, {nexts} FROM f JOIN o ON o.series = f.series AND o.k = f.k + 1"
    if method in ("pkf", "epkf"):
        inner = _extended(model, inner)
    elif method == "upkf":
        inner = _unscented(model, inner, sigma_set)
    else:
        inner = _unscented_classic(model, inner, sigma_set)
    inner = _update(model, inner)
    first = ", ".join([f"y_{i}" for i in range(d)] + [f"{v} AS {c}" for c, v in s0.items()] + [f"{num(0)} AS i_{i}" for i in range(d)] + [f"{num(float(i == j))} AS s_{i}_{j}" for i in range(d) for j in range(d)])
    later = ", ".join([f"yn_{i}" for i in range(d)] + [f"n{c}" for c in s0] + [f"i_{i}" for i in range(d)] + [f"h_{k + i}_{k + j}" for i in range(d) for j in range(d)])
    return f"WITH RECURSIVE o AS ({observations}), f AS (SELECT series, k, {first} FROM o WHERE k = 0 UNION ALL SELECT series, nk, {later} FROM ({inner}))"


def _uniform(parts: list[str]) -> str:
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(('0x' || substr(md5({text}), 1, 12)) AS UBIGINT) / {num(2**48)})"


def normal(parts: list[str]) -> str:
    return f"(sqrt({num(-2)} * ln({num(1)} - {_uniform([*parts, chr(39) + 'a' + chr(39)])})) * cos({num(2 * np.pi)} * {_uniform([*parts, chr(39) + 'b' + chr(39)])}))"


def simulate_sql(model: Model, steps: int, keys: str) -> str:
    """CTEs n (noise) and t (series, k, x_i, y_i) for keys, a query of (series, seed); the text begins with WITH RECURSIVE."""
    own = model.dim_x if model.form == "augmented" else model.dim
    early, late = factor(model.prior[None, :own, :own])[0], factor(model.noise[None, :own, :own])[0]
    normals = {f"u_{i}": normal(["seed", "series", "k", str(i)]) for i in range(own)}

    def total(f: np.ndarray, row: int) -> str:
        return _sum([f"{num(f[row, j])} * u_{j}" for j in range(row + 1) if f[row, j]])

    v = {f"v_{i}": f"CASE WHEN k = 0 THEN {num(model.mean[i])} + {total(early, i)} ELSE {total(late, i)} END" for i in range(own)}
    if model.form == "augmented":
        v |= {f"v_{model.dim_x + i}": v[f"v_{model.dim_x - model.dim_y + i}"] for i in range(model.dim_y)}
    noise = _level(_level(f"SELECT series, seed, unnest(range(0, {steps + 1})) AS k FROM ({keys})", normals), v)
    names = [f"x_{i}" for i in range(model.dim_x)] + [f"y_{i}" for i in range(model.dim_y)]
    moved = model.g(SQL, [Text(f"t.{c}") for c in names], [Text(f"n.v_{i}") for i in range(model.dim)])
    first = ", ".join(f"v_{i} AS {c}" for i, c in enumerate(names))
    later = ", ".join(Text.of(m).text for m in moved)
    return f"WITH RECURSIVE n AS ({noise}), t AS (SELECT series, k, {first} FROM n WHERE k = 0 UNION ALL SELECT n.series, n.k, {later} FROM t JOIN n ON n.series = t.series AND n.k = t.k + 1)"
