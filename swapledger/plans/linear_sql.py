"""Small linear systems written out in SQL, for oracles that must not share code with the solver."""

from __future__ import annotations


def cell(i: int, j: int) -> str:
    return f"g_{min(i, j)}_{max(i, j)}"


def gram_columns(xs: list[str], y: str, weight: str = "1.0") -> str:
    """Weighted sums g_i_j, r_i, yy of columns ``xs`` with an intercept."""
    full = ["1.0", *xs]
    p = len(full)
    out = [f"sum({weight} * {full[i]} * {full[j]}) as g_{i}_{j}" for i in range(p) for j in range(i, p)]
    return ", ".join([*out, *[f"sum({weight} * {full[i]} * {y}) as r_{i}" for i in range(p)], f"sum({weight} * {y} * {y}) as yy"])


def solved(name: str, source: str, p: int, prior: list[str], noise: str) -> str:
    """CTEs that invert g / noise + diag(prior) by elimination; ``name`` adds v_i_j and b_i to ``source``."""
    cells = [(i, j) for i in range(p) for j in range(2 * p)]

    def start(i: int, j: int) -> str:
        if j >= p:
            return "1.0::double" if i == j - p else "0.0::double"
        return f"({cell(i, j)} / {noise}" + (f" + {prior[i]})" if i == j else ")")

    ctes = [f"{name}_0 as (select *, {', '.join(f'{start(i, j)} as a_{i}_{j}' for i, j in cells)} from {source})"]
    for k in range(p):
        step = [
            f"a_{k}_{j} / a_{k}_{k} as a_{i}_{j}" if i == k else f"a_{i}_{j} - a_{i}_{k} * a_{k}_{j} / a_{k}_{k} as a_{i}_{j}" for i, j in cells
        ]
        ctes.append(f"{name}_{k + 1} as (select * replace ({', '.join(step)}) from {name}_{k})")
    v = [f"a_{i}_{p + j} as v_{i}_{j}" for i in range(p) for j in range(p)]
    b = ["(" + " + ".join(f"a_{i}_{p + j} * r_{j}" for j in range(p)) + f") / {noise} as b_{i}" for i in range(p)]
    drop = ", ".join(f"a_{i}_{j}" for i, j in cells)
    ctes.append(f"{name} as (select * exclude ({drop}), {', '.join(v + b)} from {name}_{p})")
    return ",\n  ".join(ctes)


def ridge(name: str, source: str, p: int, prior: list[str], passes: int = 3) -> str:
    """CTEs of a ridge fit whose noise variance is settled in ``passes``; ``source`` has g, r, yy, n."""
    ctes, at = [f"{name}_s0 as (select *, 1.0::double as s2 from {source})"], f"{name}_s0"
    made = ", ".join([f"v_{i}_{j}" for i in range(p) for j in range(p)] + [f"b_{i}" for i in range(p)])
    rss = "yy - 2 * (" + " + ".join(f"b_{i} * r_{i}" for i in range(p)) + ") + " + " + ".join(
        f"b_{i} * b_{j} * {cell(i, j)}" for i in range(p) for j in range(p))
    trace = "(" + " + ".join(f"v_{i}_{j} * {cell(i, j)}" for i in range(p) for j in range(p)) + ") / s2"
    for k in range(passes):
        ctes.append(solved(f"{name}_f{k}", at, p, prior, "s2"))
        ctes.append(f"{name}_s{k + 1} as (select * exclude ({made}) replace (greatest({rss}, 1e-12) / greatest(n - {trace}, 1.0) as s2) from {name}_f{k})")
        at = f"{name}_s{k + 1}"
    ctes.append(solved(name, at, p, prior, "s2"))
    return ",\n  ".join(ctes)
