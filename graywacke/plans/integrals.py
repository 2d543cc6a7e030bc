"""SQL for p values, for the SQL that checks queries: distribution functions as Simpson sums over smooth integrands."""

from __future__ import annotations


def simpson(f: str, upper: str, panels: int = 2000) -> str:
    """SQL of the integral of f, an expression in {u}, from 0 to the expression upper."""
    at = f"(i * ({upper}) / {panels})"
    weight = f"case when i = 0 or i = {panels} then 1 when i % 2 = 1 then 4 else 2 end"
    return f"(({upper}) / {3 * panels} * list_sum(list_transform(range({panels + 1}), lambda i: ({weight}) * ({f.replace('{u}', at)}))))"


def p_t(t: str, df: str) -> str:
    """Two-sided p of t: with t = sqrt(df) tan(u) the density is a power of cos(u)."""
    scale = f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi())"
    area = simpson(f"pow(cos({{u}}), ({df}) - 1)", f"atan(abs({t}) / sqrt({df}))")
    return f"(1 - 2 * {scale} * {area})"


def p_f(f: str, d1: str, d2: str) -> str:
    """Upper p of F: an incomplete beta with x = sin(u) squared."""
    scale = f"2 * exp(lgamma((({d1}) + ({d2})) / 2.0) - lgamma(({d1}) / 2.0) - lgamma(({d2}) / 2.0))"
    area = simpson(f"pow(sin({{u}}), ({d2}) - 1) * pow(cos({{u}}), ({d1}) - 1)", f"asin(sqrt(({d2}) / (({d2}) + ({d1}) * ({f}))))", 4000)
    return f"({scale} * {area})"


def p_chi2(x: str, k: str) -> str:
    """Upper p of chi squared, with x = u squared."""
    scale = f"2 / (pow(2, ({k}) / 2.0) * exp(lgamma(({k}) / 2.0)))"
    area = simpson(f"pow({{u}}, ({k}) - 1) * exp(-pow({{u}}, 2) / 2)", f"sqrt({x})")
    return f"(1 - {scale} * {area})"


def p_z(z: str) -> str:
    """Two-sided p of z."""
    return f"(1 - 2 / sqrt(2 * pi()) * {simpson('exp(-pow({u}, 2) / 2)', f'abs({z})')})"
