"""Tail probabilities of test statistics, for single numbers on the driver.

Only finished statistics come here, a handful per report; the data never does.
"""

import math

_EPS = 1e-15
_TINY = 1e-300


def normal_two_sided(z):
    return math.erfc(abs(z) / math.sqrt(2))


def _upper_gamma(a, x):
    """Regularized upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:  # series for the lower part
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * _EPS:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * scale)
    b = x + 1 - a  # continued fraction for the upper part
    c = 1 / _TINY
    d = h = 1 / b
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = step * d + b
        d = 1 / (d if abs(d) > _TINY else _TINY)
        c = b + step / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1) < _EPS:
            break
    return scale * h


def _beta_fraction(a, b, x):
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 50_000_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + step * d
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = 1 + step / c
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1) < _EPS:
            break
    return h


def _log_gamma_step(a, b):
    """log of gamma(a + b) / gamma(a), without the cancellation of two large logarithms."""
    shift = 0.0
    while a < 50:  # the series below needs a large argument
        shift -= math.log1p(b / a)
        a += 1
    series = lambda x: (
        1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    )
    main = (a - 0.5) * math.log1p(b / a) + b * math.log(a + b) - b
    return shift + main + series(a + b) - series(a)


def _beta(a, b, u):
    """Regularized incomplete beta function at x = 1 / (1 + u); exact for x close to 1 too."""
    if u <= 0:
        return 1.0
    x, log_x = 1 / (1 + u), -math.log1p(u)
    low, high = sorted((a, b))
    front = math.exp(
        _log_gamma_step(high, low) - math.lgamma(low) + a * log_x + b * (math.log(u) + log_x)
    )
    # the complement's fraction keeps all digits where many degrees of freedom bring x close to 1;
    # it serves near its own range, as long as the difference from 1 has digits
    near = u * x < min(0.5, 8 * (b + 1) / (a + b + 2))
    if near or x >= (a + 1) / (a + b + 2):
        rest = 1 - front * _beta_fraction(b, a, u * x) / b
        if rest > 1e-4 or x >= (a + 1) / (a + b + 2):
            return rest
    return front * _beta_fraction(a, b, x) / a


def chi2_tail(x, dof):
    if x is None or not dof:
        return 1.0 if x is not None else None
    return _upper_gamma(dof / 2, x / 2)


def t_two_sided(t, dof):
    if t is None or dof is None:
        return None
    return _beta(dof / 2, 0.5, t * t / dof)


def f_tail(f, d1, d2):
    if f is None or not d1 or not d2:
        return None
    return _beta(d2 / 2, d1 / 2, d1 * f / d2)


def with_p_values(df, tail, *args):
    """Append p_value and significant_at_05 to a report of a few rows.

    tail is called with the named columns of each row.
    """
    rows = []
    for r in df.collect():
        p = tail(*[r[a] for a in args])
        rows.append((*r, p, None if p is None else p < 0.05))
    schema = df.schema.add("p_value", "double").add("significant_at_05", "boolean")
    return df.sparkSession.createDataFrame(rows, schema)
