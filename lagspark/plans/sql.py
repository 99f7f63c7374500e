"""SQL for DuckDB of queries that need matrices: Gauss-Jordan elimination, fits of any order, integrals."""

from __future__ import annotations

from .queries import TYPES2, TYPES3, sql_grid, sql_lags


def gauss(name: str, source: str, size: int, keys: str = "") -> str:
    """CTE of source's rows (keys, m) with the first `size` columns of m brought to the unit matrix, and their logdet."""
    return f"""{name} as (select * from (with recursive it as (select {keys} 0 as k, m, 0.0::double as logdet from {source} union all
  select {keys} k + 1, list_transform(m, lambda r, i: case when i = k + 1 then list_transform(r, lambda x: x / m[k + 1][k + 1]) else list_transform(r, lambda x, j: x - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) end), logdet + ln(m[k + 1][k + 1]) from it where k < {size}) select * from it where k = {size}))"""


def matrix(entry, rows, cols) -> str:
    return "[" + ", ".join("[" + ", ".join(entry(i, j) for j in cols) + "]" for i in rows) + "]"


def lags_of(channels, p: int) -> list[str]:
    return [f"{c}_l{k}" for k in range(1, p + 1) for c in channels]


def fit(channels, p: int, source: str = "lagged", by: str = "") -> str:
    """CTEs mom (rws, means, products about them), fit (m: unit matrix, then coefficients by lag and target)."""
    z, y = lags_of(channels, p), list(channels)
    keys = f"{by}, " if by else ""
    cov = lambda a, b: f"covar_samp({a}, {b}) * (count(*) - 1)"
    left = matrix(lambda i, j: cov(z[i], (z + y)[j]), range(len(z)), range(len(z) + len(y)))
    own = matrix(lambda i, j: cov(y[i], y[j]), range(len(y)), range(len(y)))
    means = "[" + ", ".join(f"avg({c})" for c in y + z) + "]"
    group = f" group by {by}" if by else ""
    return f"""mom as (select {keys}count(*) as rws, {left} as m, {left} as m0, {own} as yy, {means} as mean from {source}{group}),
{gauss("fitted", "mom", len(z), keys)}"""


def residual(n: int, d: int, i: int, j: int) -> str:
    """Product sum of residuals i and j from mom.m0, mom.yy and fitted.m."""
    return f"(mom.yy[{i + 1}][{j + 1}] - list_sum(list_transform(range(1, {d + 1}), lambda q: fitted.m[q][{d + i + 1}] * mom.m0[q][{d + j + 1}])))"


def var_coefficients(channels, p: int) -> str:
    n, d = len(channels), len(channels) * p
    return f"with {sql_grid('hour', channels)}, {sql_lags(channels, p)}, {fit(channels, p)} select 'all' as model_id, rws as rows, (q // {n * n}) * {n * n} + (q % {n * n}) as k, round(fitted.m[((q // {n * n}) * {n} + q % {n} + 1)::int][({d} + (q % {n * n}) // {n} + 1)::int], 6) + 0.0 as value from mom, fitted, range({d * n}) t(q)"


def criteria(channels, orders) -> str:
    n, parts = len(channels), []
    for p in orders:
        d = n * p
        det = f"({residual(n, d, 0, 0)} * {residual(n, d, 1, 1)} - {residual(n, d, 0, 1)} * {residual(n, d, 1, 0)})"
        parts.append(f"o{p} as (with {sql_lags(channels, p)}, {fit(channels, p)} select {p} as \"order\", {n * d}::bigint as k, rws as n, -0.5 * rws * ({n} * ln(2 * pi()) + ln({det} / power(rws - {d + 1}, 2)) + {n}) as loglik from mom, fitted)")
    union = " union all ".join(f"select * from o{p}" for p in orders)
    return f"""with {sql_grid('hour', channels)}, {", ".join(parts)}, u as ({union}),
c as (select *, -2 * loglik + 2 * k as aic, -2 * loglik + k * ln(n) as bic, -2 * loglik + 2 * k * ln(ln(n)) as hqc from u)
select 'all' as model_id, "order", round(loglik, 4) + 0.0 as loglik, k, n, round(aic, 4) + 0.0 as aic, round(bic, 4) + 0.0 as bic, round(hqc, 4) + 0.0 as hqc, round(bic - min(bic) over (), 4) + 0.0 as delta, bic = min(bic) over () as chosen from c"""


def cross_validation(channels, orders, k: int = 3, test: int = 60) -> str:
    n, parts = len(channels), []
    for p in orders:
        d, z = n * p, lags_of(channels, p)
        err = " + ".join(f"power({y} - mean[{i + 1}] - " + " - ".join(f"f.m[{j + 1}][{d + i + 1}] * ({c} - mean[{n + j + 1}])" for j, c in enumerate(z)) + ", 2)" for i, y in enumerate(channels))
        parts.append(f"""o{p} as (with {sql_lags(channels, p)}, part as (select l.*, fold from lagged l join folds on l.t - (select min(t) from g) < test_start), {fit(channels, p, "part", "fold")}
  select {p} as "order", folds.fold, sqrt(avg(({err}) / {n})) as rmse from lagged l join folds on l.t - (select min(t) from g) >= test_start and l.t - (select min(t) from g) < test_start + {test} join mom on mom.fold = folds.fold join fitted f on f.fold = folds.fold group by 2)""")
    union = " union all ".join(f"select * from o{p}" for p in orders)
    return f"""with {sql_grid('hour', channels)}, folds as (select i::int as fold, (select max(t) - min(t) + 1 from g) - ({k} - i) * {test} as test_start from range({k}) t(i)),
{", ".join(parts)}, u as ({union}), s as (select *, avg(rmse) over w as mean, stddev_samp(rmse) over w / sqrt(count(*) over w) as se from u window w as (partition by "order"))
select fold, round(rmse, 4) + 0.0 as rmse, "order", round(mean, 4) + 0.0 as mean, round(se, 4) + 0.0 as se, mean = min(mean) over () as chosen from s"""


def gaussian(k: int) -> str:
    cov = matrix(lambda i, j: f"covar_samp(e{i}, e{j})", range(k), range(k))
    aug = matrix(lambda i, j: f"covar_samp(e{i}, e{j})" if j < k else ("1.0::double" if j - k == i else "0.0::double"), range(k), range(2 * k))
    inverse = " + ".join(f"ln(m[{i + 1}][{k + i + 1}])" for i in range(k))
    var = " + ".join(f"ln(c[{i + 1}][{i + 1}])" for i in range(k))
    cols = ", ".join(f"embedding[{i + 1}]::double as e{i}" for i in range(k))
    return f"""with e as (select label, {cols} from embeddings), s as (select label, count(*) as n, {cov} as c, {aug} as m from e group by 1), {gauss("g", "s", k, "label, n, c, ")},
t as (select label, n, 0.5 * ({k} * ln(2 * pi() * exp(1)) + logdet) / ln(2) as entropy, 0.5 * ({var} - logdet) / ln(2) as tc, 0.5 * (logdet + {inverse}) / ln(2) as dtc from g)
select label, n, round(entropy, 6) + 0.0 as entropy, round(tc, 6) + 0.0 as tc, round(dtc, 6) + 0.0 as dtc, round(tc - dtc, 6) + 0.0 as o, round(tc + dtc, 6) + 0.0 as s from t"""


def emergence(channels) -> str:
    n, y = len(channels), "(" + " + ".join(channels) + ") / sqrt(3)"
    yl = "(" + " + ".join(f"{c}_l1" for c in channels) + ") / sqrt(3)"
    mi = lambda a, b, c: f"0.5 * (ln({a}) + ln({b}) - ln({a} * {b} - power({c}, 2))) / ln(2)"
    cross = lambda a, ma, b, mb: f"sum(({a} - {ma}) * ({b} - {mb})) / (count(*) - 1)"
    own = ", ".join(f"var_samp({c}) as v{i}, avg({c}) as a{i}" for i, c in enumerate(channels))
    later = [f"{cross('y', 'ay', 'yl', 'ay')} as cy"]
    later += [f"{cross('y', 'ay', f'{c}_l1', f'a{i}')} as up{i}, {cross(c, f'a{i}', 'yl', 'ay')} as down{i}" for i, c in enumerate(channels)]
    later += [f"{cross(c, f'a{j}', f'{b}_l1', f'a{i}')} as x{j}{i}" for j, c in enumerate(channels) for i, b in enumerate(channels)]
    ups = " + ".join(mi("vy", f"v{i}", f"up{i}") for i in range(n))
    downs = [mi(f"v{i}", "vy", f"down{i}") for i in range(n)]
    micro = [" + ".join(mi(f"v{j}", f"v{i}", f"x{j}{i}") for i in range(n)) for j in range(n)]
    delta = ", ".join(f"{a} - ({b})" for a, b in zip(downs, micro))
    return f"""with {sql_grid('hour', channels)}, {sql_lags(channels, 1)}, z as (select {own}, var_samp({y}) as vy, avg({y}) as ay from g),
l as (select *, {y} as y, {yl} as yl from lagged), s as (select {", ".join(later)}, any_value(vy) as vy, {", ".join(f"any_value(v{i}) as v{i}" for i in range(n))} from l, z),
r as (select {mi("vy", "vy", "cy")} as macro, {ups} as up, greatest({delta}) as delta, greatest({", ".join(downs)}) as gamma, {" + ".join(downs)} as down, {" + ".join(micro)} as micro from s)
select 'all' as series_id, round(macro - up, 6) + 0.0 as psi, round(delta, 6) + 0.0 as delta, round(gamma, 6) + 0.0 as gamma, round(macro, 6) + 0.0 as macro, round(up, 6) + 0.0 as micro_to_macro, round(down, 6) + 0.0 as macro_to_micro, round(micro, 6) + 0.0 as micro_to_micro from r"""


#: Simpson sums over 0..x in 2000 steps: twice the upper tail of a normal and of a t distribution.
def simpson(f: str, x: str) -> str:
    return f"({x} / 6000 * list_sum(list_transform(range(2001), lambda q: (case when q in (0, 2000) then 1 when q % 2 = 1 then 4 else 2 end) * ({f.replace('@', f'({x} * q / 2000)')}))))"


def normal_tails(x: str) -> str:
    return f"(1 - 2 * {simpson('exp(-0.5 * power(@, 2)) / sqrt(2 * pi())', x)})"


def t_tails(x: str, freedom: str) -> str:
    return f"(1 - 2 * exp(lgamma(({freedom} + 1) / 2.0) - lgamma({freedom} / 2.0)) / sqrt({freedom} * pi()) * {simpson(f'power(1 + power(@, 2) / {freedom}, -({freedom} + 1) / 2.0)', x)})"


def whiteness(base: str) -> str:
    """After a CTE res of predictions p1, p2: statistics of both channels and their law."""
    x = ("purchase", "click")
    step = lambda i: f"d{i}"
    sums = ", ".join(f"sum(c{i} * c{j}) as g{i}{j}, sum(d{i} * d{j}) as s{i}{j}, sum(d{i} * b{j}) as u{i}{j}" for i in range(2) for j in range(2))
    return base + f""", mu as (select avg(purchase) as m0, avg(click) as m1 from g),
e as (select t, purchase - m0 as c0, click - m1 as c1, purchase - p1 as e0, click - p2 as e1 from res, mu),
d as (select *, {", ".join(f"c{i} - lag(c{i}) over w as d{i}, lag(c{i}) over w - lag(c{i}, 2) over w as b{i}, e{i} - lag(e{i}) over w as f{i}" for i in range(2))} from e window w as (order by t)),
q as (select count(*) as m, {sums}, sum(f0 * f0) / sum(e0 * e0) as w0, sum(f1 * f1) / sum(e1 * e1) as w1 from d),
i as (select *, g00 * g11 - g01 * g10 as det from q),
h as (select *, (g11 * s00 - g01 * s10) / det as r00, (g11 * s01 - g01 * s11) / det as r01, (g00 * s10 - g10 * s00) / det as r10, (g00 * s11 - g10 * s01) / det as r11,
  (g11 * (2 * s00 - 2 * u00) - g01 * (2 * s10 - u10 - u01) + g00 * (2 * s11 - 2 * u11) - g10 * (2 * s01 - u01 - u10)) / det as bend from i),
l as (select *, 2 * (m - 1) - r00 - r11 as lin, 6 * m - 8 - 2 * bend + r00 * r00 + 2 * r01 * r10 + r11 * r11 as sq from h),
v as (select w0, w1, lin / (m - 2) as mean, sqrt(2 * (sq - lin / (m - 2) * lin) / ((m - 2) * m)) as sd from l),
a as (select 'purchase' as channel, w0 as dw, abs(w0 - mean) / sd as z from v union all select 'click', w1, abs(w1 - mean) / sd from v)
select 'all' as series_id, channel, round(dw, 6) + 0.0 as dw, round({normal_tails('z')}, 6) + 0.0 as pvalue from a"""


def causality_pvalues(spectrum: str) -> str:
    """After sz, the one-channel innovations of the VAR(1): with one restriction, F is the square of a t statistic."""
    return spectrum + f""", v as (select 0 as i, 1 as j, ln(v2 / s22) as value, rws - 2 as d from sz, var1 union all select 1, 0, ln(v1 / s11), rws - 2 from sz, var1),
p as (select i, j, value, {t_tails('sqrt(value * d)', 'd')} as p from v), k as (select *, count(*) over (order by p) as rnk, count(*) over () as m from p)
select i, j, round(value, 8) + 0.0 as value, round(p, 8) + 0.0 as p, coalesce(p <= (select max(p) from k where p <= 0.05::double * rnk / m), false) as significant from k"""


def downsampled(base: str) -> str:
    """After var1: entropy rate and predictive information of every third step; it is a VAR with the cube of A."""
    return base + """, n2 as (select *, s11 + a11*a11*s11 + 2*a11*a12*s12 + a12*a12*s22 as q11, s12 + a11*a21*s11 + (a11*a22 + a12*a21)*s12 + a12*a22*s22 as q12, s22 + a21*a21*s11 + 2*a21*a22*s12 + a22*a22*s22 as q22 from var1, lyap),
n3 as (select *, s11 + a11*a11*q11 + 2*a11*a12*q12 + a12*a12*q22 as w11, s12 + a11*a21*q11 + (a11*a22 + a12*a21)*q12 + a12*a22*q22 as w12, s22 + a21*a21*q11 + 2*a21*a22*q12 + a22*a22*q22 as w22 from n2)
select 'all' as model_id, round(0.5 * (2 * ln(2*pi()*exp(1)) + ln(w11*w22 - w12*w12)) / ln(2), 6) + 0.0 as entropy_rate, round(0.5 * (ln(p11*p22 - p12*p12) - ln(w11*w22 - w12*w12)) / ln(2), 6) + 0.0 as predictive_information from n3"""


def scaled(base: str) -> str:
    """After var1: x' = f A x + e, y = A x + e for some factors f; the innovations stay e."""
    return base + """, f as (select unnest([0.0::double, 0.5, 1.0, 2.0]) as f), fx as (select f, f*a11 as b11, f*a12 as b12, f*a21 as b21, f*a22 as b22, v.* from f, var1 v),
st as (select * from (with recursive it as (select 0 as k, fx.*, s11 as p11, s12 as p12, s22 as p22 from fx union all
  select k + 1, it.* exclude (k, p11, p12, p22), s11 + b11*b11*p11 + 2*b11*b12*p12 + b12*b12*p22, s12 + b11*b21*p11 + (b11*b22 + b12*b21)*p12 + b12*b22*p22, s22 + b21*b21*p11 + 2*b21*b22*p12 + b22*b22*p22 from it where k < 200) select * from it where k = 200)),
o as (select *, s11 + a11*a11*p11 + 2*a11*a12*p12 + a12*a12*p22 as o11, s12 + a11*a21*p11 + (a11*a22 + a12*a21)*p12 + a12*a22*p22 as o12, s22 + a21*a21*p11 + 2*a21*a22*p12 + a22*a22*p22 as o22, b11 + b22 as tr, b11*b22 - b12*b21 as dt from st)
select 'all@' || f::varchar as model_id, round(case when tr*tr/4 - dt >= 0 then greatest(abs(tr/2 + sqrt(greatest(tr*tr/4 - dt, 0))), abs(tr/2 - sqrt(greatest(tr*tr/4 - dt, 0)))) else sqrt(dt) end, 6) + 0.0 as spectral_radius, round(0.5 * (ln(o11*o22 - o12*o12) - ln(s11*s22 - s12*s12)) / ln(2), 6) + 0.0 as predictive_information from o"""


#: Phrases of the 1976 parsing: the next one is the shortest stretch not found before its own last letter.
LEMPEL_ZIV = """with s as (select conv_id, string_agg(case role when 'system' then 's' when 'user' then 'u' when 'assistant' then 'a' else 'x' end, '' order by turn) as s from conversations group by 1),
w as (select * from (with recursive it as (select conv_id, s, 0::bigint as i, 0::bigint as n from s union all
  select conv_id, s, i + coalesce(list_min(list_filter(range(1, length(s) - i + 1), lambda k: not contains(s[1:(i + k - 1)::int], s[(i + 1)::int:(i + k)::int]))), length(s) - i), n + 1 from it where i < length(s)) select * from it where i >= length(s)))
select conv_id, length(s) as length, n::double as complexity from w"""


class Spectrum:
    """CTEs of the cross-spectrum of a VAR(1) of three channels on a grid, as columns of real and imaginary parts."""

    def __init__(self, points: int = 65):
        n, self.points = 3, points
        b = [[(f"({int(i == j)} - a{i}{j}*cc)", f"(a{i}{j}*ss)") for j in range(n)] for i in range(n)]
        mul = lambda x, y: (f"({x[0]}*{y[0]} - {x[1]}*{y[1]})", f"({x[0]}*{y[1]} + {x[1]}*{y[0]})")
        sub = lambda x, y: (f"({x[0]} - {y[0]})", f"({x[1]} - {y[1]})")
        minor = lambda i, j: [[b[r][c] for c in range(n) if c != j] for r in range(n) if r != i]
        adj = {}
        for i in range(n):
            for j in range(n):
                m = minor(j, i)
                d = sub(mul(m[0][0], m[1][1]), mul(m[0][1], m[1][0]))
                adj[i, j] = d if (i + j) % 2 == 0 else (f"(-{d[0]})", f"(-{d[1]})")
        cells = ", ".join(f"{v[0]} as h{i}{j}r, {v[1]} as h{i}{j}i" for (i, j), v in adj.items())
        det_r = " + ".join(f"({b[0][j][0]}*h{j}0r - {b[0][j][1]}*h{j}0i)" for j in range(n))
        det_i = " + ".join(f"({b[0][j][0]}*h{j}0i + {b[0][j][1]}*h{j}0r)" for j in range(n))
        power = []
        for i in range(n):
            for j in range(i, n):
                re = " + ".join(f"v{k}{q}*(h{i}{k}r*h{j}{q}r + h{i}{k}i*h{j}{q}i)" for k in range(n) for q in range(n))
                im = " + ".join(f"v{k}{q}*(h{i}{k}i*h{j}{q}r - h{i}{k}r*h{j}{q}i)" for k in range(n) for q in range(n))
                power.append(f"({re}) / dd as s{i}{j}r, ({im}) / dd as s{i}{j}i")
        coef = ", ".join(f"fitted.m[{j + 1}][{n + i + 1}] as a{i}{j}" for i in range(n) for j in range(n))
        sigma = ", ".join(f"{residual(n, n, i, j)} / (rws - {n + 1}) as v{i}{j}" for i in range(n) for j in range(n))
        self.sql = f"""with {sql_grid('hour', TYPES3)}, {sql_lags(TYPES3, 1)}, {fit(TYPES3, 1)}, var3 as (select {coef}, {sigma} from mom, fitted),
fr as (select q, q / {2.0 * (points - 1)}::double as f, case when q in (0, {points - 1}) then 0.5::double else 1.0::double end / {points - 1} as w, cos(2*pi()*q/{2 * (points - 1)}) as cc, sin(2*pi()*q/{2 * (points - 1)}) as ss from range({points}) t(q)),
ad as (select fr.*, var3.*, {cells} from fr, var3), dt as (select *, power({det_r}, 2) + power({det_i}, 2) as dd from ad),
sp as (select *, {", ".join(power)} from dt)"""

    @staticmethod
    def logdet(keep) -> str:
        """Log determinant of the spectrum of some channels."""
        keep = sorted(keep)
        s = lambda i, j: f"s{i}{j}r"
        square = lambda i, j: f"(power(s{i}{j}r, 2) + power(s{i}{j}i, 2))"
        if len(keep) == 1:
            return f"ln({s(keep[0], keep[0])})"
        if len(keep) == 2:
            i, j = keep
            return f"ln({s(i, i)}*{s(j, j)} - {square(i, j)})"
        triple = "((s01r*s12r - s01i*s12i)*s02r + (s01r*s12i + s01i*s12r)*s02i)"
        return f"ln(s00r*s11r*s22r + 2*{triple} - s00r*{square(1, 2)} - s11r*{square(0, 2)} - s22r*{square(0, 1)})"

    def information(self, a, b) -> str:
        return f"0.5 * ({self.logdet(a)} + {self.logdet(b)} - {self.logdet([*a, *b])})"

    def oir(self) -> str:
        """O-information rate of three channels, its change by the first, and both by frequency."""
        o = f"0.5 * ({self.logdet([0, 1, 2])} + " + " + ".join(f"{self.logdet([i])} - {self.logdet([j for j in range(3) if j != i])}" for i in range(3)) + ")"
        d = f"({self.information([0], [1])} + {self.information([0], [2])} - {self.information([0], [1, 2])})"
        row = lambda name, f, v: f"select 'all' as model_id, 'oir' as family, '{name}' as measure, null::int as i, null::int as j, null::int as lag, {f} as f, null::varchar as atom, round({v}, 6) + 0.0 as value"
        return f"""{self.sql}, r as (select f, w, {o} as o, {d} as d from sp)
{row("spectral_o_information_rate", "round(f, 6)", "o")} from r union all {row("spectral_delta_o_information_rate", "round(f, 6)", "d")} from r
union all {row("o_information_rate", "null::double", "sum(w * o)")} from r union all {row("delta_o_information_rate", "null::double", "sum(w * d)")} from r"""

    def decomposition(self) -> str:
        """Atoms of the information rate of channels 0 and 1 about 2 by frequency and in all, and the extremes over triples."""
        atoms = ("{0}{1}", "{0}", "{1}", "{0,1}")

        def parts(i: int, j: int, t: int) -> list[str]:
            a, b, both = self.information([i], [t]), self.information([j], [t]), self.information([i, j], [t])
            red = f"least({a}, {b})"
            return [red, f"{a} - {red}", f"{b} - {red}", f"{both} - ({a}) - ({b}) + {red}"]

        row = lambda name, f, atom, v: f"select 'all' as model_id, 'pird' as family, '{name}' as measure, null::int as i, null::int as j, null::int as lag, {f} as f, '{atom}' as atom, round({v}, 6) + 0.0 as value"
        triples = [((i * 3 + j) * 3 + t, i, j, t) for i, j, t in ((1, 2, 0), (0, 2, 1), (0, 1, 2))]
        sums = ", ".join(f"sum(w * ({parts(i, j, t)[0]})) as r{c}, sum(w * ({parts(i, j, t)[3]})) as y{c}" for c, i, j, t in triples)
        own = ", ".join(f"{v} as x{k}" for k, v in enumerate(parts(0, 1, 2)))
        by_f = " union all ".join(row("spectral_pird", "round(f, 6)", a, f"x{k}") + " from r" for k, a in enumerate(atoms))
        whole = " union all ".join(row("pird", "null::double", a, f"sum(w * x{k})") + " from r" for k, a in enumerate(atoms))
        most = " union all ".join(row("pird_extrema", "null::double", name, v) + " from (select name, max(v) as v, max_by(code, v) as code from x group by 1) where name = " + f"'{key}'" for key in ("redundancy", "synergy") for name, v in ((key, "v"), (f"{key}_triple", "code")))
        pairs = " union all ".join(f"select 'redundancy' as name, {c} as code, r{c} as v from z union all select 'synergy', {c}, y{c} from z" for c, *_ in triples)
        return f"{self.sql}, r as (select f, w, {own} from sp), z as (select {sums} from sp), x as ({pairs}) {by_f} union all {whole} union all {most}"

    def projected(self) -> str:
        """Entropy rate and information rate of (x0 + x1, x2)."""
        a, b = "(s00r + s11r + 2*s01r)", "s22r"
        cross = "(power(s02r + s12r, 2) + power(s02i + s12i, 2))"
        return f"""{self.sql}, r as (select w, ln({a}) as la, ln({b}) as lb, ln({a}*{b} - {cross}) as lab from sp)
select 'all' as model_id, round(0.5 * (2 * ln(2*pi()*exp(1)) + sum(w * lab)) / ln(2), 6) + 0.0 as entropy_rate, round(0.5 * sum(w * (la + lb - lab)), 6) + 0.0 as mutual_information_rate from r"""


def attach(sql: dict, base: str, lyapunov: str, spectrum: str, residuals: str) -> None:
    """The SQL of queries whose Spark side is in queries.py."""
    wave = Spectrum()
    sql |= {
        "var2_n3": var_coefficients(TYPES3, 2), "var_ic_select": criteria(TYPES2, [1, 2, 3, 4]), "var_cv": cross_validation(TYPES2, [1, 2, 3]), "gauss_measures_n8": gaussian(8),
        "emergence_n3": emergence(TYPES3), "whiteness": whiteness(residuals), "downsample_n2": downsampled(base + lyapunov), "scale_grid_n2": scaled(base), "lz_roles": LEMPEL_ZIV,
        "mvgc_pvalues": causality_pvalues(base + spectrum), "oir_n3": wave.oir(), "pird_n3": wave.decomposition(), "project_n3": Spectrum(257).projected(),
    }
