"""Statistics as SQL text that Spark and other ANSI engines evaluate alike: normal tails, parsing, finiteness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cody's rational approximations to erf and erfc (1969), from low to high order but for the last of each numerator, which leads.
_ERF_NUM = [3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1]
_ERF_DEN = [2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03]
_MID_NUM = [5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8]
_MID_DEN = [1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03]
_FAR_NUM = [3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2]
_FAR_DEN = [2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3]
_INV_SQRT_PI = 5.6418958354775628695e-1
# Wichura's AS 241 approximations to the normal quantile (1988), from order 0 up.
_Q_A = [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3]
_Q_B = [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3]
_Q_C = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4]
_Q_D = [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9]
_Q_E = [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7]
_Q_F = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15]


def _num(x: float) -> str:
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


def _horner(x: str, values: list[float]) -> str:
    out = _num(values[-1])
    for v in reversed(values[:-1]):
        out = f"({out} * {x} + {_num(v)})"
    return out


def _ratio(x: str, num: list[float], den: list[float]) -> str:
    """Cody's form: the leading values are num[-1] and 1."""
    return f"({_horner(x, [*num[:-1][::-1], num[-1]])}) / ({_horner(x, [*den[::-1], 1.0])})"


def two_sided_p_sql(z: str) -> str:
    """2 * pnorm(-abs(z)) = erfc(abs(z) / sqrt(2)) for a finite z, to some 1e-15 relative."""
    y = f"(abs({z}) * 0.7071067811865476e0)"
    cut = f"(floor({y} * 16e0) / 16e0)"
    decay = f"exp(-{cut} * {cut}) * exp(-({y} - {cut}) * ({y} + {cut}))"
    inv = f"(1e0 / ({y} * {y}))"
    near = f"1e0 - {y} * {_ratio(f'({y} * {y})', _ERF_NUM, _ERF_DEN)}"
    mid = f"{decay} * {_ratio(y, _MID_NUM, _MID_DEN)}"
    far = f"{decay} * (({_num(_INV_SQRT_PI)} - {inv} * {_ratio(inv, _FAR_NUM, _FAR_DEN)}) / {y})"
    return f"CASE WHEN {y} <= 0.46875e0 THEN {near} WHEN {y} <= 4e0 THEN {mid} ELSE {far} END"


def quantile_sql(p: str) -> str:
    """qnorm(p) for 0 < p < 1."""
    q, tail = f"({p} - 0.5e0)", f"sqrt(-ln(least({p}, 1e0 - {p})))"
    frac = lambda x, a, b: f"({_horner(x, a)}) / ({_horner(x, b)})"
    middle = f"{q} * {frac(f'(0.180625e0 - {q} * {q})', _Q_A, _Q_B)}"
    sign = f"CASE WHEN {q} < 0 THEN -1e0 ELSE 1e0 END"
    return f"CASE WHEN abs({q}) <= 0.425e0 THEN {middle} WHEN {tail} <= 5e0 THEN ({sign}) * {frac(f'({tail} - 1.6e0)', _Q_C, _Q_D)} ELSE ({sign}) * {frac(f'({tail} - 5e0)', _Q_E, _Q_F)} END"


def finite(x: Column) -> Column:
    """False for null, NaN and infinities, so that it can be negated."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def two_sided_p(name: str) -> Column:
    """From a column of z, by name; null where z isn't finite."""
    return F.when(finite(F.col(name)), F.expr(two_sided_p_sql(name)))


def se_from_p(beta: str, p: str) -> Column:
    """abs(beta) / abs(qnorm(p / 2)) for 0 < p < 1 and a finite beta that isn't 0; null otherwise."""
    usable = finite(F.col(beta)) & (F.col(beta) != 0) & F.coalesce((F.col(p) > 0) & (F.col(p) < 1), F.lit(False))
    return F.when(usable, F.abs(F.col(beta)) / F.abs(F.expr(quantile_sql(f"({p} / 2e0)"))))


MISSING = ["", ".", "na", "nan", "null"]
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$|^(?i)[+-]?inf(?:inity)?$"


def is_missing(text: Column) -> Column:
    return text.isNull() | F.lower(F.trim(text)).isin(MISSING)


def parse_number(text: Column) -> Column:
    """A double; null for missing tokens and for what isn't a number."""
    bare = F.trim(text.cast("string"))
    signed = F.regexp_replace(F.lower(bare), "^([+-]?)inf(?:inity)?$", "$1Infinity")
    return F.when(~is_missing(bare) & bare.rlike(NUMBER), signed.try_cast("double"))


def failed_number(text: Column) -> Column:
    """Whether a text is neither missing nor a number."""
    bare = F.trim(text.cast("string"))
    return ~is_missing(bare) & ~F.coalesce(bare.rlike(NUMBER), F.lit(False))
