"""Functions from columns to columns, with the null and rounding rules the operators rely on.

All are built from Spark's own functions, so they stay inside code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Reference data of the domain.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")
POSITION_ALIASES = {
    "QB": "QB", "RB": "RB", "HB": "RB", "FB": "RB", "TB": "RB", "WR": "WR", "SE": "WR", "FL": "WR", "SPLIT END": "WR", "TE": "TE", "H-BACK": "TE", "HB/TE": "TE",
}
TEAM_ALIASES = {
    "OAK": "LV", "SD": "LAC", "STL": "LA", "LAR": "LA", "RAM": "LA", "RAI": "LV", "SDG": "LAC", "ARZ": "ARI", "BLT": "BAL", "CLV": "CLE", "HST": "HOU",
    "JAC": "JAX", "WSH": "WAS", "WFT": "WAS", "GNB": "GB", "KAN": "KC", "NWE": "NE", "NOR": "NO", "SFO": "SF", "TAM": "TB", "LVR": "LV",
}
NO_TEAM = ("", "NA", "NONE", "NULL", "FA", "UFA", "RFA", "RET")
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿāăąćčďđēęěğīįıłńňőŕřśşšťţůűźżž"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyaaaccddeeegiiilnnorrsssttuuzzz"


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(key: ColumnOrName, table: dict, default: Column | None = None) -> Column:
    """Value of a small dictionary; a missing key gives ``default``, or null."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return m[col(key)] if default is None else F.coalesce(m[col(key)], default)


# ---- numbers


def safe_ratio(num: ColumnOrName, den: ColumnOrName, least: float = 0.0) -> Column:
    """``num / den`` where the denominator is over ``max(least, 0)``, else null."""
    n, d = col(num).cast("double"), col(den).cast("double")
    return F.when(d > F.lit(float(max(least, 0.0))), n / d)


def clip(x: ColumnOrName, low: float | None = None, high: float | None = None) -> Column:
    """Bounds that leave null as null."""
    x = col(x)
    y = x if low is None else F.greatest(x, F.lit(low))
    y = y if high is None else F.least(y, F.lit(high))
    return F.when(x.isNotNull(), y)


def zero_sum(*cols: ColumnOrName) -> Column:
    """Horizontal sum with null as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(col(c), F.lit(0)) for c in cols])


def mean_of_present(*cols: ColumnOrName) -> Column:
    """Horizontal mean of what is not null; null if nothing is."""
    n = reduce(lambda a, b: a + b, [col(c).isNotNull().cast("int") for c in cols])
    return F.when(n > 0, zero_sum(*cols).cast("double") / n)


def weighted_present(pairs: list[tuple[ColumnOrName, float]]) -> Column:
    """Weighted mean of what is not null, weights renormalised; null if nothing is."""
    w = reduce(lambda a, b: a + b, [F.when(col(c).isNotNull(), F.lit(float(k))).otherwise(0.0) for c, k in pairs])
    s = reduce(lambda a, b: a + b, [F.coalesce(col(c).cast("double"), F.lit(0.0)) * F.lit(float(k)) for c, k in pairs])
    return F.when(w > 0, s / w)


def bucket(x: ColumnOrName, edges: list[float], names: list[str]) -> Column:
    """Name of the first edge that x does not exceed; the last name beyond all; null stays null."""
    x = col(x)
    out = F.when(x.isNull(), None)
    for e, n in zip(edges, names, strict=False):
        out = out.when(x <= e, F.lit(n))
    return out.otherwise(F.lit(names[-1]))


def digitize(x: ColumnOrName, edges: list[float]) -> Column:
    """Number of edges under x."""
    x = col(x)
    return F.when(x.isNotNull(), reduce(lambda a, b: a + b, [(x > F.lit(float(e))).cast("int") for e in edges]))


def capital_curve(pick: ColumnOrName) -> Column:
    """Worth of a draft pick: 1 for the first, falling to a floor of 0.18."""
    return clip(F.lit(1.0) / (F.lit(1.0) + (col(pick) - 1) / F.lit(55.0)), 0.18, 1.0)


def pick_bucket(pick: ColumnOrName) -> Column:
    """Round-like groups of draft picks."""
    return bucket(pick, [10, 32, 64, 100], ["top10", "round1", "round2", "round3", "late"])


def bmi(weight: ColumnOrName, height: ColumnOrName) -> Column:
    return safe_ratio(F.lit(703.0) * col(weight), col(height) * col(height))


def blend(a: ColumnOrName, b: ColumnOrName, weight: float) -> Column:
    return col(a) * F.lit(1.0 - weight) + col(b) * F.lit(weight)


def finite(x: ColumnOrName) -> Column:
    """NaN and infinities become null."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def stable_unit(text: ColumnOrName) -> Column:
    """A number in [0, 1] from the first 32 bits of the SHA-256 of a text."""
    return F.conv(F.substring(F.sha2(col(text), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def mixed_unit(seed: int, text: ColumnOrName) -> Column:
    """A number in [0, 1) from a 32-bit multiply-and-xor hash over the characters of a text.

    The 64-bit product would overflow, so it is formed as a decimal and reduced.
    """
    wide = lambda x: x.cast("decimal(38,0)")
    step = F.aggregate(
        F.filter(F.split(col(text), ""), lambda c: c != ""),
        F.lit((seed ^ 0x9E3779B9) & 0xFFFFFFFF).cast("long"),
        lambda h, c: F.pmod(wide(h.bitwiseXOR(F.ascii(c).cast("long"))) * wide(F.lit(2654435761)), wide(F.lit(4294967296))).cast("long"),
    )
    return F.pmod(step, F.lit(1000003)).cast("double") / F.lit(1000003.0)


def seeded_place(text: ColumnOrName, seed: int, places: int = 1000) -> Column:
    """A whole number from 0 below ``places`` by a seeded hash of a text: an order that is the same for a seed."""
    return F.pmod(F.xxhash64(F.lit(seed), col(text)), F.lit(places).cast("long"))


def seeded_id(seed: int, *keys: ColumnOrName) -> Column:
    """An id in the form of a random UUID that follows from a seed and keys: the same in every run and for a row that is computed again."""
    h = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.substring(F.lit("89ab"), (F.conv(part(17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("4"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


# Names of the bands of ages and experience in the breakdown of errors.
AGES = ((24, "under 24"), (27, "24-26"), (30, "27-29"), (33, "30-32"))
EXPERIENCE = ((0, "rookie"), (1, "2nd season"), (3, "3rd-4th season"), (7, "5th-8th season"))


def age_band(age: ColumnOrName) -> Column:
    x = finite(col(age).cast("double"))
    out = F.when(x.isNull(), "unknown")
    for edge, name in AGES:
        out = out.when(x < edge, name)
    return out.otherwise("33 and over")


def experience_band(years: ColumnOrName) -> Column:
    """Bands of seasons played; half seasons between the first two bands belong to the third."""
    x = finite(col(years).cast("double"))
    first, second, *rest = EXPERIENCE
    out = F.when(x.isNull(), "unknown").when(x <= first[0], first[1]).when(x == second[0], second[1])
    for edge, name in rest:
        out = out.when(x <= edge, name)
    return out.otherwise("9th season and beyond")


def fixed_decimals(x: ColumnOrName, digits: int = 1) -> Column:
    """A number with so many decimals, halves away from zero; ``-`` for none.

    Halves are only such that the number itself is exactly half-way, not those of its shortest notation.
    """
    v = col(x).cast("double")
    shifted, scale = F.abs(v) * F.lit(float(10**digits)), F.lit(float(2 ** (digits + 1)))
    half = (shifted - F.floor(shifted) == 0.5) & (F.abs(v) * scale == F.floor(F.abs(v) * scale))
    up = F.signum(v) * (F.floor(shifted) + 1) / F.lit(float(10**digits))
    text = lambda c: F.regexp_replace(F.format_number(c, digits), ",", "")
    return F.when(v.isNull() | F.isnan(v), "-").when(half, text(up)).otherwise(text(v))


# ---- text


def rookie_key(name: ColumnOrName) -> Column:
    """Name for comparison with college rows: lower case, only a-z, digits and single spaces; a last generational suffix goes.

    Accented letters are dropped, not replaced, and the suffix goes before spaces are trimmed.
    """
    flat = F.regexp_replace(F.lower(F.coalesce(col(name), F.lit(""))), r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(flat, r"\s+(jr|sr|ii|iii|iv|v)$", ""), r"\s+", " "))


def plain(text: ColumnOrName) -> Column:
    """Lower case without Latin accents."""
    return F.regexp_replace(F.translate(F.lower(col(text)), ACCENTED, PLAIN), "ß", "ss")


def normal_name(name: ColumnOrName, repeat_suffix: bool = False) -> Column:
    """Name for comparison: plain letters and digits, single spaces, no generational suffix.

    ``repeat_suffix`` strips stacked suffixes too.
    """
    flat = F.trim(F.regexp_replace(F.regexp_replace(plain(name), "[^a-z0-9 ]", ""), " +", " "))
    ends = "|".join(SUFFIXES)
    return F.trim(F.regexp_replace(flat, f"( ({ends})){'+' if repeat_suffix else ''}$", ""))


def alnum_key(text: ColumnOrName) -> Column:
    return F.regexp_replace(F.lower(col(text)), "[^a-z0-9]", "")


def slug(text: ColumnOrName) -> Column:
    """Words joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(plain(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def short_name(name: ColumnOrName) -> Column:
    """Initial of the first word and the last word."""
    parts = F.split(F.trim(col(name)), " +")
    return F.when(F.size(parts) > 1, F.concat(F.substring(parts[0], 1, 1), F.lit(". "), F.element_at(parts, -1))).otherwise(F.trim(col(name)))


def normal_team(team: ColumnOrName) -> Column:
    """Team code in use; blank and unknown ones are free agents."""
    t = F.upper(F.trim(F.coalesce(col(team), F.lit(""))))
    return F.when(t.isin(*NO_TEAM), F.lit("FA")).otherwise(lookup(t, TEAM_ALIASES, t))


def normal_position(position: ColumnOrName) -> Column:
    """Position in use; null if there is none of that name."""
    return lookup(F.upper(F.trim(col(position))), POSITION_ALIASES)


def truth(text: ColumnOrName, default: bool | None = None) -> Column:
    """true, 1, yes and y in any case; blank gives ``default``."""
    t = F.lower(F.trim(col(text)))
    return F.when(t.isNull() | (t == ""), F.lit(default)).otherwise(t.isin("true", "1", "yes", "y"))


def label(key: ColumnOrName) -> Column:
    return F.initcap(F.regexp_replace(col(key), "_", " "))


def listed(items: ColumnOrName, most: int = 12, sep: str = "; ") -> Column:
    return F.array_join(F.slice(col(items), 1, most), sep)


def timer(seconds: ColumnOrName) -> Column:
    """Remaining time as people write it: 1:05, 2h 3m, 1d 1h; null has no limit."""
    s = col(seconds).cast("long")
    i = lambda n: F.expr("1").cast("long") * n
    days, hours, minutes = F.floor(s / 86400), F.floor(F.pmod(s, i(86400)) / 3600), F.floor(F.pmod(s, i(3600)) / 60)
    text = lambda *x: F.concat(*[y.cast("string") if isinstance(y, Column) else F.lit(y) for y in x])
    return (
        F.when(s.isNull(), F.lit("No limit")).when(s >= 86400, text(days, "d ", hours, "h")).when(s >= 3600, text(hours, "h ", minutes, "m"))
        .otherwise(text(minutes, ":", F.lpad(F.pmod(s, i(60)).cast("string"), 2, "0")))
    )


def remaining(deadline: ColumnOrName, now: ColumnOrName) -> Column:
    """Whole seconds to a deadline in milliseconds, rounded up, never negative."""
    return F.greatest(F.lit(0), F.ceil((col(deadline) - col(now)) / 1000)).cast("long")


# ---- dates


def date_prefix(text: ColumnOrName) -> Column:
    """A date from the first ten characters; null if they are none."""
    return F.try_to_timestamp(F.substring(col(text), 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def season_of(date: ColumnOrName) -> Column:
    """January and February belong to the season of the year before."""
    return F.year(date) - F.when(F.month(date) < 3, 1).otherwise(0)


def age_by_year(birth: ColumnOrName, season: ColumnOrName) -> Column:
    """A season less the year that a date of birth, or its text, begins with; null if it begins with none."""
    return col(season) - F.substring(col(birth).cast("string"), 1, 4).try_cast("int")


def age_at(birth: ColumnOrName, season: ColumnOrName) -> Column:
    """Years at the first of September of a season."""
    return F.datediff(F.make_date(col(season), F.lit(9), F.lit(1)), col(birth)) / F.lit(365.25)
