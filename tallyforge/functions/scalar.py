"""Column builders: exact rounding, display forms, name keys, parsers, clocks. No Python runs per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers see it: also the no-break space.
WHITE = r"[\s ]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_up(x: Column | str, digits: int = 0) -> Column:
    """Rounding that takes halves towards plus infinity; a long for whole numbers, else a double."""
    x = _c(x).cast("double")
    if digits == 0:
        return F.floor(x + F.lit(0.5)).cast("long")
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + F.lit(0.5)).cast("double") / scale


def ratio(a: Column | str, b: Column | str, scale: float = 1.0) -> Column:
    """a / b * scale, 0 where b isn't positive."""
    return F.when(_c(b) > 0, _c(a).cast("double") / _c(b).cast("double") * F.lit(scale)).otherwise(F.lit(0.0))


def percent(a: Column | str, b: Column | str) -> Column:
    """Whole per cent of b, 0 where b isn't positive."""
    return half_up(ratio(a, b, 100.0))


def clamp(x: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(x)))


def scaled(x: Column | str, low: Column | float, high: Column | float) -> Column:
    """Where x lies between low and high, kept within 0 and 1."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.when(high > low, clamp((_c(x).cast("double") - low) / (high - low), 0.0, 1.0)).otherwise(F.lit(0.0))


def fixed(x: Column, digits: int) -> Column:
    """Decimal text with a fixed number of places, from half_up."""
    return half_up(x, digits).cast(f"decimal(38,{digits})").cast("string") if digits else half_up(x).cast("string")


def amount(x: Column | str) -> Column:
    """Money in the Indian units: crore, lakh, thousand, or as it is."""
    v = _c(x).cast("double")
    return (
        F.when(v >= 1e7, F.concat(fixed(v / 1e7, 2), F.lit(" Cr")))
        .when(v >= 1e5, F.concat(fixed(v / 1e5, 2), F.lit(" L")))
        .when(v >= 1e3, F.concat(fixed(v / 1e3, 1), F.lit("K")))
        .otherwise(_c(x).cast("string"))
    )


def short_number(x: Column | str, steps: list[tuple[float, int, str]]) -> Column:
    """A count in the first unit (size, places, mark) that it reaches, from the largest down; a dash for none."""
    v = _c(x).cast("double")
    out = _c(x).cast("string")
    for size, places, mark in sorted(steps):
        out = F.when(v >= size, F.concat(fixed(v / size, places), F.lit(mark))).otherwise(out)
    return blank_as_dash(x, out)


def crores(x: Column | str, none: str | None = None) -> Column:
    """An amount in crores with the rupee's sign; `none` stands for amounts that aren't positive, if given."""
    v = _c(x).cast("double")
    out = F.when(v >= 1000, F.concat(F.lit("₹"), fixed(v / 1000, 1), F.lit("K Cr")))
    shown = F.concat(F.lit("₹"), _c(x).cast("string"), F.lit(" Cr"))
    return out.when(v > 0, shown).otherwise(F.lit(none)) if none else out.otherwise(shown)


def percent_text(x: Column | str, digits: int = 1) -> Column:
    """A share with a fixed number of places; a dash where it is missing."""
    return F.when(_c(x).isNull(), F.lit("—")).otherwise(F.concat(fixed(_c(x), digits), F.lit("%")))


def blank_as_dash(x: Column | str, shown: Column) -> Column:
    """A dash where x is null, zero or empty."""
    return F.when(_c(x).isNull() | (_c(x).cast("string").isin("", "0", "0.0")), F.lit("—")).otherwise(shown)


def slug(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(x)), r"\s+", "-"), r"[^\w-]", "")


def name_key(x: Column | str) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "")


def person_key(x: Column | str) -> Column:
    """Upper-case Latin words with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(_c(x), F.lit(""))), "[^A-Z ]", ""), " +", " "))


def place_key(x: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """Letters only, without reservation marks, whole words replaced by their aliases."""
    out = F.lower(F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?i)\s*\((?:SC|ST|GEN)\)\s*", "")))
    for word, use in (aliases or {}).items():
        out = F.regexp_replace(out, rf"\b{word}\b", use)
    return F.regexp_replace(out, "[^a-z]", "")


def same_name(a: Column | str, b: Column | str) -> Column:
    """Equal in their letters, false where either is missing."""
    letters = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(x)), "[^a-z ]", ""), " +", " "))
    return F.coalesce((letters(a) == letters(b)) & (letters(a) != ""), F.lit(False))


#: Sounds written in several ways, in the order in which they fold.
SOUNDS = (("sh", "s"), ("ph", "f"), ("ch", "c"), ("kh", "k"), ("gh", "g"), ("th", "t"), ("ee|ie|ey", "i"), ("oo|ou", "u"), ("ai|ay", "a"), ("[^a-z0-9 ]", ""))


def sound_key(x: Column | str, collapse: bool = True) -> Column:
    out = reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), SOUNDS, F.lower(_c(x)))
    return F.regexp_replace(out, r"(.)\1+", "$1") if collapse else out


def title_case(x: Column | str) -> Column:
    """Each letter or digit after a character that is neither, in upper case; the rest in lower case."""
    chars = F.split(F.lower(_c(x)), "")
    starts = F.transform(chars, lambda ch, i: F.when((i == 0) | ~F.get(chars, i - 1).rlike(r"\w"), F.upper(ch)).otherwise(ch))
    return F.array_join(starts, "")


def strip_markup(html: Column | str) -> Column:
    steps = (("<[^>]+>", ""), ("&nbsp;", " "), ("(?i)&#?[a-z0-9]+;", " "), (f"{WHITE}+", " "))
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, _c(html)))


def cell_text(html: Column | str) -> Column:
    """Text of a table cell: tags and no-break spaces become spaces."""
    steps = (("<[^>]+>", " "), ("&nbsp;", " "), (f"{WHITE}+", " "))
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, _c(html)))


def digits_value(x: Column | str, default: int | None = 0) -> Column:
    got = F.regexp_replace(_c(x), r"[^\d]", "").try_cast("long")
    return got if default is None else F.coalesce(got, F.lit(default).cast("long"))


def money(x: Column | str) -> Column:
    """Rupees without marks and separators; nil, bad and missing are 0."""
    plain = F.regexp_replace(_c(x), r"(?i)Rs\.?\s*|,|\s|&nbsp;", "")
    return F.coalesce(F.regexp_extract(plain, r"^(-?\d+)", 1).try_cast("long"), F.lit(0).cast("long"))


def money_units(x: Column | str) -> Column:
    """Rupees with crore and lakh multipliers."""
    number = F.regexp_extract(F.regexp_replace(_c(x), ",", ""), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    times = F.when(_c(x).rlike(r"(?i)\bcr"), 1e7).when(_c(x).rlike(r"(?i)\b(?:lakh|lac|l\b)"), 1e5).otherwise(1.0)
    return F.coalesce(half_up(number * times), F.lit(0).cast("long"))


def decimal_value(x: Column | str) -> Column:
    """The first signed decimal in a text; 0 if there is none."""
    return F.coalesce(F.regexp_extract(_c(x), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))


def canonical(x: Column | str, names: dict[str, str], default: str = "raw") -> Column:
    """A dictionary's value for the trimmed, upper-case name; else as the default says: raw, upper, or that text."""
    key = F.upper(F.trim(F.coalesce(_c(x), F.lit(""))))
    table = F.create_map(*[F.lit(v) for pair in names.items() for v in pair]) if names else F.create_map()
    other = {"raw": F.trim(_c(x)), "upper": key}.get(default, F.lit(default))
    return F.coalesce(F.try_element_at(table, key) if names else F.lit(None).cast("string"), F.when(key != "", other), F.lit("IND" if default in ("raw", "upper") else default))


def reservation(name: Column | str) -> Column:
    return F.when(_c(name).rlike(r"(?i)\(SC\)"), "SC").when(_c(name).rlike(r"(?i)\(ST\)"), "ST").otherwise("General")


def listed_class(name: Column | str, titles: dict[str, str], first_names: dict[str, list[str]], unless_second: tuple[str, ...] = ()) -> Column:
    """A class by a title pattern, else by first names; null where neither says, or a second word speaks against the first."""
    out = F.lit(None).cast("string")
    words = F.split(F.lower(F.trim(_c(name))), r"\s+")
    against = F.coalesce(F.get(words, F.lit(1)).isin(*unless_second), F.lit(False)) if unless_second else F.lit(False)
    for kind, names in first_names.items():
        out = F.when(F.get(words, F.lit(0)).isin(names) & ~against, kind).otherwise(out)
    for pattern, kind in titles.items():
        out = F.when(_c(name).rlike(pattern), kind).otherwise(out)
    return out


def age_text(then: Column | str, now: Column, just_now: bool = True, dates: bool = False) -> Column:
    """How long ago: just now (if asked for), minutes, hours, and from a day on days or the date; empty for no time."""
    s = F.unix_timestamp(now) - F.unix_timestamp(_c(then))
    part = lambda n, unit: F.concat(F.expr(n).cast("string") if isinstance(n, str) else n.cast("string"), F.lit(unit))
    old = F.date_format(_c(then), "d/M/yyyy") if dates else part(F.floor(s / 86400), "d ago")
    return F.when(_c(then).isNull(), F.lit("")).when(F.lit(just_now) & (s < 60), F.lit("just now")).when(s < 3600, part(F.floor(s / 60), "m ago")).when(s < 86400, part(F.floor(s / 3600), "h ago")).otherwise(old)


def remaining(then: Column, now: Column) -> Column:
    """Days, hours, minutes and seconds left, 0 once it is past."""
    s = F.greatest(F.lit(0), F.unix_timestamp(then) - F.unix_timestamp(now))
    return F.struct(F.floor(s / 86400).alias("days"), F.floor(s % 86400 / 3600).alias("hours"), F.floor(s % 3600 / 60).alias("minutes"), (s % 60).alias("seconds"))


def is_fresh(then: Column, now: Column, minutes: int = 15) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(then) < 60 * minutes


def day_index(at: Column) -> Column:
    return F.unix_date(F.to_date(at))


def split_list(x: Column | str) -> Column:
    return F.filter(F.transform(F.split(_c(x), r"[,/;]+"), lambda v: F.trim(v)), lambda v: v != "")


def padded_id(x: Column | str, prefix: str = "c", width: int = 4) -> Column:
    """A number behind a prefix, with zeros up to a width; longer numbers stay whole."""
    number = _c(x).cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number))


def query_text(name: Column, district: Column, suffix: str) -> Column:
    return F.concat_ws(" ", F.format_string('"%s"', name), district, F.lit(suffix))


def on_circle(degrees: Column, radius: float, x: float = 0.0, y: float = 0.0) -> Column:
    return F.struct((F.lit(x) + radius * F.cos(F.radians(degrees))).alias("x"), (F.lit(y) + radius * F.sin(F.radians(degrees))).alias("y"))


def tone(low: tuple[int, int, int], high: tuple[int, int, int], t: Column) -> Column:
    """The colour a share t of the way from low to high, as rgb(...)."""
    parts = [half_up(F.lit(float(a)) + (b - a) * t) for a, b in zip(low, high)]
    return F.format_string("rgb(%d,%d,%d)", *parts)


def csv_field(x: Column | str) -> Column:
    """A field quoted only if it holds a comma, quote or line break."""
    v = F.coalesce(_c(x).cast("string"), F.lit(""))
    return F.when(v.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def replaced(items: Column, key: str, new: Column) -> Column:
    """A list of structs with the entry of new's key replaced by new, at the end."""
    return F.concat(F.filter(items, lambda i: i[key] != new[key]), F.array(new))


def level(x: Column, steps: list[tuple[float, str]], other: str) -> Column:
    """The name of the first step that x reaches, from the highest down."""
    out = F.lit(other)
    for least, name in sorted(steps):
        out = F.when(x >= least, name).otherwise(out)
    return out


def shuffled(items: Column, seed: Column) -> Column:
    """A list in the order of a seeded linear congruential shuffle: swaps from the end, one draw each."""
    start = F.struct(F.pmod(seed.cast("long"), F.lit(2**32)).alias("s"), items.alias("a"))

    def step(acc: Column, i: Column) -> Column:
        s = (acc["s"] * F.lit(1664525) + F.lit(1013904223)) % F.lit(2**32)
        j = F.floor(s.cast("double") / F.lit(float(2**32)) * (i + 1)).cast("int")
        at = lambda k: F.get(acc["a"], k)
        return F.struct(s.alias("s"), F.transform(acc["a"], lambda v, k: F.when(k == i, at(j)).when(k == j, at(i)).otherwise(v)).alias("a"))

    return F.when(F.size(items) < 2, items).otherwise(F.aggregate(F.sequence(F.size(items) - 1, F.lit(1), F.lit(-1)), start, step, lambda acc: acc["a"]))
