"""Personal data by base patterns and a boosted candidate classifier, in DataFrame operations.

Base spans come from one pattern per kind with a check (parts of an address, digits of a number, the Luhn sum).
Beside them, generators with high recall propose overlapping spans: runs around an at sign or a spelled one, runs of
digits, bodies of phone numbers inside longer runs, and long tokens with digits. Candidates are described by format
(digits, separators, letters, length, how varied they are) and context (the characters around them, what the words
before speak of), never by what the base checks test. Counts of each description, with how often it lies on a base span
of a kind, are the training table of one set of boosted trees per kind. Secrets (keys, tokens, passwords) have no base
pattern: what teaches them is the context, an assignment to a word for one, and what their trees see is the format
alone, so they find such strings wherever they stand. The trees become CASE expressions, and a threshold per kind is
calibrated on counts from other documents, so that what is added is as precise as asked for: for secrets by assignments
and by known key prefixes, which no tree has seen. A string may be a secret without any mark, so nine in ten must bear one.
Candidates over the threshold that touch no base span are added, of overlapping ones the first and longest; base spans
always stay.

Matches are placed by splitting the text at them and by running sums over slices of bounded length, so all work is per
row, inside the JVM, and grows in proportion to a text and its matches. The counted descriptions stay in their table, of
any size: the trees grow by histograms that aggregations sum over all of them, and only those reach the driver. Group quantifiers
are possessive, which keeps long runs linear and off the
stack without changing what matches.

Defined results: null or empty text has no spans; positions are code points, ends exclusive; rows without doc_id
train on one side; repeated rows give equal spans; an empty table gives no rows;
other columns pass through, but those named as the new ones are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import cut, fold, forget

#: Kinds with a base pattern, then those that only candidates can be.
KINDS = ("email", "ip", "card", "phone")
NAMES = (*KINDS, "secret")
#: Leftmost, non-overlapping. A run that can't start a match at its first character can't at a later one.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "at": r"[^\s@]++@[^\s@]++",
    "spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(](?i:dot)[\])])\x20?[A-Za-z0-9-]++)*+",
    "digits": r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9])++",
    "local": r"(?:\([0-9]{2,4}\)\x20?|(?<![0-9])[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
    "token": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{16,}+",
}
#: What a text must hold for a pattern to be tried.
_DIGIT = "text rlike '[0-9]'"
HINTS = {"email": "contains(text, '@')", "at": "contains(text, '@')", "spelled": "text rlike '(?i)[\\\\[(]at[\\\\])]'", "phone": "contains(text, '+')", "ip": _DIGIT, "card": _DIGIT, "digits": _DIGIT, "local": _DIGIT, "token": _DIGIT}
#: What gives a secret away, and the words before a candidate that speak of a kind, in four languages.
PREFIXES = r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[opsu]_|^xox[abp]-|^AIza|^sk[-_]"
ASSIGNED = r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s*[=:]\s*[\x22']?$"
SPEAKS = (r"(?i)\b(?:tel|phone|call|fax|mobile|telefon|anruf|handy|t[eé]l[eé]phone|portable|tel[eé]fono|m[oó]vil)\b", r"(?i)\b(?:card|visa|mastercard|karte|carte|tarjeta)\b", r"(?i)\b(?:mail|e-mail|email|contact|kontakt|correo|courriel)\b", r"(?i)\b(?:ip|host|server|serveur|servidor|address|adresse)\b", r"(?i)(?:password|passwd|pwd|secret|token|key)")
#: Bins of the features.
CONTEXTS = ("f_before", "f_after", "f_speaks")
FORMATS = ("f_digits", "f_dots", "f_spaces", "f_hyphens", "f_brackets", "f_at", "f_letters", "f_upper", "f_length", "f_turns", "f_variety", "f_hex")
FEATURES = (*FORMATS, *CONTEXTS)
#: Features that the trees of a kind see, where that isn't all.
SEES = {"secret": FORMATS}
#: Descriptions up to which one task sums them, and as many for each task more; how many of the secrets found must bear a mark in other documents.
DESCRIPTIONS, MARKED = 10_000, 0.9
#: Gradients are whole numbers of 1/UNIT; more than any feature's value; bins of the scores that thresholds are chosen from.
UNIT, VALUES, BINS = 1 << 20, 64, 1 << 14
#: Matches in a slice of a running sum; characters of context before a match.
SLICE, CONTEXT = 64, 24


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _carried(array: str, kind: str, zero: str, step: str) -> str:
    """The carry c before every element x of an array, where `step` is the next carry.

    An accumulator is copied at every element, so none grows with the array: one fold finds the carry at the start of
    each slice, then each slice lists its own.
    """
    inner = re.sub(r"\bc\b", "acc.c", step)
    return f"""transform(array({array}), whole -> transform(array(
      transform(sequence(0, greatest(size(whole) - 1, 0) div {SLICE}), i -> slice(whole, i * {SLICE} + 1, {SLICE}))), parts -> transform(array(
        aggregate(parts, named_struct('c', {zero}, 'l', cast(array() as array<{kind}>)),
          (all, part) -> named_struct('c', aggregate(part, all.c, (c, x) -> {step}), 'l', array_append(all.l, all.c)), all -> all.l)), starts ->
      flatten(transform(parts, (part, i) -> aggregate(part, named_struct('c', starts[i], 'o', cast(array() as array<{kind}>)),
        (acc, x) -> named_struct('c', {inner}, 'o', array_append(acc.o, acc.c)), acc -> acc.o))))[0])[0])[0]"""


def _scan(array: str, kind: str, zero: str, step: str, out: str) -> str:
    """`out` of every element x of an array and the carry c before it."""
    placed = re.sub(r"\bc\b", "carried[place]", out)
    return f"""transform(array({array}), own -> transform(array({_carried("own", kind, zero, step)}), carried ->
      transform(own, (x, place) -> {placed}))[0])[0]"""


def _matches(name: str, pattern: str) -> Column:
    """Matches of a pattern: start s, end e, text m, the characters before it b and the one after it a."""
    p = _quoted(pattern)
    found = f"""transform(array(split(text, {p}, -1)), gaps -> transform(regexp_extract_all(text, {p}, 0),
      (m, i) -> named_struct('m', m, 'n', length(gaps[i]), 'b', right(gaps[i], {CONTEXT}), 'a', left(gaps[i + 1], 1))))[0]"""
    placed = _scan(found, "int", "0", "c + x.n + length(x.m)", "named_struct('s', c + x.n, 'e', c + x.n + length(x.m), 'm', x.m, 'b', x.b, 'a', x.a)")
    return F.expr(f"case when {HINTS[name]} then {placed} else cast(array() as array<struct<s:int,e:int,m:string,b:string,a:string>>) end")


_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_COUNT = f"length({_DIGITS})"
_LUHN = f"""aggregate(sequence(1, {_COUNT}), 0, (t, i) -> t + case
    when i % 2 = 1 then int(substring({_DIGITS}, {_COUNT} - i + 1, 1))
    when int(substring({_DIGITS}, {_COUNT} - i + 1, 1)) > 4 then 2 * int(substring({_DIGITS}, {_COUNT} - i + 1, 1)) - 9
    else 2 * int(substring({_DIGITS}, {_COUNT} - i + 1, 1)) end) % 10 = 0"""
CHECKS = {
    "email": "true",
    "ip": "forall(split(x.m, '[.]'), q -> length(ltrim('0', q)) <= 3 and int(concat('0', ltrim('0', q))) <= 255)",
    "card": f"case when {_COUNT} between 12 and 19 then {_LUHN} else false end",
    "phone": f"{_COUNT} between 9 and 15",
}


def _count(pattern: str, most: int) -> str:
    return f"least(length(x.m) - length(regexp_replace(x.m, '{pattern}', '')), {most})"


def _around(ch: str) -> str:
    return f"case when coalesce({ch}, '') = '' then 0 when {ch} rlike '[\\\\s]' then 1 when {ch} rlike '[A-Za-z0-9]' then 2 else 3 end"


_FEATURES = {
    "f_digits": _count("[0-9]", 20),
    "f_dots": _count("[.]", 4),
    "f_spaces": _count("[ ]", 3),
    "f_hyphens": _count("[-]", 3),
    "f_brackets": _count("[()]", 2),
    "f_at": "cast(contains(x.m, '@') as int)",
    "f_letters": "case when x.m rlike '[A-Za-z]' then if(x.m rlike '[0-9]', 2, 1) else 0 end",
    "f_upper": "case when x.m rlike '[A-Z]' then if(x.m rlike '[a-z]', 2, 1) else 0 end",
    "f_length": "case when length(x.m) < 12 then 0 when length(x.m) < 16 then 1 when length(x.m) < 24 then 2 when length(x.m) < 48 then 3 else 4 end",
    "f_turns": "least(length(regexp_replace(regexp_replace(x.m, '[0-9]+', '#'), '[^#]', '')), 12) div 2",
    "f_variety": "least(size(array_distinct(split(x.m, ''))), 24) div 4",
    "f_hex": "case when x.m rlike '^[0-9]+$' then 0 when x.m rlike '^[0-9a-f-]+$' then 1 when x.m rlike '^[0-9A-Fa-f-]+$' then 2 else 3 end",
    "f_before": _around("right(x.b, 1)"),
    "f_after": _around("x.a"),
    "f_speaks": "case " + " ".join(f"when x.b rlike {_quoted(p)} then {i}" for i, p in enumerate(SPEAKS, 1)) + " else 0 end",
}
#: Marks: what teaches secrets, and what their threshold is calibrated by besides.
_MARKS = {"y4": f"x.b rlike {_quoted(ASSIGNED)}", "known": f"x.m rlike {_quoted(PREFIXES)}"}


def _spans(docs: DataFrame) -> DataFrame:
    """docs with `_base` (start, kind number, end) in order and `_cand`: start s, end e, features, y0 to y4 whether it lies on a base span of a kind or is assigned, `known` whether its prefix is."""
    found = docs.select("_row", F.col("text"), *[_matches(k, p).alias(k) for k, p in BASE.items()], *[_matches(k, p).alias(k) for k, p in GENERATORS.items()])
    kept = [f"transform(filter({k}, x -> {CHECKS[k]}), x -> named_struct('s', x.s, 'k', {i}, 'e', x.e))" for i, k in enumerate(KINDS)]
    features = ", ".join(f"'{n}', int({sql})" for n, sql in _FEATURES.items())
    marks = ", ".join(f"'{n}', int({sql})" for n, sql in _MARKS.items())
    cand = f"transform(concat({', '.join(GENERATORS)}), x -> named_struct('s', x.s, 'k', -1, 'e', x.e, 'f', named_struct({features}, {marks})))"
    found = found.select("_row", F.expr(f"array_sort(concat({', '.join(kept)}))").alias("_base"), F.expr(cand).alias("_cand"))
    # Base spans and candidates in one order: the furthest end before a candidate and the next start after it tell what it lies on.
    shape = "struct<" + ",".join(f"{n}:int" for n in (*FEATURES, *_MARKS)) + ">"
    base = f"transform(_base, q -> named_struct('s', q.s, 'k', q.k, 'e', q.e, 'f', cast(null as {shape})))"
    four = range(len(KINDS))
    kind, own = "struct<" + ",".join(f"m{i}:int" for i in four) + ">", "'s', x.s, 'k', x.k, 'e', x.e, 'f', x.f"
    fields = lambda of: ", ".join(of(i) for i in four)
    ahead = _scan(f"array_sort(concat({base}, _cand))", kind, f"""named_struct({fields(lambda i: f"'m{i}', 0")})""", f"""named_struct({fields(lambda i: f"'m{i}', if(x.k = {i}, greatest(c.m{i}, x.e), c.m{i})")})""", f"""named_struct({own}, {fields(lambda i: f"'y{i}', c.m{i} > x.s")})""")
    back = _scan(f"reverse({ahead})", kind, f"""named_struct({fields(lambda i: f"'m{i}', 2147483647")})""", f"""named_struct({fields(lambda i: f"'m{i}', if(x.k = {i}, x.s, c.m{i})")})""", f"""named_struct({own}, {fields(lambda i: f"'y{i}', x.y{i} or c.m{i} < x.e")})""")
    flat = ", ".join([*(f"'{n}', x.f.{n}" for n in FEATURES), *(f"'y{i}', x.y{i}" for i in four), *(f"'{n}', x.f.{n} = 1" for n in _MARKS)])
    marked = f"transform(filter({back}, x -> x.k < 0), x -> named_struct('s', x.s, 'e', x.e, {flat}))"
    nothing = "cast(array() as array<struct<s:int,e:int," + ",".join(f"{n}:int" for n in FEATURES) + "," + ",".join(f"{n}:boolean" for n in (*(f"y{i}" for i in four), *_MARKS)) + ">>)"
    return found.select("_row", "_base", F.expr(f"case when size(_cand) > 0 then {marked} else {nothing} end").alias("_cand"))


class Trees:
    """Boosted trees of depth two over counted descriptions; `sql` scores a candidate x.

    A tree grows by histograms alone: sums of gradients by feature and value, whole numbers of `UNIT`, so that they are the
    same whatever the order and wherever the descriptions lie.
    """

    def __init__(self, features: np.ndarray, n: np.ndarray, y: np.ndarray, sees: tuple[str, ...] = FEATURES) -> None:
        """Of a row per description: its features, how many candidates have it, and how many of these are positive."""
        self._start(float(y.sum()), float(n.sum()), sees)
        boost([self], lambda splits: _folded(list(_histograms([self], splits, features, n, y[:, None]))))

    @classmethod
    def open(cls, yes: float, every: float, sees: tuple[str, ...]) -> Trees:
        """Trees to be grown by `boost`."""
        out = cls.__new__(cls)
        out._start(yes, every, sees)
        return out

    def _start(self, yes: float, every: float, sees: tuple[str, ...]) -> None:
        # sees: the features that splits may use.
        self.sees, self.rate, self.ridge = [FEATURES.index(f) for f in sees], 0.4, 1.0
        self.base, self.trees, self.grows = math.log((yes + 0.5) / (every - yes + 0.5)), [], 0 < yes < every

    def split(self, own: dict) -> tuple | None:
        """The best (feature, last value of the lower side) by histograms {feature: [(value, g, h)]}, with the values of both leaves."""
        best = (1e-6, None)
        for f in self.sees:
            value, g, h = (np.array(x) for x in zip(*sorted(own.get(f, [(0, 0, 0)]))))
            g, h = np.cumsum(g) / UNIT, np.cumsum(h) / UNIT
            (lg, sg), (lh, sh) = (g[:-1], g[-1]), (h[:-1], h[-1])
            gain = lg**2 / (lh + self.ridge) + (sg - lg) ** 2 / (sh - lh + self.ridge) - sg**2 / (sh + self.ridge)
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (float(gain[k]), (f, int(value[k]), float(-lg[k] / (lh[k] + self.ridge)), float(-(sg - lg[k]) / (sh - lh[k] + self.ridge))))
        return best[1]

    def _values(self, tree, features) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(features), tree)
        return np.where(features[:, tree[0]] <= tree[1], self._values(tree[2], features), self._values(tree[3], features))

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        margin = np.full(len(features), self.base)
        for t in self.trees:
            margin = margin + self.rate * self._values(t, features)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

    def _sql(self, tree) -> str:
        if not isinstance(tree, tuple):
            return f"{tree!r}D"
        return f"case when x.{FEATURES[tree[0]]} <= {tree[1]} then {self._sql(tree[2])} else {self._sql(tree[3])} end"

    def sql(self) -> str:
        total = " + ".join([f"{self.base!r}D", *(f"{self.rate}D * ({self._sql(t)})" for t in self.trees)])
        return f"1 / (1 + exp(-greatest(-30D, least(30D, {total}))))"


def _histograms(models: list[Trees], splits: list[tuple | None] | None, features: np.ndarray, n: np.ndarray, y: np.ndarray) -> Iterator[tuple]:
    """(model, side of its split, feature, value, sum of g, sum of h) of some descriptions; without splits side 0 is all of them."""
    for i, model in enumerate(models):
        if not model.grows or splits and not splits[i]:
            continue
        p = model.probabilities(features)
        g, h = np.rint((n * p - y[:, i]) * UNIT), np.rint(n * p * (1 - p) * UNIT)
        side = (features[:, splits[i][0]] > splits[i][1]) * VALUES if splits else 0
        for f in model.sees:
            cell, place = np.unique(features[:, f] + side, return_inverse=True)
            for c, a, b in zip(cell, np.bincount(place, g), np.bincount(place, h)):
                yield i, int(c) // VALUES, f, int(c) % VALUES, int(a), int(b)


def _folded(rows: list[tuple]) -> dict:
    """Summed histograms by (model, side)."""
    out: dict = {}
    for i, side, f, value, g, h in rows:
        out.setdefault((i, side), {}).setdefault(f, []).append((value, g, h))
    return out


def boost(models: list[Trees], histograms: Callable, rounds: int = 24) -> None:
    """Grows the trees of all models together; histograms(splits) sums over all descriptions, wherever they lie."""
    for _ in range(rounds):
        if not any(m.grows for m in models):
            return
        whole = histograms(None)
        splits = [m.split(whole.get((i, 0), {})) if m.grows else None for i, m in enumerate(models)]
        for m, s in zip(models, splits):
            m.grows = s is not None
        parts = histograms(splits) if any(splits) else {}
        for i, (m, s) in enumerate(zip(models, splits)):
            if s:
                m.trees.append((*s[:2], *(m.split(parts.get((i, side), {})) or s[2 + side] for side in (0, 1))))


def calibrated(probability: np.ndarray, n: np.ndarray, y: np.ndarray, precision: float, least: float = 20) -> float:
    """The lowest threshold over which other documents' candidates are positive often enough; 2 if there is none."""
    order = np.argsort(-probability, kind="stable")
    p, seen, right = probability[order], np.cumsum(n[order]), np.cumsum(y[order])
    last = np.append(p[1:] < p[:-1], True)
    fine = np.flatnonzero(last & (seen >= least) & (right >= precision * seen))
    return max(float(p[fine[-1]]), 0.5) if len(fine) else 2.0


def _summed(table: DataFrame, models: list[Trees]) -> Callable:
    """What `boost` grows the models by. One aggregation a round sums over all descriptions x of the table, by the values of every two features, which gives both sides of any split."""
    held: list[tuple] = []

    def pairs() -> Iterator[tuple]:
        own = [i for i, m in enumerate(models) if m.grows]
        scored = table.alias("x").select(F.array(*FEATURES).alias("f"), "n", *[f"y{i}" for i in own], *[F.expr(models[i].sql()).alias(f"p{i}") for i in own])
        sums = {f"g{i}": f"cast(rint((n * p{i} - y{i}) * {UNIT}) as long)" for i in own} | {f"h{i}": f"cast(rint(n * p{i} * (1 - p{i}) * {UNIT}) as long)" for i in own}
        each = scored.select("f", *[F.expr(sql).alias(name) for name, sql in sums.items()])
        for key in (("feature", "value", "f"), ("further", "other", f"slice(f, feature + 1, {len(FEATURES)})")):
            each = each.select(*each.columns, F.expr(f"posexplode({key[2]}) as ({key[0]}, {key[1]})"))
        for r in each.groupBy("feature", "value", "further", "other").agg(*[F.sum(name).alias(name) for name in sums]).collect():
            yield r["feature"], r["value"], r["feature"] + r["further"], r["other"], [(i, r[f"g{i}"], r[f"h{i}"]) for i in own]

    def histograms(splits: list[tuple | None] | None) -> dict:
        if not splits:
            held[:] = pairs()
            return _folded([(i, 0, f, v, g, h) for f, v, e, _, sums in held if f == e for i, g, h in sums])
        cells: dict = {}
        for f, v, e, w, sums in held:
            for at, below, of, value in {(f, v, e, w), (e, w, f, v)}:
                for i, g, h in sums:
                    if splits[i] and splits[i][0] == at:
                        key = i, int(below > splits[i][1]), of, value
                        a, b = cells.get(key, (0, 0))
                        cells[key] = a + g, b + h
        return _folded([(*key, *sums) for key, sums in cells.items()])

    return histograms


def _taught(each: DataFrame) -> tuple[list[Trees], dict[int, tuple]]:
    """The trees of each kind, and (score, n, right) of other documents' candidates by kind. Candidates x are counted by side (teach) and description, and the trees taught where the counts lie.

    The driver gets histograms only: a sum per feature and value, and per bin of a score.
    """
    marks = [F.count_if(f"x.y{i}").alias(f"y{i}") for i in range(len(NAMES))]
    table = cut(each.groupBy("teach", *[F.col(f"x.{f}").alias(f) for f in FEATURES]).agg(F.count("*").alias("n"), *marks, F.expr("count_if(x.y4 or x.known)").alias("right")), "described")
    sides = {r["teach"]: r for r in table.groupBy("teach").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), *[F.sum(f"y{i}").alias(f"y{i}") for i in range(len(NAMES))]).collect()}
    if len(sides) < 2:
        return [], {}
    models = [Trees.open(float(sides[True][f"y{i}"]), float(sides[True]["n"]), SEES.get(name, FEATURES)) for i, name in enumerate(NAMES)]
    # Few descriptions are summed by one task and without a shuffle, for every round is a short job.
    own, other = (table.where(side).coalesce(sides[teach]["rows"] // DESCRIPTIONS + 1) for teach, side in ((True, "teach"), (False, "not teach")))
    boost(models, _summed(own, models))
    right = {i: "right" if name == "secret" else f"y{i}" for i, name in enumerate(NAMES)}
    bins = ", ".join(f"struct({i} as kind, int(floor(({m.sql()}) * {BINS})) as bin, {right[i]} as good)" for i, m in enumerate(models))
    binned = other.alias("x").select("n", F.expr(f"inline(array({bins}))")).groupBy("kind", "bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    scores: dict = {}
    for i, b, seen, good in sorted(map(tuple, binned.collect())):
        scores.setdefault(i, []).append((b / BINS, float(seen), float(good)))
    forget(table)
    return models, {i: tuple(map(np.array, zip(*rows))) for i, rows in scores.items()}


def find(docs: DataFrame, precision: float = 0.98) -> DataFrame:
    """All columns of docs, `_base` and `_spans`: arrays of (s start, k number in NAMES, e end) in order."""
    docs = docs.drop("_base", "_spans")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keep = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = cut(_spans(docs.select(keep.alias("_row"), text.alias("text"))), "spans")
    each = found.select((fold(F.col("_row.doc_id")) < 3).alias("teach"), F.explode("_cand").alias("x"))
    scores, (models, others) = [], _taught(each)
    for i, trees in enumerate(models):
        edge = calibrated(*others[i], min(precision, MARKED) if NAMES[i] == "secret" else precision)
        if edge <= 1:
            scores.append(f"transform(array({trees.sql()}), p -> named_struct('p', if(p >= {edge - 1e-9:.12f}D, p, -1D), 'k', {i}))[0]")
    if not scores:
        return found.select("_row.*", "_base", F.col("_base").alias("_spans"))
    on = " or ".join(f"x.y{i}" for i in range(len(KINDS)))
    scored = f"transform(filter(_cand, x -> not ({on})), x -> named_struct('s', x.s, 'e', x.e, 'top', array_max(array({', '.join(scores)}))))"
    ordered = f"array_sort(transform(filter({scored}, x -> x.top.p >= 0), x -> named_struct('s', x.s, 'back', -x.e, 'k', x.top.k)))"
    # Of overlapping candidates the first stays, and of those that begin together the longest.
    chosen = _scan(ordered, "int", "0", "if(x.s >= c, -x.back, c)", "named_struct('s', x.s, 'k', x.k, 'e', -x.back, 'stays', x.s >= c)")
    added = f"transform(filter({chosen}, x -> x.stays), x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))"
    spans = f"case when size(_cand) > 0 then array_sort(concat(_base, {added})) else _base end"
    return found.withColumn("_spans", F.expr(spans)).select("_row.*", "_base", "_spans")


def counted(spans: str, kind: str) -> Column:
    """How many of the spans are of a kind."""
    return F.expr(f"cast(size(filter({spans}, q -> q.k = {NAMES.index(kind)})) as long)")


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in NAMES) + ")"
    return F.expr(f"array_join(transform({spans}, q -> concat_ws(':', {names}[q.k], q.s, q.e)), ',')")


def redacted(text: str = "text", spans: str = "_spans") -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans count as the first of them."""
    names = "array(" + ", ".join(f"'[{k}]'" for k in NAMES) + ")"
    piece = f"if(x.s < c, '', concat(substring({text}, c + 1, x.s - c), {names}[x.k]))"
    pieces = _scan(spans, "int", "0", "greatest(c, x.e)", piece)
    return F.expr(f"concat(array_join({pieces}, ''), substring(coalesce({text}, ''), coalesce(array_max(transform({spans}, q -> q.e)), 0) + 1))")
