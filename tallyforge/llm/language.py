"""Language identification by cross-parsing entropy.

Per language, a suffix automaton of labelled text is the dictionary of a cross-parse: a text is cut greedily into the
longest phrases that occur in that language's text, and the language that needs the fewest phrases, relative to what
its own unseen text needs, wins. The automata are built from a bounded, seeded sample of labelled rows per language
(a parameter), whatever number of languages and letters there are, and become one table of the edges that exist, laid
out by displacement: a state is the place from which its edges are counted by symbol, and no two states share one. A
missing edge leads to the root's and counts a phrase; many stretches of text then walk through the table side by side in
NumPy, for all languages at once. Stretches have a fixed length, so a very long text is many short walks, and every
character of it counts. The table grows with the languages, by a MB or two each, up to what MODEL_CHARS gives; of more
languages less of each is learned. The work a character grows with their number.

Defined results: null text and text without a letter are `und` with score 0; so is everything if no labelled row can
be learned from; ties go to the language first in order; repeated rows get equal results; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import map_text

#: Labelled documents read and characters learned per language, and characters learned of all languages together.
SAMPLE_DOCS, LEARN_CHARS, MODEL_CHARS = 160, 36_000, 9_000_000
#: Characters per walk, and walks of all languages side by side.
STRETCH, LANES = 256, 65_536
UNKNOWN = "und"


@lru_cache(1)
def _lower() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point, whether it is a letter or mark, and the lower case of it."""
    points = [chr(c) for c in range(0x110000)]
    return np.array([unicodedata.category(c)[0] in "LM" for c in points]), np.array([ord(c.lower()[0]) for c in points], np.uint32)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Symbols:
    """Code points to codes: 0 for anything that isn't a letter, 1 for letters the samples lack, one for each other letter."""

    def __init__(self, texts: list[str]) -> None:
        letter, lower = _lower()
        seen = np.unique(np.concatenate([np.zeros(0, np.uint32), *(lower[np.unique(_points(t))] for t in texts)]))
        seen = seen[letter[seen]]
        self.size = len(seen) + 2
        own = np.ones(len(letter), np.min_scalar_type(self.size))
        own[seen] = np.arange(2, self.size)
        self.codes = np.where(letter, own[lower], 0).astype(own.dtype)

    def encode(self, text: str) -> np.ndarray:
        """Codes of a text, with each run of code 0 as one; empty if there is no letter."""
        codes = self.codes[_points(text)]
        if not codes.any():
            return codes[:0]
        keep = codes > 0
        keep[1:] |= codes[:-1] > 0
        return codes[keep]


def automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """The edges of each state of the suffix automaton, symbol to state; the root is state 0."""
    edges, link, length, last = [{}], [-1], [0], 0
    for c in codes.tolist():
        new = len(edges)
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return edges


def displaced(edges: list[dict[int, int]], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """A place for each state, no two the same, and the table where a state's edge by c is (state's place, target's) at place + c."""
    used, places, at, taken = bytearray(2 * symbols), [0] * len(edges), 0, set()
    order = sorted(range(len(edges)), key=lambda s: -len(edges[s]))
    for s in order:
        own = list(edges[s])
        if len(own) == 1:
            break
        while any(used[at + c] for c in own):
            at += 1
            if at + symbols >= len(used):
                used.extend(bytes(len(used)))
        for c in own:
            used[at + c] = 1
        places[s] = at
        taken.add(at)
        at += 1
        if at + symbols >= len(used):
            used.extend(bytes(len(used)))
    # One edge fits any free place from which the state's own place is still free.
    free = symbols
    for s in order[len(taken) :]:
        c = next(iter(edges[s]), 0)
        while used[free] or free - c in taken:
            free += 1
            if free >= len(used):
                used.extend(bytes(len(used)))
        used[free] = 1
        places[s] = free - c
        taken.add(free - c)
        free += 1
        if free >= len(used):
            used.extend(bytes(len(used)))
    place = np.array(places, np.int64)
    table = np.full((max(places) + symbols, 2), -1, np.int32)
    source = np.repeat(np.arange(len(edges)), [len(e) for e in edges])
    symbol = np.array([c for e in edges for c in e], np.int64)
    target = np.array([t for e in edges for t in e.values()], np.int64)
    table[place[source] + symbol] = np.stack([place[source], place[target]], 1)
    return place, table


def rate(edges: list[dict[int, int]], codes: np.ndarray) -> float:
    """Phrases a symbol that a text needs of an automaton."""
    count = -(-len(codes) // STRETCH)
    for i, c in enumerate(codes.tolist()):
        state = 0 if i % STRETCH == 0 else state
        count += c not in edges[state]
        state = edges[state][c] if c in edges[state] else edges[0].get(c, 0)
    return count / len(codes)


class Model:
    """What the labelled sample teaches: symbols, one walk table for all languages, and each language's own rate."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.langs = sorted(samples)
        self.symbols = Symbols([t for ts in samples.values() for t in ts])
        tables, begins, roots, own, at = [], [], [], [], 0
        most = min(LEARN_CHARS, MODEL_CHARS // max(1, len(self.langs)))
        for lang in self.langs:
            codes = [c for c in map(self.symbols.encode, samples[lang]) if len(c)]
            learn, held, n = [], [], 0
            for i, c in enumerate(codes):
                if n < most and (i % 4 < 3 or len(codes) < 4):
                    learn.append(c[: most - n])
                    n += len(learn[-1])
                else:
                    held.append(c[:2000])
            known = np.concatenate(learn or [np.zeros(1, np.uint8)])
            edges = automaton(known)
            place, table = displaced(edges, self.symbols.size)
            # A missing edge closes a phrase and begins the next one by the root's edge.
            begin = np.full(self.symbols.size, place[0] + at, np.int32)
            begin[list(edges[0])] = place[list(edges[0].values())] + at
            begins.append(begin)
            tables.append(np.where(table >= 0, table + at, -1).astype(np.int32))
            roots.append(place[0] + at)
            # Too few documents to hold one back: the last quarter of them stands for it, against the rest.
            part = len(known) * 3 // 4
            own.append(held or rate(automaton(known[:part]), known[part:]))
            at += len(table)
        # Both parts of an entry are read at once.
        self.table = np.concatenate(tables).view(np.int64).ravel() if tables else np.zeros(0, np.int64)
        self.begins = np.array(begins, np.int32)
        self.roots = np.array(roots, np.int32)
        self.own = np.ones(len(self.langs))
        for i, held in enumerate(own):
            self.own[i] = self.phrases(held)[i].sum() / max(1, sum(map(len, held))) if isinstance(held, list) else held

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that each language needs for each text, (language, text)."""
        out = np.zeros((len(self.langs), len(texts)))
        sizes = np.array([len(t) for t in texts], np.int64)
        flat = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
        parts = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(texts)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(np.cumsum(sizes) - sizes, parts) + nth * STRETCH
        left = np.minimum(STRETCH, sizes[owner] - nth * STRETCH)
        order = np.argsort(-left, kind="stable")
        lanes = max(1, LANES // max(1, len(out)))
        for lo in range(0, len(order), lanes):
            lane = order[lo : lo + lanes]
            begin, many = start[lane], left[lane]
            live = np.searchsorted(-many, -np.arange(many[0]) - 1, side="right")
            state = np.repeat(self.roots[:, None], len(lane), 1)
            count = np.zeros(state.shape, np.int32)
            for t, n in enumerate(live.tolist()):
                symbol, now = flat[begin[:n] + t], state[:, :n]
                source, target = np.moveaxis(self.table[now + symbol].view(np.int32).reshape(*now.shape, 2), 2, 0)
                missing = source != now
                count[:, :n] += missing
                state[:, :n] = np.where(missing, self.begins[:, symbol], target)
            for i in range(len(out)):
                out[i] += np.bincount(owner[lane], count[i] + 1, len(texts))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        codes = [self.symbols.encode(t or "") for t in texts]
        has = [i for i, c in enumerate(codes) if len(c)] if self.langs else []
        out = [(UNKNOWN, 0.0)] * len(texts)
        if has:
            used = [codes[i] for i in has]
            rate = self.phrases(used) / np.array([len(c) for c in used]) / self.own[:, None]
            best = rate.argmin(0)
            # The margin in phrases, as a share: how surely the winner needs fewer than the others.
            share = np.exp(-4 * (rate - rate.min(0)))
            score = 1 / share.sum(0)
            for i, b, s in zip(has, best.tolist(), score.tolist()):
                out[i] = (self.langs[b], s)
        return out


def learn(labelled: DataFrame, docs: int = SAMPLE_DOCS) -> Model:
    """A model of every language from rows with text and lang: per language the rows of the lowest seeded hashes, `docs` at most.

    One pass counts rows per language; the other reads about the rows that are kept, so what reaches the driver is
    bounded by the parameters and the number of languages at every size.
    """
    rows = labelled.where("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", F.lit(17)).alias("h"), F.col("text").cast("string").alias("text"))
    counts = rows.groupBy("lang").count().collect()
    highest = [(r["lang"], min(2**63 - 1, int(-(2**63) + min(1.0, 2 * docs / r["count"]) * (2**64 - 1)))) for r in counts]
    pick = labelled.sparkSession.createDataFrame(highest, "lang string, highest long")
    chars = 2 * min(LEARN_CHARS, MODEL_CHARS // max(1, len(counts))) // docs + 2000
    kept = rows.join(F.broadcast(pick), "lang").where("h <= highest").select("lang", "h", F.substring("text", 1, chars).alias("text")).limit(4 * docs * max(1, len(counts))).collect()
    samples: dict[str, list[str]] = {r["lang"]: [] for r in counts}
    for r in sorted(kept, key=lambda r: (r["h"], r["text"])):
        if len(samples[r["lang"]]) < docs and r["text"] not in samples[r["lang"]]:
            samples[r["lang"]].append(r["text"])
    return Model({k: v for k, v in samples.items() if v})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs and `_lang_pred`, `_lang_score`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_text(docs, "_lang_pred string, _lang_score double", lambda texts: list(zip(*shared.value.predict(texts))))
