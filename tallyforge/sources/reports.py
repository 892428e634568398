"""Plain-text result reports to rows: one pass over each report's lines, carrying its header, turnout and open row.

A report is a row (report, text) of the size of a file; Spark deals the reports over tasks, and a task reads one at a time.
Most lines are contestants of the usual shape, which one pattern reads whole; the lines between two of these go through the
steps for all shapes, which give a usual line the same row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines that are page furniture, party and category words, in the order in which they are tried.
NOISE = (
    r"(?i)Election Commission of India|DETAILED RESULTS|CANDIDATE NAME|VALID VOTES POLLED|%\s*VOTES|VOTES\s*POLLED|STATISTICAL REPORT"
    r"|^\s*Page\s+\d+|^\s*ST\d+|^\s*GENERAL ELECTION|^\s*LEGISLATIVE ASSEMBLY|^\s*WEST BENGAL\s*$|^\s*NEW DELHI"
)
PARTIES = (
    "CPI(M)", "SUCI(C)", "JD(S)", "JD(U)", "SP(I)", "DSP(P)", "RSSCMJP", "JSTDVPMTP", "GOJAM", "AITC", "BJP", "CPM", "CPI", "INC",
    "BSP", "AIFB", "AIMIM", "NCP", "SUCI", "RSP", "SP", "RLSP", "AIMF", "WPOI", "KPPU", "AMB", "IUML", "JMM",
    "BLSP", "BMF", "ABHM", "SHS", "RJD", "PDCI", "RPI", "PDS", "AAP", "HUMP", "ISF", "GJM", "IND", "NOTA",
)
TAIL = r"\s(\d+)\s+(\d+)\s+(\d+)\s+(\d+(?:\.\d+)?)\s*$"
LEAD = r"^\s+(\d+)\s+(.+)$"
HEADER = r"(?i)^\s*(Constituency\s+)?(\d{1,3})\s*\.\s*(.+?)\s+TOTAL\s+ELECTORS\s*:?\s*(\d+)\s*$"
TURNOUT = r"(?i)TURN\s*OUT.+?TOTAL:\s*(\d+)\s+(\d+)\s+(\d+)\s+(\d+(?:\.\d+)?)"
#: Contests of a report; a header that lacks its first word counts for these numbers alone, and once.
SEATS = 294
#: Contestants that a task hands on at a time, and those of one report more.
ROWS = 10_000
PAGE = r"(?i)\s+Page\s+\d+(\s+of\s+\d+)?(\s|$)"

_NOISE, _TAIL, _LEAD, _HEADER, _TURNOUT, _PAGE = (re.compile(p, re.ASCII) for p in (NOISE, TAIL, LEAD, HEADER, TURNOUT, PAGE))
#: Each line that NOISE matches holds one of these.
_MAY_BE_NOISE = ("ELECTION", "RESULTS", "CANDIDATE NAME", "VOTES", "REPORT", "PAGE", "ST", "ASSEMBLY", "BENGAL", "DELHI")
_SHORT, _LONE, _FRESH = re.compile(r"\s\d+\s+\d+\s+\d+\s*$"), re.compile(r"^\s*\d+(?:\.\d+)?\s*$"), re.compile(r"^\s+\d+\s+[A-Z]")
_SEAT = re.compile(r"(?i)\s*\(\s*(?:SC|ST|GEN|GENERAL)\s*\)\s*$")
_WORDS = re.compile(r"^(?!PAGE\b)[A-Za-z][A-Za-z .'()\-]{1,40}$", re.IGNORECASE)
_NONE = re.compile(r"(?i)^\s*NOTA\b|\bNOTA\s+NOTA\s+NOTA\b")
#: A whole contestant's line: number, name, sex, age, category, party and votes next to each other; the share may stand on the next line.
_USUAL = re.compile(r"\s+(\d+)\s+([A-Z][^:]*?)\s+(MALE|FEMALE|M|F)\s+(\d{2,3})\s+(GENERAL|GEN|SC|ST|NOTA)\s+(\S+)\s+(\d+)\s+(\d+)\s+(\d+)(?:\s+(\d+(?:\.\d+)?))?\s*$", re.ASCII)
_NUMBER, _WIDE = re.compile(r"^\s+\d+\s+"), re.compile(r"\s{8,}")
_CATEGORY, _AGE, _SEX = re.compile(r"\b(GENERAL|GEN|SC|ST|NOTA)\b"), re.compile(r"\s(\d{2,3})\s*$"), re.compile(r"\b(MALE|FEMALE|M|F)\b")

SCHEMA = "report string, ac_number int, constituency string, electors long, turnout double, position int, candidate string, sex string, age int, category string, party string, votes_general long, votes_postal long, votes long, vote_share_pct double"


def noise(line: Column) -> Column:
    return line.rlike(NOISE)


def party_words(parties: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"(?:^|\s)(" + "|".join(map(re.escape, parties)) + r")(?=\s|$)")


def _kept(text: str) -> Iterator[tuple[int, str]]:
    """Numbered lines without page marks, blank lines and furniture; few lines hold a word of those, and only they are searched."""
    whole = text.upper()
    words = [w for w in _MAY_BE_NOISE if w in whole]
    for number, (line, large) in enumerate(zip(text.split("\n"), whole.split("\n"))):
        if not line or line.isspace():
            continue
        for w in words:
            if w in large:
                line = _PAGE.sub(" ", line) if "PAGE" in large else line
                if not _NOISE.search(line) and line.strip():
                    yield number, line
                break
        else:
            yield number, line


def _ends(line: str) -> bool:
    """Whether a line may end with a number."""
    return line.rstrip()[-1:].isdigit()


def _fused(lines: Iterator[tuple[int, str]], within: int, opens: Callable, closes: Callable) -> Iterator[tuple[int, str]]:
    """Lines that lack their end, fused with the next one where that is an end and not far."""
    held = None
    for number, line in lines:
        if held and number - held[0] <= within and closes(line):
            yield held[0], f"{held[1].rstrip()}  {line.strip()}"
            held = None
            continue
        if held:
            yield held
        held = (number, line) if opens(line) else None
        if not held:
            yield number, line
    if held:
        yield held


def _last(pattern: re.Pattern, text: str) -> tuple[str, str]:
    """What the pattern's last match holds, and the text before it."""
    found = None
    for found in pattern.finditer(text):
        pass
    return (found[1], text[: found.start()]) if found else ("", text)


def dissected(middle: str, party: re.Pattern) -> tuple[str, str, str, str, str]:
    """Name, sex, age, category and party of the middle of a contestant's line, each the last that stands before the next."""
    if _NONE.search(middle):
        return "NOTA", "", "", "NOTA", "NOTA"
    side, rest = _last(party, middle)
    category, rest = _last(_CATEGORY, rest)
    age, rest = _last(_AGE, rest)
    sex, rest = _last(_SEX, rest)
    return " ".join(_WIDE.split(rest, 1)[0].split()), sex, age, category, side


def usual_parties(parties: tuple[str, ...]) -> frozenset:
    """The parties of usual lines; none where one holds white space or no letter, so that its end isn't sure."""
    return frozenset() if any(re.search(r"\s", p) or not re.search("[A-Za-z]", p) for p in parties) else frozenset(parties)


def contests(text: str, party: re.Pattern, usual: frozenset = frozenset()) -> list[dict]:
    """The contests of a report with their contestants; a header that comes again starts its contest anew."""
    found: dict[int, dict] = {}
    now, row, indent = None, None, 0

    def shaped(line: str) -> re.Match | None:
        # NOTA stands for other columns, and is told by the steps for all shapes.
        own = _USUAL.match(line)
        return own if own and own[6] in usual and "NOTA" not in own[2].upper() else None

    def add(own: re.Match, share: str) -> None:
        nonlocal row, indent
        if now:
            position, name, sex, age, category, side, general, postal, votes, _ = own.groups()
            if "  " in name or not name.isprintable():
                name = " ".join(_WIDE.split(name, 1)[0].split())
            row, indent = [int(position), name, sex, int(age), category, side, int(general), int(postal), int(votes), float(share)], own.start(1)
            now["rows"].append(row)

    def read(between: list[tuple[int, str]]) -> None:
        """Takes the lines between two of the usual shape: neither opens a line that lacks its end nor closes one."""
        nonlocal now, row, indent
        lines = _fused(between, 3, lambda x: _ends(x) and _SHORT.search(x) and not _TAIL.search(x), _LONE.match)
        lines = _fused(lines, 2, lambda x: _LEAD.match(x) and not _TAIL.search(x), lambda x: _TAIL.search(x) and not _FRESH.match(x))
        for _, line in lines:
            head = _HEADER.match(line) if "." in line and "ELECTORS" in line.upper() else None
            if head and (head[1] or 1 <= int(head[2]) <= SEATS and int(head[2]) not in found):
                now, row = {"number": int(head[2]), "name": _SEAT.sub("", head[3].strip()).strip(), "electors": int(head[4]), "turnout": None, "rows": []}, None
                found[now["number"]] = now
            elif now is None:
                continue
            elif ":" in line and (turnout := _TURNOUT.search(line)):
                now["turnout"], row = float(turnout[4]), None
            elif (tail := _ends(line) and _TAIL.search(line)) and (lead := _LEAD.match(line)):
                name, sex, age, category, side = dissected(_NUMBER.sub("", line[: tail.start()]), party)
                row = [int(lead[1]), name, sex, int(age) if age else None, category, side, *map(int, tail.groups()[:3]), float(tail[4])]
                now["rows"].append(row)
                indent = len(line) - len(line.lstrip())
            elif row and not tail and len(line) - len(line.lstrip()) <= indent + 8 and _WORDS.match(line.strip()):
                # A line of letters alone, not far to the right, goes on with the name above it.
                row[1] = " ".join(f"{row[1]} {line}".split())

    between: list[tuple[int, str]] = []
    held = None
    for number, line in _kept(text):
        if held:
            at, short, own = held
            held = None
            if number - at <= 3 and line.isascii() and _LONE.match(line):
                if between:
                    read(between)
                    between = []
                add(own, line.strip())
                continue
            between.append((at, short))
        if not (own := shaped(line)):
            between.append((number, line))
        elif not own[10]:
            held = number, line, own
        else:
            if between:
                read(between)
                between = []
            add(own, own[10])
    if held:
        between.append(held[:2])
    read(between)
    return list(found.values())


def results(files: DataFrame, parties: tuple[str, ...] = PARTIES) -> DataFrame:
    """One row per contestant of reports (report, text), with its contest's number, name, electors and turnout. A null text has none."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    schema = pa.schema([pa.field(n, kinds[t]) for n, t in (x.split() for x in SCHEMA.split(", "))])
    words, usual = party_words(parties), usual_parties(parties)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for report, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for c in contests(text.as_py() or "", words, usual):
                    head = (report, c["number"], c["name"], c["electors"], c["turnout"])
                    rows.extend((*head, *row) for row in c["rows"])
                if len(rows) >= ROWS:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    return files.select(F.col("report").cast("string"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
