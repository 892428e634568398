"""Landed web pages to rows: result tables, cards, listings, indexes, feeds. Regular expressions inside the JVM.

Pages are rows (url, html); every row made carries its page and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.scalar import WHITE, cell_text, digits_value, money, padded_id, ratio, strip_markup, title_case

ROW, CELL, ANY_CELL, TABLE = r"(?is)<tr[^>]*>(.*?)</tr>", r"(?is)<td[^>]*>(.*?)</td>", r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", r"(?is)<table[^>]*>(.*?)</table>"

def all_of(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def flattened(html: Column) -> Column:
    """Without tooltips, and with tables inside cells, however deep, as the text of their first cell.

    The tags tell how deep a page's tables go; the innermost are flattened as many times, less one.
    """
    bare = F.regexp_replace(html, r"(?s)<div class=['\"]tooltip['\"][^>]*>.*?</div>", "")
    tags = all_of(bare, r"(?i)<table\b|</table\s*>", 0)
    inside = lambda s, tag: F.greatest(F.lit(0), s["now"] + F.when(F.startswith(tag, F.lit("</")), -1).otherwise(1))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    deepest = F.aggregate(tags, start, lambda s, tag: F.struct(inside(s, tag).alias("now"), F.greatest(s["most"], inside(s, tag)).alias("most")))["most"]
    once = lambda text: F.regexp_replace(text, r"(?s)(<td[^>]*>)\s*<table[^>]*>(?:(?!<table|<td).)*(?:<td[^>]*>((?:(?!<table|<td|</td>).)*)</td>)?(?:(?!<table).)*?</table>\s*(</td>)", "$1$2$3")
    return F.when(deepest > 1, F.aggregate(F.sequence(F.lit(2), F.greatest(deepest, F.lit(2))), bare, lambda text, _: once(text))).otherwise(bare)


def table_rows(pages: DataFrame, html: Column, cell: str = CELL) -> DataFrame:
    """Rows of cells: url, row, cells."""
    rows = pages.select("url", F.posexplode(all_of(html, ROW)).alias("row", "_tr"))
    return rows.select("url", "row", F.transform(all_of(F.col("_tr"), cell), cell_text).alias("cells"))


def statewise(pages: DataFrame) -> DataFrame:
    """Rows of the state table: nine cells, a contest number from 1 to 400 and a name of at most 80 characters."""
    c = lambda i: F.get("cells", F.lit(i))
    rounds = F.split(c(7), "/")
    number = lambda x: F.regexp_extract(F.trim(x), r"^(-?\d+)", 1).try_cast("int")
    out = table_rows(pages, flattened(F.col("html"))).where(F.size("cells") >= 9)
    return out.select(
        "url",
        "row",
        number(c(1)).alias("ac_number"),
        c(0).alias("ac_name"),
        c(2).alias("lead"),
        c(3).alias("lead_party"),
        c(4).alias("trail"),
        c(5).alias("trail_party"),
        F.coalesce(F.regexp_replace(c(6), r"[^\d-]", "").try_cast("long"), F.lit(0)).alias("margin"),
        number(F.get(rounds, F.lit(0))).alias("round"),
        number(F.get(rounds, F.lit(1))).alias("rounds"),
        c(8).alias("status"),
        c(8).rlike(r"(?i)result declared|winner|decl\.?\b").alias("declared"),
    ).where("ac_number between 1 and 400 and length(ac_name) between 1 and 80")


def cards(pages: DataFrame) -> DataFrame:
    """One row per contestant card with a name, none-of-the-above left out; `declared` if any card of the page has won."""
    parts = pages.select("url", F.posexplode(F.split("html", r"<div class=['\"]cand-box[^'\"]*['\"][^>]*>", -1)).alias("ord", "_c")).where("ord > 0")
    status = r"(?s)class=['\"]status\s+(\w+)['\"][^>]*>\s*<div[^>]*>.*?</div>\s*<div[^>]*>\s*([\d,\s]+)"
    one = lambda p, g=1: F.regexp_extract("_c", p, g)
    out = parts.select("url", "ord", cell_text(one(r"(?s)<h5[^>]*>(.*?)</h5>")).alias("name"), cell_text(one(r"(?s)<h6[^>]*>(.*?)</h6>")).alias("party"), F.lower(one(status)).alias("status"), digits_value(one(status, 2)).alias("votes"))
    out = out.where((F.col("name") != "") & (F.upper("name") != "NOTA"))
    return out.withColumn("declared", F.bool_or(F.col("status") == "won").over(Window.partitionBy("url")))


def partywise(pages: DataFrame) -> DataFrame:
    """Rows of a party's table: six cells, a running number first, the contest's number in brackets after its name."""
    c = lambda i: F.get("cells", F.lit(i))
    rows = table_rows(pages, F.col("html")).where((F.size("cells") >= 6) & c(0).rlike(r"^\d+$") & c(1).rlike(r"\(\d+\)\s*$"))
    return rows.select("url", "row", F.regexp_extract(c(1), r"\((\d+)\)\s*$", 1).cast("int").alias("ac_number"), c(2).alias("lead"), digits_value(c(3), None).alias("votes")).where("votes is not null")


def linked_ids(pages: DataFrame, pattern: str) -> DataFrame:
    """Distinct ids that a page's links name, by the pattern's group."""
    return pages.select("url", F.explode(F.array_distinct(all_of(F.col("html"), pattern))).alias("id"))


def url_value(url: Column, name: str) -> Column:
    return F.regexp_extract(url, rf"[?&]?{name}=(\d+)", 1)


def best_table(pages: DataFrame, placeholder: str = r"(?i)no result|will be available|coming soon") -> DataFrame:
    """Contestants of each page's table with the most usable rows (two at least, the first of equals), by falling votes.

    A row's votes are its first cell of digits from 50 on, the party the cell before it, the share the cell after it.
    """
    # All of a page lies in its row, so its best table and its total need no shuffle.
    votes_at = lambda cells: F.get(F.filter(F.sequence(F.lit(0), F.size(cells) - 1), lambda i: F.get(cells, i).rlike("^[0-9, ]+$") & (digits_value(F.get(cells, i)) >= 50)), F.lit(0))

    def usable(table: Column) -> Column:
        """Rows (row, cells, at) of a table that have a name, and a cell of votes, at a place after the first."""
        cells = F.transform(all_of(table, ROW), lambda tr, i: F.struct(i.alias("row"), F.transform(all_of(tr, ANY_CELL), cell_text).alias("cells")))
        placed = F.transform(F.filter(cells, lambda r: F.size(r["cells"]) >= 3), lambda r: F.struct(r["row"].alias("row"), r["cells"].alias("cells"), votes_at(r["cells"]).alias("at")))
        return F.filter(placed, lambda r: (r["at"] >= 1) & F.length(F.get(r["cells"], F.lit(0))).between(1, 100))

    def read(r: Column) -> Column:
        share = F.regexp_replace(F.get(r["cells"], r["at"] + 1), r"[^\d.]", "").try_cast("double")
        return F.struct(r["row"].alias("row"), F.get(r["cells"], F.lit(0)).alias("name"), F.get(r["cells"], F.greatest(F.lit(1), r["at"] - 1)).alias("party"), digits_value(F.get(r["cells"], r["at"])).alias("votes"), F.when(share.between(0, 100), share).alias("share"))

    tables = pages.where(~F.col("html").rlike(placeholder)).select("url", F.col("html").rlike(r"\b(?:DECLARED|WINNER)\b").alias("declared"), F.transform(all_of(F.col("html"), TABLE), usable).alias("_t"))
    most = F.array_max(F.transform("_t", F.size))
    # The first of the tables with the most rows.
    best = tables.withColumn("_m", most).where("_m >= 2").select("url", "declared", F.transform(F.get(F.filter("_t", lambda t: F.size(t) == F.col("_m")), F.lit(0)), read).alias("_r"))
    summed = best.select("url", "declared", F.aggregate("_r", F.lit(None).cast("long"), lambda a, r: F.coalesce(a + r["votes"], a, r["votes"])).alias("_total"), F.explode("_r").alias("_x"))
    rows = summed.select("url", "declared", "_x.*", "_total")
    return rows.withColumn("share", F.when(F.coalesce("share", F.lit(0.0)) > 0, F.col("share")).otherwise(ratio(F.col("votes"), F.col("_total"), 100.0))).drop("_total")


def listing(pages: DataFrame) -> DataFrame:
    """Contestants of a listing: numbered rows with an id link; party, education, age, assets and liabilities by cell."""
    start = r"(?is)(<tr[^>]*>\s*<td[^>]*>\s*\d+\s*</td>\s*<td[^>]*>\s*<a\s+href=[\"']?candidate\.php\?candidate_id=\d+[\"']?>[^<]+</a>.*?</tr>)"
    rows = pages.select("url", F.posexplode(all_of(F.col("html"), start)).alias("row", "_tr"))
    cells = F.transform(all_of(F.col("_tr"), CELL), strip_markup)
    c = lambda i: F.get("_cells", F.lit(i))
    badge = F.coalesce(F.regexp_extract("_tr", r"(?i)<b>\s*(\d+)\s*</b>", 1).try_cast("int"), F.regexp_extract("_tr", r"(?i)align=center[^>]*>\s*(\d+)\s*</td>", 1).try_cast("int"), F.lit(0))
    rows = rows.withColumn("_cells", cells).withColumn("cases", badge)
    rupees = lambda i: money(F.regexp_extract(c(i), r"(?i)Rs\s*([\d,]+)", 1))
    return rows.select("url", "row", url_value(F.col("_tr"), "candidate_id").alias("id"), F.trim(F.regexp_extract("_tr", r"(?i)candidate_id=\d+[\"']?>([^<]+)</a>", 1)).alias("name"), c(2).alias("party"), F.coalesce(F.nullif(c(4), F.lit("")), F.lit("Not declared")).alias("education"), F.coalesce(F.regexp_extract(c(5), r"^(\d+)", 1).try_cast("int"), F.lit(0)).alias("age"), "cases", rupees(6).alias("assets"), rupees(7).alias("liabilities"))


def detail(pages: DataFrame, photo: str = r"(?i)(https?://\S+?/images_candidate/\S+?\.jpg)") -> DataFrame:
    """Photo, gender, occupation and party of a contestant's page, each by the first pattern that fits."""
    def first(*patterns: str) -> Column:
        found = [F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("html", p, 1), "&nbsp;", " "), f"{WHITE}+", " ")), F.lit("")) for p in patterns]
        return F.coalesce(*found)

    work = first(r"(?i)Profession\s*[^<]*<[^>]+>\s*([^<]{2,80})<", r"(?i)Occupation\s*[^<]*<[^>]+>\s*([^<]{2,80})<")
    party = first(r"(?i)Party\s*:?\s*</[^>]+>(?:&nbsp;|\s)*([^<]{2,60})", r"(?i)>Party<[^>]*>(?:&nbsp;|\s)*<[^>]*>(?:&nbsp;|\s)*([^<]{2,60})", r"(?i)Party[^<]{0,20}<b>([^<]{2,60})</b>")
    return pages.select("url", first(photo).alias("photo"), F.coalesce(first(r"(?i)Gender[^<]*<[^>]+>\s*(Male|Female)"), F.lit("Male")).alias("gender"), F.when(~work.isin("NIL", "-"), work).alias("occupation"), F.when(~party.isin("N/A", "-"), party).alias("party"))


def titled_detail(pages: DataFrame, photo: str = r"(?i)(https?://\S+?/images_candidate/\S+?\.jpg)") -> DataFrame:
    """A contestant's page read by its title, name(party(short)):contest, and by its labels; pages without those give no row.

    The page's text names sons, daughters and wives in one label, so a page with that label is of a woman, unless it
    states a gender. A page of fewer than 500 characters is an error page.
    """
    one = lambda p, g=1, of="html": F.nullif(F.trim(F.regexp_replace(F.regexp_replace(strip_markup(F.regexp_extract(of, p, g)), "&nbsp;", " "), f"{WHITE}+", " ")), F.lit(""))
    read = pages.where(F.length("html") >= 500).withColumn("_title", F.regexp_extract("html", r"(?i)<title>([^<]+)</title>", 1))
    seat = F.regexp_extract("html", r"(?i)constituency_id=(\d+).*?>([^<]+)</a>\s*&rarr;\s*<b>", 1)
    related = F.col("html").rlike(r"(?i)<b>S/o\|D/o\|W/o:</b>\s*[^<]+")
    number = lambda p: F.coalesce(F.regexp_extract("html", p, 1).try_cast("int"), F.lit(0))
    out = read.where(F.col("_title").rlike(r"^[^(]+\(") & (seat != "")).select(
        "url",
        title_case(F.trim(F.regexp_extract("_title", r"^([^(]+)\(", 1))).alias("name"),
        F.coalesce(one(r"(?i)<b>Party:</b>\s*([^<\s][^<]*?)\s*</div>"), F.nullif(F.trim(F.regexp_extract("_title", r"\(([A-Z()\s\-]+)\)\s*:", 1)), F.lit("")), F.lit("IND")).alias("party"),
        padded_id(F.regexp_replace(seat, "^0+(?=.)", "")).alias("contest"),
        F.nullif(F.regexp_extract("html", photo, 1), F.lit("")).alias("photo"),
        number(r"(?i)<b>Age:</b>\s*(\d+)").alias("age"),
        F.coalesce(F.nullif(F.regexp_extract("html", r"(?i)Gender[^<]*>\s*(Male|Female)", 1), F.lit("")), F.when(related, "Female").otherwise("Male")).alias("gender"),
        F.coalesce(one(r"(?i)<b>Self Profession:</b>\s*([^<\n\r]+)"), F.lit("")).alias("occupation"),
        one(r"(?i)<b>Spouse Profession:</b>\s*([^<\n\r]+)").alias("spouse_occupation"),
        number(r"(?i)Number of Criminal Cases:\s*<span[^>]*>(\d+)</span>").alias("cases"),
    )
    return out


def finances(pages: DataFrame, section: str, until: str) -> DataFrame:
    """The last amount in purple between two headings of a page."""
    part = F.regexp_extract("html", f"(?s){section}(.*?)(?:{until}|$)", 1)
    totals = all_of(part, r"(?is)color:\s*purple[^>]*>(?:<b>)?\s*(?:Rs\.?)?\s*([\d,]+)")
    return pages.select("url", money(F.element_at(F.when(F.size(totals) > 0, totals), -1)).alias("total"))


def index(pages: DataFrame, heading: str, link: str) -> DataFrame:
    """Links of an index page with the heading that stands before them."""
    both = pages.select("url", F.posexplode(all_of(F.col("html"), f"(?s)({heading}|{link})")).alias("pos", "_x"))
    carried = F.last(F.when(F.col("_x").rlike(heading), F.trim(F.regexp_extract("_x", heading, 1))), ignorenulls=True).over(Window.partitionBy("url").orderBy("pos"))
    named = both.withColumn("district", carried).where(F.col("_x").rlike(link))
    return named.select("url", "pos", "district", F.regexp_extract("_x", link, 1).alias("id"), F.trim(F.regexp_extract("_x", link, 2)).alias("name"))


def first_table(pages: DataFrame, css: str, name_cell: int = 1) -> DataFrame:
    """Rows of a page's first table of a class, its header and rows without a name left out."""
    part = F.regexp_extract("html", rf"(?is)<table[^>]*class=[\"'][^\"']*{css}[^\"']*[\"'][^>]*>(.*?)</table>", 1)
    return table_rows(pages, part).where((F.col("row") > 0) & (F.coalesce(F.get("cells", F.lit(name_cell)), F.lit("")) != ""))


def feed(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Items of an RSS page with a title and a link."""
    items = pages.select("url", F.posexplode(all_of(F.col("html"), r"(?s)<item>(.*?)</item>")).alias("pos", "_i"))
    tag = lambda t: F.trim(F.regexp_replace(F.regexp_extract("_i", rf"(?s)<{t}[^>]*>(.*?)</{t}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))
    link = F.coalesce(F.nullif(F.regexp_extract("_i", r"<link>(https?[^<]+)</link>", 1), F.lit("")), F.regexp_extract("_i", r'href="(https?[^"]+)"', 1))
    out = items.select("url", "pos", tag("title").alias("title"), F.trim(link).alias("link"), tag("source").alias("source"), tag("pubDate").alias("published")).where("title <> '' and link <> ''")
    return out.where(F.col("pos") < limit) if limit is not None else out
