"""Report-archive ingestion: text and HTML monthly reports.

Fetching is out of scope; ingestion starts from a table of stored
documents ``(doc_id, url, body)``.  Text and HTML reports are parsed with
native expressions.

Every document ends with a status ('ok', 'parsed_zero_rows',
'unsupported_format', 'no_table', 'not_found'); nothing raises, and the rejects form a ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainfold.functions.clean import (COMPASS_DEGREES, iso_date, report_int, report_number, report_time, report_wind_dir,
                                      sentinel_to_null, strip_approx_mark, strip_text, text_to_double)

# Fixed value: one line of a monthly text report (F7): day, mean, high,
# high time, low, low time, heating and cooling degree days, rain, mean
# wind, high wind, high-wind time, dominant direction.
TEXT_ROW_PATTERN = (r"^\s*(\d{1,2})\s+(-?\d+\.\d)\s+(-?\d+\.\d)\s+(\d{1,2}:\d{2})\s+(-?\d+\.\d)\s+"
                    r"(\d{1,2}:\d{2})\s+(-?\d+\.\d)\s+(-?\d+\.\d)\s+(-?\d+\.\d)\s+(-?\d+\.\d)\s+"
                    r"(-?\d+\.\d)\s+(\d{1,2}:\d{2})\s+([A-Z]{1,3})\s*$")

TEXT_FIELDS = ["day", "mean_temp_c", "max_temp_c", "max_temp_time", "min_temp_c", "min_temp_time",
               "heat_deg_days", "cool_deg_days", "rain_mm", "avg_wind_kmh", "max_wind_kmh", "max_wind_time",
               "dom_wind_dir"]
TEXT_TIMES = {"max_temp_time", "min_temp_time", "max_wind_time"}

# Positions of the fields in a row-wise HTML report (S8); a 19th
# cell repeats the day.
HTML_FIELDS = ["day", "max_temp_c", "min_temp_c", "mean_temp_c", "dep_from_normal_c", "avg_dew_point_c", "avg_wet_bulb_c",
               "heat_deg_days", "cool_deg_days", "sig_condition", "sun_hours", "snow_fall_cm", "rain_mm",
               "avg_sea_level_pressure_hpa", "avg_wind_kmh", "dom_wind_dir", "max_wind_kmh", "max_wind_dir_deg"]
HTML_MIN_CELLS = 17
HTML_TEXTS = {"sig_condition", "dom_wind_dir"}


def parse_text_reports(docs: DataFrame, keys: tuple[str, ...] = ("doc_id", "year", "month")) -> DataFrame:
    """One row per matching line; non-matching lines are dropped (count
    them with :func:`text_line_stats`)."""
    keys = list(keys)
    lines = docs.select(*keys, F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    hit = lines.where(F.col("line").rlike(TEXT_ROW_PATTERN))
    # the pattern is 13 whitespace-separated fields anchored at both ends, so a
    # matching line splits into exactly its 13 groups (one split, not 13 regexes)
    tokens = F.split(F.regexp_replace(F.col("line"), r"^\s+|\s+$", ""), r"\s+")
    hit = hit.withColumn("_tok", tokens)
    cols = []
    for i, name in enumerate(TEXT_FIELDS):
        raw = F.get(F.col("_tok"), i)
        if name == "day":
            cols.append(raw.try_cast("int").alias(name))
        elif name in TEXT_TIMES:
            cols.append(report_time(raw).alias(name))
        elif name == "dom_wind_dir":
            cols.append(report_wind_dir(raw).alias(name))
        else:
            cols.append(raw.try_cast("double").alias(name))
    out = hit.select(*keys, *cols)
    return out.withColumn("date", iso_date("year", "month", "day")).withColumn("source_format", F.lit("txt"))


# The HTML character references decoded in cell text.
HTML_ENTITIES = [("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                 ("&#39;", "'"), ("&amp;", "&")]


def _cell_text(c: F.Column) -> F.Column:
    # one value per text node: line ends of the source are blanks, line and block tags separate
    t = F.regexp_replace(F.translate(c, "\r\n", "  "), r"(?i)</?(?:br|p|div|li)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for ent, ch in HTML_ENTITIES:
        t = F.replace(t, F.lit(ent), F.lit(ch))
    t = F.replace(t, F.lit("\u00a0"), F.lit(" "))
    return strip_text(t)


_COMMENT = r"(?s)<!--.*?-->"


def n_tables(body: F.Column) -> F.Column:
    return F.regexp_count(F.regexp_replace(body, _COMMENT, ""), F.lit(r"(?i)<table\b"))


# Tags that open or close a table, a section, a row or a cell.
_TABLE_TAG = r"(?i)(</?(?:table|thead|tbody|tfoot|tr|td|th)\b[^>]*>)"
_CELL = "struct<a:int,b:int>"
_OPEN = f"struct<t:int,inside:boolean,start:int,cells:array<{_CELL}>>"


def _once(value: F.Column, use) -> F.Column:
    """``use(value)`` with the value computed once, wherever it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _pieces(body: F.Column) -> F.Column:
    """The body cut in front of every table tag, comments left out."""
    clean = F.regexp_replace(F.translate(body, "\u0001", " "), _COMMENT, "")
    return F.split(F.regexp_replace(clean, _TABLE_TAG, "\u0001$1"), "\u0001")


def _walk(pieces: F.Column) -> F.Column:
    """Rows of all tables as (table, cells), a cell being the pieces from ``a``
    up to ``b``: a fold over the pieces that keeps a stack of the open tables,
    each with its open row and cell.

    A row or cell ends where it is closed or where the next one (or the end of
    its row, section or table) begins, so closing tags may be left out as the
    markup language allows.  A table inside a cell is a table of its own; its
    text also belongs to that cell.  Cells outside rows are ignored."""
    def opened(t, inside, start, cells) -> F.Column:
        return F.struct(t.cast("int").alias("t"), inside.alias("inside"), start.cast("int").alias("start"), cells.alias("cells"))

    def ended(top: F.Column, i: F.Column) -> F.Column:
        cell = F.array(F.struct(top["start"].alias("a"), i.cast("int").alias("b")))
        return F.when(top["start"].isNull(), top["cells"]).otherwise(F.concat(top["cells"], cell))

    def row(top: F.Column, i: F.Column) -> F.Column:
        return F.array(F.struct(top["t"].alias("t"), ended(top, i).alias("cells")))

    nothing, no_cells = F.lit(None).cast("int"), F.array().cast(f"array<{_CELL}>")

    def step(s: F.Column, p: F.Column) -> F.Column:
        tag, i = p["tag"], p["i"]
        stack, out = s["stack"], s["out"]
        top, under = F.element_at(stack, -1), F.slice(stack, F.lit(1), F.size(stack) - 1)
        done = F.when(top["inside"], F.concat(out, row(top, i))).otherwise(out)

        def state(stack_, n, out_) -> F.Column:
            return F.struct(stack_.alias("stack"), n.cast("int").alias("n"), out_.alias("out"))

        def on_top(new: F.Column) -> F.Column:
            return F.concat(under, F.array(new))

        return (F.when(tag == "", s)
                .when(tag == "table", state(F.concat(stack, F.array(opened(s["n"], F.lit(False), nothing, no_cells))), s["n"] + 1, out))
                .when(F.size(stack) == 0, s)
                .when(tag == "/table", state(under, s["n"], done))
                .when(tag == "tr", state(on_top(opened(top["t"], F.lit(True), nothing, no_cells)), s["n"], done))
                .when(tag.isin("td", "th"), state(on_top(opened(top["t"], top["inside"], F.when(top["inside"], i), ended(top, i))), s["n"], out))
                .when(tag.isin("/td", "/th"), state(on_top(opened(top["t"], top["inside"], nothing, ended(top, i))), s["n"], out))
                .otherwise(state(on_top(opened(top["t"], F.lit(False), nothing, no_cells)), s["n"], done)))

    tags = F.transform(pieces, lambda p, i: F.struct(F.lower(F.regexp_extract(p, r"(?i)^<(/?(?:table|thead|tbody|tfoot|tr|td|th))\b", 1)).alias("tag"),
                                                     i.alias("i")))
    start = F.struct(F.array().cast(f"array<{_OPEN}>").alias("stack"), F.lit(0).alias("n"),
                     F.array().cast(f"array<struct<t:int,cells:array<{_CELL}>>>").alias("out"))
    # tables that are never closed end with the document
    return F.aggregate(tags, start, step, lambda s: F.concat(
        s["out"], F.flatten(F.transform(F.filter(s["stack"], lambda t: t["inside"]), lambda t: row(t, F.size(tags))))))


def _span(piece: F.Column, name: str) -> F.Column:
    tag = F.regexp_extract(piece, r"^<[^>]*>", 0)
    found = F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*[\"']?\s*(\d{{1,3}})", 1).try_cast("int")
    return F.greatest(F.coalesce(found, F.lit(1)), F.lit(1))


def _grid(rows: F.Column) -> F.Column:
    """Rows of (text, across, down) → rows of texts: a cell fills the columns
    and rows that it spans.  Per column the fold carries the text that still
    reaches down and for how many rows; a row's cells take the columns that are
    left.  Spans end with the table."""
    reach = "array<struct<text:string,left:int>>"

    def step(s: F.Column, row: F.Column) -> F.Column:
        wide = F.flatten(F.transform(row, lambda c: F.array_repeat(F.struct(c["text"].alias("text"), (c["down"] - 1).alias("left")), c["across"])))
        before = s["reach"]
        taken = lambda k: F.coalesce(F.get(before, k)["left"], F.lit(0)) > 0
        free = F.filter(F.sequence(F.lit(0), F.size(before) + F.size(wide)), lambda k: ~taken(k))
        last = F.greatest(F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), F.size(before)), taken)), F.lit(-1)),
                          F.when(F.size(wide) > 0, F.get(free, F.size(wide) - 1)).otherwise(F.lit(-1)))
        columns = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        filled = F.transform(columns, lambda k: F.when(taken(k), F.struct(F.get(before, k)["text"].alias("text"), (F.get(before, k)["left"] - 1).alias("left")))
                             .otherwise(F.get(wide, (F.array_position(free, k) - 1).cast("int"))))
        return F.struct(F.concat(s["out"], F.array(F.transform(filled, lambda c: c["text"]))).alias("out"), filled.cast(reach).alias("reach"))

    start = F.struct(F.array().cast("array<array<string>>").alias("out"), F.array().cast(reach).alias("reach"))
    return F.aggregate(rows, start, step, lambda s: s["out"])


def _nested_tables(body: F.Column) -> F.Column:
    """Does a table open before the one before it is closed?"""
    tags = F.regexp_extract_all(body, F.lit(r"(?i)<(/?)table\b"), 1)
    depth = F.aggregate(tags, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, t: F.struct(
        F.when(t == "", a["now"] + 1).otherwise(F.greatest(a["now"] - 1, F.lit(0))).alias("now"),
        F.greatest(a["most"], F.when(t == "", a["now"] + 1).otherwise(F.lit(0))).alias("most")))
    return depth["most"] > 1


def _side_by_side(body: F.Column) -> F.Column:
    """``table_rows`` of a body without tables inside tables, spans and
    comments, where cutting at the opening tags is enough."""
    tables = F.slice(F.split(body, r"(?i)<table\b[^>]*>"), 2, 1 << 30)
    tables = F.transform(tables, lambda t: F.regexp_replace(t, r"(?is)</table\s*>.*$", ""))

    def rows(table: F.Column) -> F.Column:
        parts = F.slice(F.split(table, r"(?i)<tr\b[^>]*>"), 2, 1 << 30)
        return F.transform(parts, lambda r: F.regexp_replace(r, r"(?is)</(?:tr|tbody|thead|tfoot)\s*>.*$", ""))

    def cells(row: F.Column) -> F.Column:
        parts = F.slice(F.split(row, r"(?i)<t[dh]\b[^>]*>"), 2, 1 << 30)
        return F.transform(parts, lambda c: _cell_text(F.regexp_replace(c, r"(?is)</t[dh]\s*>.*$", "")))

    return F.transform(tables, lambda t: F.transform(rows(t), cells))


def table_rows(body: F.Column) -> F.Column:
    """Tables (in the order in which they open) → rows → cell texts, tables
    inside tables and spanned cells included.  Only bodies that have these (or
    comments) are walked with a stack."""
    walk = body.rlike(r"(?i)<t[dh]\b[^>]*\b(?:col|row)span|<!--") | _nested_tables(body)
    return F.when(walk, _walked_tables(body)).otherwise(_side_by_side(body))


def _walked_tables(body: F.Column) -> F.Column:
    def tables(pieces: F.Column) -> F.Column:
        def text(c: F.Column) -> F.Column:
            return _cell_text(F.array_join(F.slice(pieces, c["a"] + 1, c["b"] - c["a"]), ""))

        def spanned(row: F.Column) -> F.Column:
            return F.transform(row["cells"], lambda c: F.struct(
                text(c).alias("text"), _span(F.get(pieces, c["a"]), "colspan").alias("across"), _span(F.get(pieces, c["a"]), "rowspan").alias("down")))

        def of_walk(walked: F.Column) -> F.Column:
            def of_table(t: F.Column) -> F.Column:
                own = F.filter(walked, lambda r: r["t"] == t)
                return F.when(body.rlike(r"(?i)<t[dh]\b[^>]*\b(?:col|row)span"), _grid(F.transform(own, spanned))) \
                    .otherwise(F.transform(own, lambda r: F.transform(r["cells"], text)))
            n = n_tables(body)
            return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), of_table)).otherwise(F.array().cast("array<array<array<string>>>"))
        return _once(_walk(pieces), of_walk)
    return _once(_pieces(body), tables)


def html_cells(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cell text of every table row of every HTML document, natively.

    Tags are stripped, ``<br>`` becomes a line break and character references
    are decoded.  Documents without rows keep one row with NULL cells and
    their table count.
    """
    keep = list(keep)
    d = docs.select(*keep, F.coalesce(n_tables(F.col("body")), F.lit(0)).cast("int").alias("n_tables"), table_rows(F.col("body")).alias("_tables"))
    t = d.select(*keep, "n_tables", F.posexplode_outer("_tables").alias("table_no", "_rows"))
    return t.select(*keep, "n_tables", "table_no", F.posexplode_outer("_rows").alias("row_no", "cells"))


def parse_html_rows(docs: DataFrame, keys: tuple[str, ...] = ("station", "year", "month")) -> DataFrame:
    """Rows with ≥ 17 cells whose first cell is a day number; numbers by
    the lenient report rule, condition and direction as trimmed text, the
    times that only text reports give missing.  ``keys`` are carried along
    (year and month among them)."""
    rows = F.filter(F.flatten(table_rows(F.col("body"))), _is_html_day_row)
    found = docs.select(*keys, F.explode(rows).alias("cells"))
    cols = []
    for i, name in enumerate(HTML_FIELDS):
        raw = F.get(F.col("cells"), i)
        cols.append((report_int(raw) if name == "day" else strip_text(raw) if name in HTML_TEXTS else report_number(raw)).alias(name))
    cols += [F.lit(None).cast("string").alias(c) for c in sorted(TEXT_TIMES)]
    out = found.select(*keys, *cols)
    return out.withColumn("date", iso_date("year", "month", "day")).withColumn("source_format", F.lit("html_old"))


def format_of(url: str | F.Column) -> F.Column:
    """Format dispatch by suffix."""
    u = F.lower(F.regexp_replace(F.col(url) if isinstance(url, str) else url, r"[?#].*$", ""))
    return (F.when(u.endswith(".txt"), "txt")
            .when(u.endswith(".html") | u.endswith(".htm"), "html")
            .otherwise("unsupported"))


def _is_html_day_row(cells: F.Column) -> F.Column:
    return cells.isNotNull() & (F.size(cells) >= HTML_MIN_CELLS) & report_int(F.get(cells, 0)).between(1, 31)


# Fixed value: a body that is an error page of the server.
NOT_FOUND_BODY = r"(?is)\A\s*(?:<[^>]*>\s*)*(?:error\s+)?404\b|<title>[^<]*\b(?:404|not found)\b[^<]*</title>"


def line_counts(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Lines and accepted report lines of each document (the silent drops
    made visible), counted inside the row: no shuffle; a null body has no
    lines."""
    lines = F.split("body", "\n")
    return docs.select(*keys, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("lines"),
                       F.coalesce(F.size(F.filter(lines, lambda x: x.rlike(TEXT_ROW_PATTERN))), F.lit(0)).cast("long").alias("accepted"))


def ledger(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, url, format, status, message, rows), one row per
    document, all counted inside the document's row (one scan, no shuffle).

    The format is the url's suffix or, without a known one, what the body
    looks like: markup is html, lines of a report are txt, else unsupported.
    Statuses: ``not_found`` (no body, or a server's error page),
    ``unsupported_format``, ``no_table``, ``parsed_zero_rows``, ``ok``."""
    body = F.col("body")
    d = docs.withColumn("_accepted", F.coalesce(F.size(F.filter(F.split(body, "\n"), lambda x: x.rlike(TEXT_ROW_PATTERN))), F.lit(0)))
    by_suffix = format_of("url")
    by_content = (F.when(body.rlike(r"(?is)<(?:!doctype\s+html|html|body|table)\b"), "html").when(F.col("_accepted") > 0, "txt")
                  .otherwise("unsupported"))
    d = d.withColumn("format", F.when(by_suffix != "unsupported", by_suffix).otherwise(F.coalesce(by_content, F.lit("unsupported"))))
    tables = table_rows(body)
    day_rows = F.size(F.filter(F.flatten(tables), _is_html_day_row))
    d = d.withColumn("_tables", F.coalesce(n_tables(body), F.lit(0)))
    rows = F.when(F.col("format") == "txt", F.col("_accepted")).when(F.col("format") == "html", F.coalesce(day_rows, F.lit(0))).otherwise(0)
    d = d.withColumn("rows", rows.cast("long"))
    status = (F.when(body.isNull() | (F.length(strip_text(body)) == 0) | body.rlike(NOT_FOUND_BODY), "not_found")
              .when(F.col("format") == "unsupported", "unsupported_format")
              .when((F.col("format") == "html") & (F.col("_tables") == 0), "no_table")
              .when(F.col("rows") == 0, "parsed_zero_rows")
              .otherwise("ok"))
    message = (F.when(F.col("status") == "not_found", "document not found").when(F.col("status") == "unsupported_format", "no report format recognised")
               .when(F.col("status") == "no_table", "no table in the document")
               .when(F.col("status") == "parsed_zero_rows", "no report rows").otherwise(""))
    return d.withColumn("status", status).select(*keys, "url", "format", "status", message.alias("message"),
                                                 F.when(F.col("status").isin("ok", "parsed_zero_rows"), F.col("rows")).otherwise(F.lit(0).cast("long")).alias("rows"))


def ledger_summary(status: DataFrame) -> DataFrame:
    """Documents and rows per (format, status)."""
    return status.groupBy("format", "status").agg(F.count(F.lit(1)).alias("documents"),
                                                  F.sum("rows").alias("rows"))


# ----------------------------------------------------------------- rendering
# The driver's ``pages`` contain no tables, so report documents are rendered
# from the daily table; values are pre-rounded to one decimal with
# floor(10x + 0.5)/10 so that any formatter prints the same digits.

def _one(c: F.Column) -> F.Column:
    return F.floor(c * 10 + F.lit(0.5)) / 10


def report_values(daily: DataFrame) -> DataFrame:
    """Per (station, date) the values a monthly report would print.

    Derived from the exact daily minimum and maximum only (no sums), so the
    one-decimal pre-rounding cannot depend on summation order.
    """
    lo, hi = F.col("T_min"), F.col("T_max")
    mean = (lo + hi) / 2
    idx = F.pmod(F.floor(hi * 100), F.lit(16)).cast("int")
    compass = F.array(*[F.lit(k) for k in COMPASS_DEGREES])
    day = F.dayofmonth("date")
    return daily.select(
        "station", "date", F.year("date").alias("year"), F.month("date").alias("month"), day.alias("day"),
        _one(mean).alias("mean_temp_c"), _one(hi).alias("max_temp_c"),
        F.format_string("%d:%02d", F.pmod(day * 5, F.lit(24)), F.pmod(day * 7, F.lit(60))).alias("max_temp_time"),
        _one(lo).alias("min_temp_c"),
        F.format_string("%d:%02d", F.pmod(day * 3, F.lit(24)), F.pmod(day * 11, F.lit(60))).alias("min_temp_time"),
        _one(F.greatest(F.lit(0.0), F.lit(18.3) - mean)).alias("heat_deg_days"),
        _one(F.greatest(F.lit(0.0), mean - F.lit(18.3))).alias("cool_deg_days"),
        _one(hi - lo).alias("rain_mm"), _one(lo / 2).alias("avg_wind_kmh"),
        _one(hi / 2).alias("max_wind_kmh"),
        F.format_string("%d:%02d", F.pmod(day * 7, F.lit(24)), F.pmod(day * 13, F.lit(60))).alias("max_wind_time"),
        F.get(compass, idx).alias("dom_wind_dir"))


def render_text_reports(values: DataFrame) -> DataFrame:
    """One text document per (station, year, month).  Days divisible by 9
    print '---' for rain, which the line pattern rejects (as in real reports)."""
    rain = F.when(F.col("day") % 9 == 0, F.lit("  ---")).otherwise(F.format_string("%5.1f", "rain_mm"))
    line = F.format_string("%2d %5.1f %5.1f %5s %5.1f %5s %5.1f %5.1f %5s %5.1f %5.1f %5s %3s",
                           "day", "mean_temp_c", "max_temp_c", "max_temp_time", "min_temp_c", "min_temp_time",
                           "heat_deg_days", "cool_deg_days", rain, "avg_wind_kmh", "max_wind_kmh",
                           "max_wind_time", "dom_wind_dir")
    g = (values.groupBy("station", "year", "month")
         .agg(F.sort_array(F.collect_list(F.struct("day", line.alias("line")))).alias("_l")))
    header = F.format_string("MONTHLY CLIMATOLOGICAL SUMMARY for %02d/%d  station %s", "month", "year", "station")
    body = F.concat_ws("\n", header, F.lit("DAY MEAN HIGH TIME LOW TIME HDD CDD RAIN AVG HIGH TIME DIR"),
                       F.lit("-" * 60), F.concat_ws("\n", F.col("_l.line")))
    return g.select("station", "year", "month",
                    F.format_string("reports/%s/%d/%02d_NOAA.TXT", "station", "year", "month").alias("url"),
                    body.alias("body"))


def render_html_reports(values: DataFrame) -> DataFrame:
    """One row-wise HTML document per (station, year, month) with three tables
    (navigation, legend, data); day rows carry the 18 fields and the day again."""
    fmt = lambda c: F.format_string("%.1f", c)
    text = {"day": F.col("day").cast("string"), "dep_from_normal_c": fmt(F.col("mean_temp_c") - 20), "avg_dew_point_c": F.lit("---"),
            "avg_wet_bulb_c": fmt(F.col("min_temp_c")), "sig_condition": F.lit("fog"), "sun_hours": fmt(F.col("max_temp_c") / 5),
            "snow_fall_cm": F.lit("-"), "avg_sea_level_pressure_hpa": F.lit("~1013.2"), "dom_wind_dir": F.col("dom_wind_dir"),
            "max_wind_dir_deg": F.lit("22,5")}
    cells = [text[c] if c in text else fmt(F.col(c)) for c in HTML_FIELDS] + [text["day"]]
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    g = (values.groupBy("station", "year", "month")
         .agg(F.sort_array(F.collect_list(F.struct("day", row.alias("r")))).alias("_r")))
    body = F.concat(F.lit("<html><body><table><tr><td><a href='/'>home</a></td></tr></table>"
                          "<table><tr><th>legend</th></tr></table><table><tr><th>Day</th></tr>"),
                    F.concat_ws("", F.col("_r.r")), F.lit("</table></body></html>"))
    return g.select("station", "year", "month",
                    F.format_string("reports/%s/%d/climatedata%d%d.html", "station", "year", "month", "year")
                    .alias("url"), body.alias("body"))


# ----------------------------------------------------------------- day pages

# Header labels of the half-hourly day page and the raw report
# names they are renamed to (F1), then the canonical names (F2).
DAY_PAGE_HEADERS = {
    "PeríodeTU": "period_utc",
    "TM°C": "temp_mean (°C)",
    "TX°C": "temp_max (°C)",
    "TN°C": "temp_min (°C)",
    "HRM%": "humidity (%)",
    "PPTmm": "precip (mm)",
    "VVM (10 m)km/h": "wind_mean_10m (km/h)",
    "DVM (10 m)graus": "wind_dir_10m (degrees)",
    "VVX (10 m)km/h": "wind_max_10m (km/h)",
    "PMhPa": "pressure (hPa)",
    "RSW/m2": "radiation (W/m²)",
}
CANONICAL_NAMES = {
    "temp_mean (°C)": "T_avg", "temp_min (°C)": "T_min", "temp_max (°C)": "T_max",
    "wind_dir_10m (degrees)": "wind_dir", "precip (mm)": "rain_mm",
    "wind_max_10m (km/h)": "max_wind_kmh", "wind_mean_10m (km/h)": "avg_wind_kmh",
    # our own identifier-safe names for the remaining raw columns
    "humidity (%)": "humidity", "pressure (hPa)": "pressure", "radiation (W/m²)": "radiation",
}
DAY_PAGE_MIN_TABLES = 3


def parse_day_pages(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readings from the third table of each day page (station, date,
    body), and the reject ledger of pages with fewer than three tables.

    A page's rows stay one array: its first row is the header, by whose text
    columns are located (renamed to raw, then canonical names), the others are
    exploded.  The period 'HH:MM - HH:MM' gives the reading's start time on
    the page's day, unparsable times are dropped, numbers are coerced to
    double.
    """
    body = F.col("body")
    enough = F.coalesce(n_tables(body), F.lit(0)) >= DAY_PAGE_MIN_TABLES
    table = docs.where(enough).select("station", "date", F.get(table_rows(body), DAY_PAGE_MIN_TABLES - 1).alias("_rows"))
    data = table.select("station", "date", F.get("_rows", 0).alias("_hdr"), F.explode(F.slice("_rows", 2, 1 << 30)).alias("cells"))
    raw_cols = {}
    for label, raw in DAY_PAGE_HEADERS.items():
        pos = F.array_position(F.col("_hdr"), F.lit(label))
        raw_cols[raw] = F.when(pos > 0, F.try_element_at(F.col("cells"), pos.cast("int")))
    start = F.get(F.split(raw_cols["period_utc"], " - ", 2), 0)
    ts = F.try_to_timestamp(F.concat_ws(" ", F.col("date").cast("string"), start), F.lit("yyyy-MM-dd HH:mm"))
    out = data.select("station", ts.cast("timestamp_ntz").alias("datetime_utc"),
                      *[text_to_double(raw_cols[raw]).alias(CANONICAL_NAMES.get(raw, raw))
                        for raw in DAY_PAGE_HEADERS.values() if raw != "period_utc"])
    rejects = docs.where(~enough).select("station", F.date_format("date", "yyyy-MM-dd").alias("date"),
                                         F.lit("Less than 3 tables found").alias("error"))
    return out.where(F.col("datetime_utc").isNotNull()), rejects


def render_day_pages(halfhourly: DataFrame, reject_every: int = 7) -> DataFrame:
    """One page per (station, day): navigation and summary tables, then the
    readings table.  Days whose day-of-month is divisible by ``reject_every``
    lose the readings table (the 'Less than 3 tables' case)."""
    lo, hi = F.col("T_min"), F.col("T_max")
    t = F.col("datetime_utc")
    period = F.format_string("%s - %s", F.date_format(t, "HH:mm"),
                             F.date_format(t + F.expr("INTERVAL 30 MINUTES"), "HH:mm"))
    vals = [period, F.format_string("%.1f", _one((lo + hi) / 2)), F.format_string("%.1f", _one(hi)),
            F.format_string("%.1f", _one(lo)), F.format_string("%.1f", _one(hi - lo)),
            F.format_string("%.1f", _one(F.col("wind_dir"))), F.lit("s/d")]
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), v, F.lit("</td>")) for v in vals], F.lit("</tr>"))
    heads = ["PeríodeTU", "TM°C", "TX°C", "TN°C", "PPTmm", "DVM (10 m)graus", "RSW/m2"]
    header = "<tr>" + "".join(f"<th>{h}</th>" for h in heads) + "</tr>"
    g = (halfhourly.groupBy("station", F.to_date("datetime_utc").alias("date"))
         .agg(F.sort_array(F.collect_list(F.struct("datetime_utc", row.alias("r")))).alias("_r")))
    data_table = F.concat(F.lit("<table>" + header), F.concat_ws("", F.col("_r.r")), F.lit("</table>"))
    keep = F.dayofmonth("date") % reject_every != 0
    body = F.concat(F.lit("<html><body><table><tr><td>menu</td></tr></table><table><tr><td>summary</td></tr></table>"),
                    F.when(keep, data_table).otherwise(F.lit("")), F.lit("</body></html>"))
    return g.select("station", "date", F.format_string("pages/%s/%s.html", "station",
                                                       F.date_format("date", "yyyy-MM-dd")).alias("url"),
                    body.alias("body"))


# ----------------------------------------------------------------- stacked monthly report

# Column order of the column-stacked monthly HTML report; the
# 19th cell repeats the day list and is ignored.
STACKED_FIELDS = ["day", "max", "min", "avg", "dep_from_normal", "dew_point", "wet_bulb", "heating", "cooling",
                  "sig_cond", "sun_hrs", "snow_fall", "rain", "pressure", "wind_speed", "wind_dir", "wind_max",
                  "wind_max_dir"]
STACKED_MIN_CELLS = 19
STACKED_MIN_DAYS = 28


def parse_stacked_reports(docs: DataFrame, keys: tuple[str, ...] = ("station", "year", "month")) -> DataFrame:
    """The data row is the first with ≥ 19 cells whose first cell lists
    the days (contains '1', at least 28 day numbers).  Each stacked column is
    split on line breaks and cut or padded to the number of days.  All of a
    document stays in its row until its days are exploded."""
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    days = lambda row: F.filter(lines(F.get(row, 0)), lambda s: s.rlike("^[0-9]+$"))
    rows = F.filter(F.flatten(table_rows(F.col("body"))), lambda row: (F.size(row) >= STACKED_MIN_CELLS)
                    & F.array_contains(days(row), "1") & (F.size(days(row)) >= STACKED_MIN_DAYS))
    pick = docs.select(*keys, F.get(rows, 0).alias("_row")).where(F.col("_row").isNotNull())
    pick = pick.select(*keys, "_row", days(F.col("_row")).alias("_days"))
    cols = {"day": F.col("_days")}

    def fit(values):
        """Cut or pad to the number of days (a short column yields NULLs)."""
        return F.transform(F.sequence(F.lit(1), F.size("_days")), lambda k: F.try_element_at(values, k))

    for i, name in enumerate(STACKED_FIELDS[1:], start=1):
        cols[name] = fit(lines(F.get(F.col("_row"), i)))
    zipped = pick.select(*keys, F.explode(F.arrays_zip(*[c.alias(k) for k, c in cols.items()])).alias("_z"))
    out = zipped.select(*keys, *[F.col(f"_z.{k}").alias(k) for k in STACKED_FIELDS])
    typed = []
    for k in STACKED_FIELDS:
        c = sentinel_to_null(k)
        if k in ("wind_dir", "wind_max_dir"):
            c = strip_approx_mark(c)
        typed.append((c if k == "sig_cond" else report_int(c) if k == "day" else text_to_double(c)).alias(k))
    return out.select(*keys, *typed).withColumn("date", iso_date("year", "month", "day"))


def render_stacked_reports(daily: DataFrame) -> DataFrame:
    """One column-stacked report per (station, year, month) over every
    calendar day of the month; days without data print '---'."""
    months = daily.groupBy("station", F.trunc("date", "month").alias("m0")).agg(F.count(F.lit(1)).alias("_n"))
    cal = months.select("station", "m0", F.explode(F.sequence("m0", F.last_day("m0"))).alias("date"))
    d = cal.join(daily, ["station", "date"], "left")
    lo, hi = F.col("T_min"), F.col("T_max")
    fmt = lambda c: F.coalesce(F.format_string("%.1f", _one(c)), F.lit("---"))
    vals = {"max": fmt(hi), "min": fmt(lo), "avg": fmt((lo + hi) / 2), "rain": fmt(hi - lo),
            "wind_dir": F.coalesce(F.concat(F.lit("~"), F.format_string("%.1f", F.pmod(F.floor(hi * 100), F.lit(16)) * 22.5)),
                                   F.lit("---")),
            "sig_cond": F.when(hi.isNull(), F.lit("---")).otherwise(F.lit("fog"))}
    items = F.struct(F.dayofmonth("date").alias("day"),
                     *[vals.get(k, F.lit("---")).alias(k) for k in STACKED_FIELDS[1:]])
    g = d.groupBy("station", F.year("date").alias("year"), F.month("date").alias("month")) \
        .agg(F.sort_array(F.collect_list(items)).alias("_d"))
    cell = lambda c: F.concat(F.lit("<td>"), F.concat_ws("<br>", c), F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell(F.col("_d.day").cast("array<string>")),
                   *[cell(F.col(f"_d.{k}")) for k in STACKED_FIELDS[1:]],
                   cell(F.col("_d.day").cast("array<string>")), F.lit("</tr>"))
    body = F.concat(F.lit("<html><body><table><tr><th>CLIMATE DATA</th></tr><tr><td>1</td><td>x</td></tr>"), row,
                    F.lit("</table></body></html>"))
    return g.select("station", "year", "month",
                    F.format_string("stacked/%s/%d/%02d.html", "station", "year", "month").alias("url"),
                    body.alias("body"))
