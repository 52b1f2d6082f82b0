"""Text cleaning functions and report parsing."""

from html.parser import HTMLParser

from pyspark.sql import functions as F

from rainfold.functions import clean
from rainfold.sources import reports


def _eval(spark, fn, values, typ="STRING"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r.o for r in df.select(fn(F.col("v")).alias("o")).collect()]


def test_report_number(spark):
    got = _eval(spark, clean.report_number, ["1,5", " ~3.2 ", "O5", "---", "-----", "", "--5", "12abc", "-4.5"])
    assert got == [1.5, 3.2, 5.0, None, None, None, 5.0, None, -4.5]


def test_report_int_time_dir(spark):
    assert _eval(spark, clean.report_int, ["12", "O7", "1.5", "x"]) == [12, 7, None, None]
    assert _eval(spark, clean.report_time, ["7;05", "23:59", "24:00", "7:5", "0705"]) == ["07:05", "23:59", None,
                                                                                         None, None]
    assert _eval(spark, clean.report_wind_dir, [" sse", "55W"]) == ["SSE", "SSW"]


def test_compass_to_degrees(spark):
    assert _eval(spark, clean.compass_to_degrees, ["nne ", "W", "5", "123.5", "calm", None, ""]) == \
        [22.5, 270.0, 5.0, 123.5, None, None, None]


def test_iso_date_invalid_is_null(spark):
    df = spark.createDataFrame([(2021, 2, 30), (2020, 2, 29)], "y INT, m INT, d INT")
    out = [r.o for r in df.select(clean.iso_date("y", "m", "d").alias("o")).collect()]
    assert out[0] is None and str(out[1]) == "2020-02-29"


def test_nan_to_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "v DOUBLE")
    assert [r.o for r in df.select(clean.nan_to_null("v").alias("o")).collect()] == [None, 1.0]


REPORT = """MONTHLY CLIMATOLOGICAL SUMMARY for 07/2020
DAY MEAN HIGH TIME LOW TIME HDD CDD RAIN AVG HIGH TIME DIR
 1  24.1  30.2 14:30  18.0  5:10   0.0   5.8   0.0   6.1  33.8 15:20  SSW
 2  23.0  29.0 15;00  17.5  4:50   0.0   4.7   ---   5.0  30.0 16:00   SW
 3  22.0  28.0 13:00  16.0  6:00   0.0   3.7   2.4   4.0  28.9 12:00  5E
"""


def test_parse_text_report_drops_incomplete_lines(spark):
    docs = spark.createDataFrame([(1, 2020, 7, REPORT)], "doc_id BIGINT, year INT, month INT, body STRING")
    rows = reports.parse_text_reports(docs).orderBy("day").collect()
    assert [r.day for r in rows] == [1]  # line 2 has '---', line 3 has '5E' (digit) → no match
    r = rows[0]
    assert (r.mean_temp_c, r.max_temp_time, r.min_temp_time, r.dom_wind_dir) == (24.1, "14:30", "05:10", "SSW")
    stats = reports.line_counts(docs).collect()[0]
    assert (stats.lines, stats.accepted) == (6, 1)


OLD_ROW = ["5", "30.1", "18.2", "24.0", "+1.5", "12,3", "~15.0", "0.0", "5.7", " fog ", "9.5", "---", "2.4", "1013.2", "6.1",
           " SSW ", "33.8", "202.5", "5"]


def test_html_cells_and_rejects(spark):
    """A literal 19-cell day row of the row-wise report."""
    row = "".join(f"<td>{v}</td>" for v in OLD_ROW)
    good = f"<table><tr><th>Day</th></tr><tr>{row}</tr><tr><td>x</td></tr></table>"
    docs = spark.createDataFrame([(1, "a/report.html", good, 2020, 7), (2, "b/page.html", "<p>no table</p>", None, None),
                                  (3, "c/page.php", "<table></table>", None, None)],
                                 "doc_id BIGINT, url STRING, body STRING, year INT, month INT")
    rows = reports.parse_html_rows(docs, keys=("doc_id", "year", "month")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.day, r.max_temp_c, r.min_temp_c, r.mean_temp_c, r.dep_from_normal_c, r.avg_dew_point_c, r.avg_wet_bulb_c) == \
        (5, 30.1, 18.2, 24.0, 1.5, 12.3, 15.0)
    assert (r.heat_deg_days, r.cool_deg_days, r.sig_condition, r.sun_hours, r.snow_fall_cm, r.rain_mm) == (0.0, 5.7, "fog", 9.5, None, 2.4)
    assert (r.avg_sea_level_pressure_hpa, r.avg_wind_kmh, r.dom_wind_dir, r.max_wind_kmh, r.max_wind_dir_deg) == \
        (1013.2, 6.1, "SSW", 33.8, 202.5)
    assert (r.max_temp_time, r.min_temp_time, r.max_wind_time, r.source_format) == (None, None, None, "html_old")
    st = {r.doc_id: r.status for r in reports.ledger(docs).collect()}
    assert st == {1: "ok", 2: "no_table", 3: "parsed_zero_rows"}


def test_ledger_statuses(spark):
    row = "".join(f"<td>{v}</td>" for v in OLD_ROW)
    docs = spark.createDataFrame([
        (1, "a", f"<table><tr>{row}</table>"), (2, "b.html", "<table><tr><td><table><tr><td>1</table></table>"), (3, None, None),
        (4, "d", "<html><head><title>404 Not Found</title></head></html>"), (5, "e.txt", REPORT), (6, "f", REPORT), (7, "g", "just words"),
        (8, "h", "<html><p>x"), (9, "i.txt", "nothing"), (10, "j", "  ")], "doc_id BIGINT, url STRING, body STRING")
    got = {r.doc_id: (r.format, r.status, r.rows) for r in reports.ledger(docs).collect()}
    assert got[1] == ("html", "ok", 1) and got[2] == ("html", "parsed_zero_rows", 0)
    assert got[3][1] == got[4][1] == got[10][1] == "not_found"
    assert got[5] == got[6] == ("txt", "ok", 1)
    assert got[7][1] == "unsupported_format" and got[8] == ("html", "no_table", 0) and got[9] == ("txt", "parsed_zero_rows", 0)


class _Cells(HTMLParser):
    """Independent tag parser: cell texts of flat tables, row by row."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.cell = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.tables[-1][-1].append("")
            self.cell = True
        elif tag in ("br", "p", "div", "li") and self.cell:
            self.tables[-1][-1][-1] += "\n"

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.cell = None
        elif tag in ("p", "div", "li") and self.cell:
            self.tables[-1][-1][-1] += "\n"

    def handle_data(self, data):
        if self.cell:
            self.tables[-1][-1][-1] += data.replace("\n", " ").replace("\xa0", " ")


def _parsed(html):
    p = _Cells()
    p.feed(html)
    return [(len(p.tables), t, r, [c.strip() for c in row]) for t, rows in enumerate(p.tables) for r, row in enumerate(rows)]


def test_native_cells_match_a_tag_parser(spark):
    pages = ["<p>a &amp; b</p><TABLE class='x'><TR><TD> x&nbsp;<b>1</b> </TD><th>2<br/>3</th></TR></TABLE>",
             "<table><tr><td>1<td>2<tr><td>3</table><p>t</p><table><tbody><tr><td>4</td></tbody></table>",   # closing tags left out
             "<table><tr><td>1\n2<br>3</td></tr></table>", "<table></table>", "no table"]
    docs = spark.createDataFrame(list(enumerate(pages)), "doc_id BIGINT, body STRING")
    got = {}
    for r in reports.html_cells(docs, keep=("doc_id",)).where("cells IS NOT NULL").orderBy("doc_id", "table_no", "row_no").collect():
        got.setdefault(r.doc_id, []).append((r.n_tables, r.table_no, r.row_no, r.cells))
    for i, html in enumerate(pages):
        assert got.get(i, []) == _parsed(html), html


def _cells(spark, *bodies):
    docs = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "doc_id INT, body STRING")
    got = {}
    for r in reports.html_cells(docs, keep=("doc_id",)).where("cells IS NOT NULL").orderBy("doc_id", "table_no", "row_no").collect():
        got.setdefault(r.doc_id, {}).setdefault(r.table_no, []).append(r.cells)
    return got


def test_tables_inside_tables(spark):
    """Each is a table of its own; its text belongs to the outer cell too."""
    body = ("<table><tr><td>a<table><tr><td>b</td><td>c<table><tr><td>deep</table></td></tr></table>z</td><td>d</td></tr>"
            "<tr><td>e</td></tr></table><table><tr><td>f")
    assert _cells(spark, body)[0] == {0: [["abcdeepz", "d"], ["e"]], 1: [["b", "cdeep"]], 2: [["deep"]], 3: [["f"]]}


def test_spanned_cells_fill_the_grid(spark):
    body = ("<table><tr><th rowspan=2>day</th><th colspan='2'>wind</th><th rowspan=\"3\">r</th></tr><tr><th>a</th><th>b</th></tr>"
            "<tr><td>1</td><td COLSPAN=2>x</td></tr><tr><td>2</td><td>y</td><td>z</td><td rowspan=9>w</td></tr><tr><td>3</td></tr></table>")
    assert _cells(spark, body)[0][0] == [["day", "wind", "wind", "r"], ["day", "a", "b", "r"], ["1", "x", "x", "r"], ["2", "y", "z", "w"],
                                         ["3", None, None, "w"]]


def test_table_tags_in_comments_and_outside(spark):
    body = "<td>lost</td></tr><!-- <table><tr><td>no --><table><caption>c</caption><td>no row</td><tbody><tr><td>1<th>2</tbody></table></table><p>end"
    assert _cells(spark, body, None, "", "plain") == {0: {0: [["1", "2"]]}}


def test_nested_and_spanned_reports_give_their_rows(spark):
    """A row-wise report inside a layout table, its day in a spanned cell."""
    cells = "".join(f"<td>{x}</td>" for x in ["1", "20.5", "10.1", "15.0"])
    body = (f"<table><tr><td>menu</td><td><table><tr>{cells}<td colspan=13>0.5</td></tr></table></td></tr></table>")
    docs = spark.createDataFrame([("s", 2012, 5, "x.html", body)], "station STRING, year INT, month INT, url STRING, body STRING")
    (row,) = reports.parse_html_rows(docs).collect()
    assert (row.day, row.max_temp_c, row.min_temp_c, row.mean_temp_c, row.rain_mm, row.avg_wind_kmh) == (1, 20.5, 10.1, 15.0, 0.5, 0.5)
    (status,) = reports.ledger(docs, keys=("station",)).collect()
    assert (status.status, status.rows) == ("ok", 1)

def test_text_that_is_no_decimal_number(spark):
    odd = ["12d", "12f", "0x1p3", "nan", "NaN", "Infinity", "1e3", ".5", "5.", "+2", "\t7.5\n"]
    numbers = [None] * 6 + [1000.0, 0.5, 5.0, 2.0, 7.5]
    assert _eval(spark, clean.report_number, odd) == numbers
    assert _eval(spark, clean.text_to_double, odd) == numbers
    assert _eval(spark, clean.compass_to_degrees, ["12d", "nan", "\tN "]) == [None, None, 0.0]
    assert _eval(spark, clean.report_time, ["\t7:05"]) == ["07:05"]


def test_hour_without_values_sums_to_zero(spark):
    from rainfold.operators.resample import hourly_sum
    df = spark.sql("SELECT 'a' AS station, TIMESTAMP_NTZ '2024-01-01 00:30:00' AS datetime_utc, CAST(NULL AS DOUBLE) AS rain_mm")
    assert [r.rain_mm for r in hourly_sum(df).collect()] == [0.0]
