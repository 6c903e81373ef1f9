import pytest

from touchline.sources import html as h


def grid(page):
    """{table: {row: {column: text}}}"""
    out = {}
    for t, _, r, c, _, _, text in h.cells_of(page):
        assert c not in out.setdefault(t, {}).setdefault(r, {})
        out[t][r][c] = text
    return {t: [[rows[r].get(c) for c in range(max(rows[r]) + 1)] for r in sorted(rows)] for t, rows in out.items()}


@pytest.mark.parametrize(
    "page,want",
    [
        ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>", {0: [["a", "b"], ["c"]]}),
        ("<TABLE><tr><td>a<td>b<tr><td>c", {0: [["a", "b"], ["c"]]}),  # nothing is closed
        ("<table><td>a</td></tr></td><tr></table></table><td>x</td>", {0: [["a"]]}),  # stray ends, cells outside
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", {0: [["a", "b"], ["a", "c"]]}),
        ("<table><tr><td>a<td rowspan='3'>b<td>c<tr><td>d<td>e<tr><td>f</table>", {0: [["a", "b", "c"], ["d", "b", "e"], ["f", "b"]]}),
        ("<table><tr><td colspan=2 rowspan=2>a<td>b<tr><td>c<tr><td>d</table>", {0: [["a", "a", "b"], ["a", "a", "c"], ["d"]]}),
        ("<table><tr><td rowspan=9>a<tr></table>", {0: [["a"], ["a"]]}),  # spans end with the table
        ("<table><thead><tr><th rowspan=5>h<tbody><tr><td>1</table>", {0: [["h"], ["1"]]}),  # and with their section
        ("<table><tr><td colspan=0 rowspan=x>a<td colspan=-1>b<td colspan='2px'>c</table>", {0: [["a", "b", "c", "c"]]}),
        ("<table><tr><td>a<table><tr><td>in</table>b<td>c</table>", {0: [["ab", "c"]], 1: [["in"]]}),
        ("<table><tr><td> x &amp; <b> y </b>\n<script>var t = '<td>'</script> z &lt;</table>", {0: [["x &yz <"]]}),
        ("<table><tr><td><!-- <td>no --></table><table></table><table><tr><td>2", {0: [[""]], 2: [["2"]]}),
        ("", {}),
    ],
)
def test_grid(page, want):
    assert grid(page) == want


def test_pages_to_cells_and_records(spark):
    page = "<table id=s><thead><tr><th>Team<th>Pts<th></thead><tbody><tr><td>A<td>3<td>x</tr><tr><th>note</th></tr><tr><td>B</table>"
    df = spark.createDataFrame([(1, page, 0), (2, None, 0), (3, "<p>none</p>", 0), (4, page, 0)], "page_id long, html string, row int")
    cells = h.tables(df)
    assert cells.count() == 16 and {r["page_id"] for r in cells.collect()} == {1, 4} and cells.where("table_id <> 's'").count() == 0
    got = sorted((r["page_id"], r["row"], sorted(r["values"].items())) for r in h.records(cells).collect())
    assert got == sorted((p, *x) for p in (1, 4) for x in [(1, [("Pts", "3"), ("Team", "A"), ("column 2", "x")]), (3, [("Team", "B")])])
    assert h.tables(df.limit(0)).count() == 0
