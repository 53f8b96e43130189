"""The sanitiser against a plain one that replaces tag by tag, over all pages and over broken markup."""

import random
import re

import pyarrow.parquet as pq
import pytest
from compare import DATA
from pyspark.sql import functions as F

from tidewell.functions import text

ALLOWED = set("p br ul ol li strong b em i u h1 h2 h3 h4 h5 h6 a blockquote code pre hr span div table thead tbody tr td th".split())
LINK = re.compile(r"""href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def plain(html):
    """One replacement function called for each tag."""
    out = html or ""
    for gone in (r"<!--[\s\S]*?-->", r"<(script|style|iframe)[\s\S]*?</\1>", r"<(object|embed|form|input|button|link|meta|base)\b[^>]*>"):
        if "script" in gone:
            for name in ("script", "style", "iframe"):
                out = re.sub(gone.replace("(script|style|iframe)", name).replace("\\1", name), "", out, flags=re.I)
        else:
            out = re.sub(gone, "", out, flags=re.I | re.A)

    def tag(m):
        name = m[1].lower()
        if name not in ALLOWED:
            return ""
        if m[0].startswith("</"):
            return f"</{name}>"
        if name != "a":
            return f"<{name}>"
        found = LINK.search(m[2])
        url = next((g for g in found.groups() if g is not None), "").strip() if found else ""
        if not re.match("https?://", url, re.I):
            return "<a>"
        return '<a href="' + url.replace('"', "&quot;") + '" target="_blank" rel="nofollow noopener noreferrer">'

    out = re.sub(r"</?([a-zA-Z][a-zA-Z0-9]*)\b([^>]*)>", tag, out, flags=re.A)
    return re.sub(r"\n{3,}", "\n\n", out).strip()


def safe(spark, rows):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r.y for r in df.select("i", text.sanitize_html(F.col("x")).alias("y")).orderBy("i").collect()]


BROKEN = [
    None, "", "no tags", "<", ">", "a < b > c", "<p", "<p>", "</p>", "<P CLASS=x>A</P >", "<p<b>x", "<x<p>y", "<1<p class=a>z", "< p>", "<<p>>", "<a_b>t</a_b>", "<p-q>t</p-q>", "<\u00e9p>t", "<b\u00e9>t", "😀<i>😀</i>😀<script>x</script>",
    '<a href="https://x.example/?a=1&b=2">k</a>', "<a href='http://x.example/\"q\"'>k</a>", "<a href=https://x.example>k</a>", '<a href="javascript:x">k</a>', '<a href=" HTTPS://x.example ">k</a>', '<a data-href="https://x.example">k</a>', '<a href="https://x.example/a>b">k</a>', '<a href="https://x.example>k</a>',
    "<a>k</a>", "<abbr>k</abbr>", "<a\nhref\n=\n'http://x.example'>k</a>", "<script>1", "<style>p{}</style >", "<iframe src=x></iframe>y", "<object data=x><embed y><formx z>", "<scr<!-- -->ipt>x</script>", "<!-- a --><p><!-- b", "a\n\n\n\n<p>\n\n\n</p>", "<img src=x onerror=y><svg/onload=z>", "x" * 300_000 + "<p class=y>",
]


def test_broken_markup(spark):
    assert safe(spark, BROKEN) == [plain(x) for x in BROKEN]


def test_random_pieces(spark):
    rng = random.Random(3)
    pieces = ["<", ">", "</", "p", "a", "b", "script", "style", "br", "/", " ", "href=", "HREF = ", '"', "'", "http://x.example", "javascript:", "!--", "-->", "text", "\n", "1", "_", "-", "é", "😀", "</script>", "<p>", "<a ", "object", "h1", "h7"]
    rows = ["".join(rng.choices(pieces, k=rng.randint(1, 25))) for _ in range(3000)]
    assert safe(spark, rows) == [plain(x) for x in rows]


def test_all_pages(spark):
    html = pq.read_table(f"{DATA}/pages.parquet").column("html").to_pylist()
    assert safe(spark, html) == [plain(x) for x in html]


@pytest.mark.parametrize("n", [20_000])
def test_many_tags_are_read_in_one_pass(spark, n):
    html = "<p class=a>x</p><q>" * n
    assert safe(spark, [html]) == ["<p>x</p>" * n]
