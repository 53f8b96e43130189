"""Expressions on small corpora."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewell.functions import dates, geo, rules, salary, text

NOW = datetime(2024, 6, 1)


def run(spark, rows, expression):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_entities(spark):
    assert run(spark, ["&amp;lt; &#233;&#xE9;&eacute;", "&#0;a", "a &bull; b&nbsp;c", "&#128512;"], text.decode_entities) == ["< ééé", "a", "a • b c", "😀"]


def test_escaped_layer(spark):
    got = run(spark, ["&lt;p&gt;A &amp;amp; B&lt;/p&gt;", "<p>1 &lt;b</p>", "plain"], text.decode_escaped_html)
    assert got[1:] == ["<p>1 &lt;b</p>", "plain"] and got[0].startswith("<p>A")


def test_html_to_text(spark):
    html = "<style>x</style><ul><li>One</li><li>Two</li></ul><p>A&nbsp;b</p><script>bad()</script>"
    assert run(spark, [html, None, ""], text.html_to_text) == ["• One\n\n• Two\n\nA b", "", ""]


def test_sanitize(spark):
    html = '<p class="x" onclick="y()">Hi <A HREF="https://a.example/x?y=1" onclick=z>go</A> <a href="javascript:1">no</a><script>1</script><img src=x><B>b</B><!-- c --></p>'
    assert run(spark, [html], text.sanitize_html) == ['<p>Hi <a href="https://a.example/x?y=1" target="_blank" rel="nofollow noopener noreferrer">go</a> <a>no</a><b>b</b></p>']


def test_summarize(spark):
    long = "Word " * 60 + "End"
    got = run(spark, ["short  text", long, "x" * 300, "A. " + "b" * 200 + ". " + "c" * 200], text.summarize)
    assert got[0] == "short text" and got[1].endswith("Word…") and got[2] == "x" * 279 + "…" and got[3] == "A. " + "b" * 200 + "."


def test_keys(spark):
    assert run(spark, ["Élan & Co. Inc.", "Acme Corporation Canada", "Inc", ""], text.company_key) == ["elan-and", "acme", "inc", ""]
    assert run(spark, ["Senior SOC Analyst - Remote", "soc analyst"], text.title_key) == ["socanalyst", "socanalyst"]


def test_keywords(spark):
    assert run(spark, ["spark sql spark the the team b c++ c++x"], lambda x: F.array_join(text.keywords(x), ","))[0].split(",")[0] == "spark"


def test_keywords_are_counted_as_in_plain_python(spark):
    import random
    import re
    from collections import Counter

    def plain(x, limit):
        found = [w for w in re.findall(r"[a-z][a-z0-9+#.\-]{2,}", (x or "").lower()) if w not in text.STOP_WORDS and len(w) <= 30]
        return [w for w, _ in Counter(found).most_common()][:limit]

    rng = random.Random(4)
    long = ["x" * 30, "x" * 31, "1" + "y" * 31, "z" * 29 + "."]
    words = ["the", "THE", "with", "ab", "a", "abc", "xabc", "abc.", "c++", "c#x", "-abc", "9abc", "9", "9-ab", "éabc", "abcé", "Abc", "b-2", "node.js", "Kelvin", *long]
    rows = [rng.choice([" ", ", ", "\n", "/"]).join(rng.choice(words) for _ in range(rng.randrange(90))) for _ in range(60)]
    rows += [None, "", "the the with", "xabc abc abc", "abc abc xabc xabc the the the", "abc " * 30_000 + "xyz " * 20_000, " ".join(f"w{i * 7919 % 20_000}" for i in range(30_000)), f"{long[1]} {long[1]} abc"]
    for limit in (1, 3, 10, 120):
        assert run(spark, rows, lambda x: text.keywords(x, limit)) == [plain(x, limit) for x in rows], limit  # noqa: B023


def test_tint_is_stable(spark):
    got = run(spark, ["acme", "acme", "", "Zürich"], text.tint)
    assert got[0] == got[1] and all(0 <= g < 6 for g in got)


@pytest.mark.parametrize(("raw", "want"), [("2024-05-30", "2024-05-30"), ("May 30, 2024", "2024-05-30"), ("30 mai 2024", "2024-05-30"), ("2 days ago", "2024-05-30"), ("junk", None), ("", None), (None, None), ("99 Foo 2024", None), ("Thu, 30 May 2024 00:00:00 GMT", "2024-05-30")])
def test_dates(spark, raw, want):
    got = run(spark, [raw], lambda x: F.to_date(dates.parse_date(x, NOW)))[0]
    assert (None if got is None else got.isoformat()) == want


def test_salary_quirks(spark):
    got = run(spark, ["$95,000", "$20M to $30M", "0", None, "$50,000 - $60,000 an hour"], salary.parse_salary)
    assert got[0].annualMin == 95000 and got[0].currency == "CAD"
    assert got[2].min is None and got[3].raw is None
    assert got[4].period == "hour" and got[4].annualMin == 50000 * 2080


def test_salary_context_says_the_period(spark):
    df = spark.createDataFrame([("$30 - $40", "paid hourly")], "a string, b string")
    assert df.select(salary.parse_salary(F.col("a"), F.col("b")).alias("s")).first().s.period == "hour"


def test_terms_are_independent(spark):
    vocabulary = [rules.Term("Spark"), rules.Term("Spark SQL", ("sparksql",)), rules.Term("C++"), rules.Term("C")]
    assert run(spark, ["We use spark-sql and C++", "sparks"], lambda x: rules.find_terms(x, vocabulary)) == [["Spark", "Spark SQL", "C++", "C"], []]


def test_gazetteer(spark):
    places = spark.createDataFrame([("Marie", "n", None, 0), ("Sault Ste. Marie", "n", ["Soo"], 1), ("Toronto", "s", [], 2)], "name string, region string, aliases array<string>, ord int")
    rows = spark.createDataFrame([("Sault Ste. Marie, ON",), ("Greater Torontonia",), ("Paris",), ("On-site, New York",), (None,), ("remote (USA)",)], "place string")
    got = {r.place: r.geo for r in geo.locate(rows, "place", places).collect()}
    assert got["Sault Ste. Marie, ON"].city == "Sault Ste. Marie" and got["Greater Torontonia"].city == "Toronto"
    assert got["Paris"].city is None and not got["Paris"].isCanada and got["On-site, New York"].isOntario
    assert got["remote (USA)"].country == "United States" and got["remote (USA)"].isRemote


def test_board_ages(spark):
    got = run(spark, ["Posted 30+ Days Ago", "Posted Today", "Posted Yesterday", "2024-01-02", "soon"], lambda x: F.to_date(dates.parse_age(x, NOW)))
    assert [None if g is None else g.isoformat() for g in got] == ["2024-05-02", "2024-06-01", "2024-05-31", "2024-01-02", None]


def test_initials(spark):
    assert run(spark, ["The Acme Paper Co.", "x", ""], text.initials) == ["AP", "X", ""]


def test_steps_of_a_listing_are_computed_once(spark):
    written_out = lambda x: spark.range(1).select(F.lit("Acme Canada Inc").alias("x")).select(x(F.col("x")).alias("y"))._jdf.queryExecution().analyzed().toString()
    assert written_out(text.company_key).lower().count("translate(") == 1
    assert written_out(salary.to_number).lower().count("regexp_replace(x") == 1
    assert run(spark, ["Acme Canada Inc", "Inc", "Canada Group Inc", "A & B Co. Ltd. Corp Inc Group", "", None], text.company_key) == ["acme", "inc", "canada", "a-and-b-co", "", ""]
