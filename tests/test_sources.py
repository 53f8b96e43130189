"""Connectors, robots rules, boards and streams."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from tidewell.schema import RAW
from tidewell.sources import connectors as c
from tidewell.sources import robots
from tidewell.streaming import ingest


def read(spark, id, payload):
    df = spark.createDataFrame([("tok", "Label", json.dumps(payload) if not isinstance(payload, str) else payload, 0)], "token string, label string, payload string, ord long")
    return c.read_payloads(df, c.source_by_id(id)).collect()


def test_greenhouse(spark):
    rows = read(spark, "greenhouse", {"jobs": [{"id": 7, "title": "A", "absolute_url": "u", "offices": [{"name": "X"}, {"location": "Y"}], "content": "c", "updated_at": "t"}, {"id": 8, "title": "", "absolute_url": "u"}, {"id": 7, "title": "again", "absolute_url": "u"}]})
    assert len(rows) == 1 and rows[0].sourceJobId == "tok:7" and rows[0].locationRaw == "X / Y" and rows[0].company == "Label" and rows[0].title == "A"


def test_lever_is_a_list(spark):
    r = read(spark, "lever", [{"id": "a", "text": "T", "hostedUrl": "h", "createdAt": 1717200000123, "categories": {"location": "Remote", "team": "X"}, "descriptionPlain": "p"}])[0]
    assert r.postedAt == "1717200000123" and r.remoteHint and r.description == "p" and not r.descriptionIsHtml and r.departmentRaw == "X"


def test_ashby_pay(spark):
    pay = {"summaryComponents": [{"compensationType": "Salary", "minValue": 10, "maxValue": 20, "currencyCode": "USD", "interval": "1 YEAR"}]}
    rows = read(spark, "ashby", {"jobs": [{"id": 1, "title": "T", "jobUrl": "j", "compensation": pay}, {"id": 2, "title": "T", "jobUrl": "j", "isListed": False}]})
    assert [r.salaryRaw for r in rows] == ["USD 10 - 20 per year"]


def test_adzuna_predictions_are_dropped(spark):
    rows = read(spark, "adzuna", {"results": [{"id": "1", "title": "<b>T</b>", "redirect_url": "u", "salary_min": 10.4, "salary_max": 20.5}, {"id": "2", "title": "T", "redirect_url": "u", "salary_min": 1, "salary_is_predicted": "1"}]})
    assert {r.sourceJobId: (r.title, r.salaryRaw) for r in rows} == {"1": ("T", "$10 - $21 per year"), "2": ("T", None)}


def test_other_boards(spark):
    assert read(spark, "workable", {"name": "N", "jobs": [{"shortcode": "s", "title": "T", "url": "u", "city": "C", "country": "D"}]})[0].locationRaw == "C, D"
    assert read(spark, "recruitee", {"offers": [{"id": 1, "title": "T", "careers_url": "u", "description": "a", "requirements": "b"}]})[0].description == "a\nb"
    assert read(spark, "jooble", {"jobs": [{"title": "T", "link": "l", "source": "s"}]})[0].sourceName == "Jooble · s"
    assert read(spark, "arbeitnow", {"data": [{"title": "T", "slug": "s", "remote": True, "tags": ["a", "b"]}]})[0].departmentRaw == "a, b"
    assert read(spark, "smartrecruiters", {"content": [{"id": "i", "name": "T", "jobAd": {"sections": {"x": {"title": "H", "text": "t"}}}}]})[0].description == "<h3>H</h3>t"
    assert read(spark, "remotive", {"jobs": [{"id": 3, "title": "T", "url": "u"}]})[0].remoteHint
    assert read(spark, "lever", "not json") == []


def test_workday_details(spark):
    token = "acme@acme.example.com/Careers#Toronto"
    posts = [{"title": "Data clerk", "externalPath": "/job/1", "bulletFields": ["R1", "Full"], "postedOn": "Posted 3 Days Ago"}, {"title": "Cook", "externalPath": "/job/2", "locationsText": "Remote, ON", "postedOn": "Posted Yesterday"}, {"title": "no path"}]
    again = [{"title": "Data clerk", "externalPath": "/job/1"}, {"title": "Data entry", "externalPath": "/job/3", "startDate": "2024-05-01"}]
    pages = spark.createDataFrame([(token, "Acme (Canada)", json.dumps({"jobPostings": p}), n) for n, p in enumerate([posts, again, []])] + [(token, "Acme", None, 9)], "token string, label string, payload string, ord long")
    now = datetime(2024, 6, 1, 12)
    rows = {r.sourceJobId: r for r in c.read_workday(pages, now).collect()}
    assert sorted(rows) == ["acme:/job/1", "acme:/job/2", "acme:/job/3"]
    one = rows["acme:/job/1"]
    assert (one.sourceUrl, one.company, one.locationRaw, one.description, one.postedAt) == ("https://acme.example.com/Careers/job/1", "Acme", "Toronto", "R1 · Full", "2024-05-29T12:00:00.000Z")
    assert rows["acme:/job/2"].remoteHint and rows["acme:/job/2"].postedAt == "2024-05-31T12:00:00.000Z" and rows["acme:/job/3"].postedAt.startswith("2024-05-01")
    wanted = c.workday_targets(c.read_workday(pages, now), ["data engineer", " "]).collect()
    assert [(r.sourceJobId, r.detail_url) for r in wanted] == [("acme:/job/1", "https://acme.example.com/wday/cxs/acme/Careers/job/1"), ("acme:/job/3", "https://acme.example.com/wday/cxs/acme/Careers/job/3")]
    assert c.workday_targets(c.read_workday(pages, now), ["data"], 1).count() == 1 and c.workday_targets(c.read_workday(pages, now), []).count() == 0
    info = {"jobDescription": "<p>D</p>", "location": "Ottawa", "additionalLocations": ["Hull", ""], "timeType": "Full time", "remoteType": "On site", "externalUrl": "https://e"}
    details = spark.createDataFrame([("acme:/job/1", json.dumps({"jobPostingInfo": info}), 1), ("acme:/job/1", "{}", 0), ("acme:/job/2", "not json", 0)], "sourceJobId string, payload string, ord long")
    full = {r.sourceJobId: r for r in c.read_workday(pages, now, details).collect()}
    got = full["acme:/job/1"]
    assert (got.description, got.descriptionIsHtml, got.locationRaw, got.employmentTypeRaw, got.remoteHint, got.applyUrl, got.postedAt) == ("<p>D</p>", True, "Ottawa / Hull", "Full time", False, "https://e", one.postedAt)
    assert full["acme:/job/2"] == rows["acme:/job/2"] and len(full) == 3


def test_boards_with_several_payloads(spark):
    """Second pages, repeats, rows without what a listing needs, and payloads that are null or broken."""
    page = lambda *jobs: json.dumps({"jobs": list(jobs)})
    job = lambda i, **more: {"id": i, "title": f"T{i}", "absolute_url": f"u{i}", **more}
    landed = [("a", "A", page(job(1), job(2)), 0), ("a", "A", page(job(2, title="again"), job(3, company_name="Firm")), 1), ("b", "B", page(job(1), {"id": 9, "title": None, "absolute_url": "u"}), 2), ("b", "B", None, 3), ("c", "C", "{broken", 4), ("c", "C", '{"jobs": null}', 5), ("c", "C", "[]", 6)]
    df = spark.createDataFrame(landed, "token string, label string, payload string, ord long")
    rows = c.read_payloads(df, c.source_by_id("greenhouse")).orderBy("_ord").collect()
    assert [(r.sourceJobId, r.title, r.company) for r in rows] == [("a:1", "T1", "A"), ("a:2", "T2", "A"), ("a:3", "T3", "Firm"), ("b:1", "T1", "B")]
    assert c.read_payloads(df.limit(0), c.source_by_id("greenhouse")).count() == 0


def test_source_status(spark):
    from tidewell.sources import snapshots

    rows = snapshots.source_status(spark, c.SOURCES, c.enabled_sources([], ["lever"])).orderBy("place").collect()
    assert [r.id for r in rows] == [s.id for s in c.SOURCES]
    assert [(r.id, r.reason) for r in rows if not r.enabled] == [("lever", "not selected")]


def test_result_pages(spark):
    html = '<article><a href="/jobsearch/jobposting/123?x=1"><h3><span class="noctitle"> 1 data clerk </span></h3><ul><li class="date">Posted on May 30, 2024</li><li class="business">Acme</li><li class="location"><span class="wb-inv">Location</span> Toronto</li><li class="salary">Salary: $20 hourly</li></ul></a></article><article>none</article>'
    r = c.read_result_pages(spark.createDataFrame([(html, 0)], "html string, ord long"), "https://x.example").collect()
    assert len(r) == 1 and r[0].title == "data clerk" and r[0].company == "Acme" and r[0].locationRaw == "Toronto" and r[0].salaryRaw == "$20 hourly" and r[0].postedAt == "May 30, 2024" and r[0].sourceUrl == "https://x.example/jobsearch/jobposting/123"


def test_feeds(spark):
    xml = '<feed><entry><title>Clerk</title><link href="https://x.example/jobposting/9?y"/><updated>2024-05-30</updated><summary>&lt;strong&gt;Employer:&lt;/strong&gt; Acme&lt;br/&gt;&lt;strong&gt;Location:&lt;/strong&gt; Not Available</summary></entry></feed>'
    r = c.read_feeds(spark.createDataFrame([(xml, 0)], "xml string, ord long")).collect()
    assert len(r) == 1 and r[0].company == "Acme" and r[0].locationRaw == "Ontario, Canada" and r[0].sourceJobId == "9"


def test_selection_and_boards(spark):
    assert [s.id for s in c.enabled_sources(["LEVER", "ashby"], ["ashby"])] == ["lever"]
    base = spark.createDataFrame([("Acme", "A")], "token string, label string")
    assert sorted(r.token for r in c.with_extra_boards(base, ["acme", "New", "new", ""]).collect()) == ["Acme", "New"]


def test_robots(spark):
    rules = robots.parse_robots("User-agent: a\nUser-agent: b\nDisallow: /x # c\nAllow: /x/y$\n\nUser-agent: *\nDisallow:\n", "b-bot")
    assert rules == [("disallow", "/x"), ("allow", "/x/y$")]
    dim = spark.createDataFrame([("o", k, p, robots.pattern_regex(p)) for k, p in [*rules, ("disallow", "/*.pdf$")]], "origin string, kind string, pattern string, regex string")
    urls = spark.createDataFrame([("o", "/x/y"), ("o", "/x/yz"), ("o", "/a.pdf"), ("o", "/a.pdfx"), ("q", "/x")], "origin string, path string")
    assert {r.path + r.origin: r.allowed for r in robots.verdicts(urls, dim).collect()} == {"/x/yo": True, "/x/yzo": False, "/a.pdfo": False, "/a.pdfxo": True, "/xq": True}
    assert robots.unread_verdict(404, False) and not robots.unread_verdict(503, False) and robots.unread_verdict(None, True)


def test_merge_stream(spark, tmp_path):
    kind = "id string, firstSeenAt timestamp, lastSeenAt timestamp, isExpired boolean, isRepost boolean, repostOf string, _ord long"
    at = datetime(2024, 6, 1)
    for n, id in enumerate("ab"):
        spark.createDataFrame([(id, at, at, False, False, None, 0)], kind).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in/*")
        ingest.merge_stream(stream, f"{tmp_path}/store", f"{tmp_path}/cp", kind, lambda: at).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/store/batch=1").collect()) == ["a", "b"]


def test_an_empty_snapshot_is_a_snapshot(spark, tmp_path):
    kind = "id string, firstSeenAt timestamp, lastSeenAt timestamp, isExpired boolean, isRepost boolean, repostOf string, _ord long"
    days = [datetime(2024, 1, 1), datetime(2024, 3, 1), datetime(2024, 3, 2)]
    batches = [[("a", days[0], days[0], False, False, None, 0)], [], [("b", days[2], days[2], False, False, None, 0)]]
    for n, (rows, at) in enumerate(zip(batches, days)):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in/*")
        ingest.merge_stream(stream, f"{tmp_path}/store", f"{tmp_path}/cp", kind, lambda at=at: at, retention=21).awaitTermination()
    held = [sorted(r.id for r in spark.read.schema(kind).parquet(f"{tmp_path}/store/batch={n}").collect()) for n in range(3)]
    assert held == [["a"], [], ["b"]]


def test_stream_counts(spark, tmp_path):
    spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2024, 1, 1, 5),), (datetime(2024, 3, 1),)], "ts timestamp").write.parquet(f"{tmp_path}/in")
    q = ingest.daily_counts(spark.readStream.schema("ts timestamp").parquet(f"{tmp_path}/in"), "ts").writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("days").collect()) == [1, 2]
    raw = ingest.raw_stream(spark, f"{tmp_path}/in")
    assert raw.isStreaming and "sourceJobId" in raw.columns and RAW
    assert ingest.first_seen_stream(raw.withColumn("at", F.current_timestamp()), "at").isStreaming
