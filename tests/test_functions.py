import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import chunking, html, text, urls, vectors
from corpusloom.sources import blobs, observations, robots


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\n é😀", max_size=400), st.integers(-2, 90), st.integers(-5, 120))
def test_spans_cover_all_but_white_space(body, size, overlap):
    found = list(chunking.spans(body, size, overlap))
    assert all(0 < b - a <= max(1, size) for a, b in found)
    assert all(not body[a].isspace() and not body[b - 1].isspace() for a, b in found)
    assert [a for a, _ in found] == sorted({a for a, _ in found})
    held = {k for a, b in found for k in range(a, b)}
    assert all(k in held or c.isspace() for k, c in enumerate(body))


def test_spans_of_plain_cases():
    assert list(chunking.spans(None)) == list(chunking.spans("")) == list(chunking.spans(" \n ")) == []
    assert [b - a for a, b in chunking.spans("x" * 250, 100, 0)] == [100, 100, 50]
    assert list(chunking.spans("short text", 1000)) == [(0, 10)]
    many = "\n\n".join(f"Paragraph {n} with some words in it." for n in range(8))
    found = list(chunking.spans(many, 100, 30))
    assert all(b2 > a1 for (_, a1), (b2, _) in zip(found, found[1:], strict=False)) or any(b < c for (_, c), (b, _) in zip(found, found[1:], strict=False))


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTP://Example.ORG:80/a/../b/./c?utm_a=1&B=2&a=1&a=0#x", "http://example.org/b/c?B=2&a=1&a=0"),
        ("https://e.org", "https://e.org/"), ("https://e.org:8443/Path?x=a b", "https://e.org:8443/Path?x=a+b"),
        ("not a url", "not a url"), ("mailto:x@e.org", "mailto:x@e.org"), (None, None), ("https://e.org/a b", "https://e.org/a%20b"), ("https://e.org/?FBCLID=1", "https://e.org/"),
    ],
)
def test_canonical(raw, want):
    assert urls.canonical(raw) == want
    assert urls.canonical(want) == want


def test_canonical_against_base():
    assert urls.canonical("../x?b=1&a=2", "https://e.org/p/q/r") == "https://e.org/p/x?a=2&b=1"
    assert urls.canonical("//other.org/y", "https://e.org/") == "https://other.org/y"


def test_robots(spark):
    found = robots.rules("User-agent: a\nUser-agent: *\nDisallow: /x # no\nAllow: /x/y\nDisallow: /*.pdf$\nDisallow:\n\nUser-agent: loom\nDisallow: /only", "other/1")
    paths = spark.createDataFrame([("/x/1", False), ("/x/y/1", True), ("/a.pdf", False), ("/a.pdf?q", True), ("/", True)], "p string, want boolean")
    assert paths.where(robots.allowed(F.col("p"), found) != F.col("want")).count() == 0
    assert robots.rules("User-agent: loom\nDisallow: /only", "corpusloom/1") == [(False, "/only")]


def test_html(spark):
    page = "<html><title> A\n &amp; B </title><div class='x'><div class=\"widget slideShow a\"><div>in</div><img></div>kept</div><div class=\"widget slideShow\"><div>open"
    assert one(spark, html.page_title(F.lit(page))) == "A &amp; B"
    assert one(spark, html.page_title(F.lit("<p>none"))) is None
    assert html.without_blocks(page) == "<html><title> A\n &amp; B </title><div class='x'>kept</div><div class=\"widget slideShow\"><div>open"
    assert one(spark, html.normalize_html(F.lit('<input name="__VIEWSTATE" value="abc"><input value="q" name="xToken"><a id="anch0a1b2c3d">'))) == '<input name="__VIEWSTATE" value=""><input value="" name="xToken"><a id="anch_">'
    body, kind = html.html_text("<nav>menu</nav><p>" + "Real words here. " * 20 + "</p><ul><li><a href=x>link</a></li></ul><script>no()</script>")
    assert kind == "density" and "menu" not in body and "no()" not in body and "link" not in body
    assert html.html_text(None) == ("", "body")
    xml = F.lit("<urlset><url><loc> https://e.org/a </loc><lastmod>2024-01-01</lastmod></url><url><priority>1</priority></url></urlset>")
    assert [tuple(e) for e in one(spark, html.sitemap_entries(xml))] == [("https://e.org/a", "2024-01-01", None)]
    assert [e["loc"] for e in one(spark, html.sitemap_entries(F.lit("<sitemapindex><sitemap><loc>https://e.org/s.xml</loc></sitemap></sitemapindex>")))] == ["https://e.org/s.xml"]
    assert one(spark, html.filename_hint(F.lit('attachment; filename="a b.pdf"'))) == "a b.pdf"


def test_text(spark):
    assert one(spark, text.clean_text(F.lit("\r\n a \t b \r\n\r\n\r\n\r\nc "))) == "a b\n\nc"
    assert text.clean_python("\r\n a \t b \r\n\r\n\r\n\r\nc ") == "a b\n\nc"
    assert one(spark, text.stopword_ratio(F.lit("123 !!"))) == 0.0 or one(spark, text.stopword_ratio(F.lit("!!"))) == 0.0
    assert one(spark, text.stopword_ratio(F.lit("You may call us at the office before the end of the day."))) > 0.3
    assert one(spark, text.is_boilerplate(F.lit("Home News Maps Contact Search"), 0.2)) and not one(spark, text.is_boilerplate(F.lit("Home News"), 0))
    assert one(spark, text.json_object(F.lit('text {"a": 1} more'))) == '{"a":1}'
    assert one(spark, text.json_object(F.lit("none"))) is None
    assert one(spark, text.meta_value(F.lit("a\r\n\tbé\x01 "))) == "a b"
    front = one(spark, text.frontmatter(F.lit('---\ntitle: "A: b"\nurl: u\n---\nbody')))
    assert front["meta"] == {"title": "A: b", "url": "u"} and front["body"].strip() == "body"
    body = "# H\n\n" + "\n\n".join(f"{n} " + "word " * 60 for n in range(9)) + "\n\n## Short\n\nno\n"
    cut = one(spark, text.markdown_chunks(F.lit(body)))
    assert len(cut) == 3 and all(60 < len(c) <= 1500 for c in cut) and cut[0][-100:] in cut[1] and one(spark, text.markdown_chunks(F.lit(None).cast("string"))) is None
    assert one(spark, text.markdown_chunks(F.lit(""))) == []
    assert one(spark, text.human_duration(F.lit(3_725_000))) == "1h 2m" and one(spark, text.human_bytes(F.lit(2048))) == "2.0 KB" and one(spark, text.human_bytes(F.lit(204_800))) == "200 KB"
    assert one(spark, text.human_age(F.lit(0), 90_000_000)) == "1 day ago" and one(spark, text.human_age(F.lit(7_200_000), 0)) == "in 2 hours"


def test_hash_embedding():
    base, near, far = (vectors.hash_embedding(t) for t in ("pay the water bill online", "pay your water bill by mail", "trail cleanup on saturday"))
    assert abs(float(base @ base) - 1) < 1e-5 and float(base @ near) > float(base @ far)
    assert vectors.hash_embedding("?!")[0] == 1.0 and vectors.hash_embedding(None).shape == (768,)


def test_polite_fetch():
    waits, replies = [], [(503, {"Retry-After": "2"}, b""), OSError(), (200, {}, b"ok")]

    def get(url, headers):
        reply = replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply

    assert observations.fetch_politely(get, "u", {}, sleep=waits.append) == (200, {}, b"ok") and waits == [2.0, 10.0]


def test_stores(spark, tmp_path):
    sha = "ab" * 32
    (tmp_path / "a" / "ab" / "ab").mkdir(parents=True)
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "ab" / "ab" / f"{sha}.html").write_bytes(b"one")
    (tmp_path / "b" / f"{'cd' * 32}.pdf").write_bytes(b"two")
    manifest = spark.createDataFrame([(sha,), ("cd" * 32,), ("ef" * 32,)], "sha256 string")
    got = {r["sha256"][:2]: r["body"] and bytes(r["body"]) for r in observations.bodies(spark, manifest, str(tmp_path / "a"), str(tmp_path / "b")).collect()}
    assert got == {"ab": b"one", "cd": b"two", "ef": None}
    rows = spark.createDataFrame([("s1", b"x"), ("s1", b"x"), ("s2", b"y")], "sha256 string, body binary")
    path = str(tmp_path / "store")
    assert {r[0] for r in blobs.put_if_absent(rows, path).collect()} == {"s1", "s2"}
    blobs.put_if_absent(rows, path)
    assert spark.read.parquet(path).count() == 2
    assert one(spark, blobs.blob_key(F.lit(sha), F.lit(".pdf"))) == f"blobs/ab/ab/{sha}.pdf"
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.md").write_text("---\nurl: u\n---\nhello")
    assert observations.markdown_corpus(spark, str(tmp_path / "m")).first()["meta"] == {"url": "u"}


def test_http_source_is_registered(spark):
    spark.dataSource.register(observations.HttpSource)
    assert spark.read.format("http_pages").option("urls", "").load().columns == ["url", "status", "content_type", "body"]


def test_fetched_requests(spark):
    requests = spark.createDataFrame([("u1", {"If-None-Match": "e"}), ("u2", None)], "url string, headers map<string,string>")

    def get(url, headers):
        return (304 if headers else 200, {"Content-Type": "text/html"}, b"hi")

    assert {(r["url"], r["status"], r["content_type"]) for r in observations.fetched(requests, get).collect()} == {("u1", 304, "text/html"), ("u2", 200, "text/html")}
